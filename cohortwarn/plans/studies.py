"""Studies: a modelling table, fitted models and their scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwarn.operators.evaluate import accuracy, classification_report, confusion, prediction_table
from cohortwarn.operators.models import (
    ablate,
    fit_forest,
    fit_tree,
    grid_search,
    importances,
    oob_score,
    permutation_importance,
    predict,
    tree_rules,
)
from cohortwarn.operators.ranks import mark_split
from cohortwarn.operators.smote import borderline_smote2, smote
from cohortwarn.operators.summary import append_tables, column_coverage, relabel_coverage
from cohortwarn.plans.tables import Cohort, coverage_parts, task
from cohortwarn.session import stable


class Study:
    """One modelling table with a fixed train/test split.

    The table is computed once (see :func:`stable`); fits and scores are jobs
    over that copy.
    """

    def __init__(
        self,
        table: DataFrame,
        features: Sequence[str],
        key: str = "row_id",
        label: str = "label",
        train: float | None = 0.8,
        test: float | None = None,
        seed: int = 42,
    ):
        self.key, self.label, self.features, self.seed = key, label, list(features), seed
        rows = stable(table.select(key, *features, label), "study")
        # One folder for each side: a fit does not read the test rows.
        marked = stable(mark_split(rows, [key], None if test else train, test, seed), "split", "is_train")
        self.train, self.test = (marked.filter(F.col("is_train") == v).drop("is_train") for v in (1, 0))

    def forest(self, features: Sequence[str] | None = None, train: DataFrame | None = None, **params):
        rows = self.train if train is None else train
        return fit_forest(rows, features or self.features, self.label, seed=self.seed, **params)

    def tree(self, **params):
        return fit_tree(self.train, self.features, self.label, seed=self.seed, **params)

    def report(self, model, variant: str) -> DataFrame:
        scored = predict(model, self.test)
        return classification_report(scored, self.label).withColumn("variant", F.lit(variant))

    def predictions(self, model) -> DataFrame:
        return prediction_table(predict(model, self.test), self.key, self.label)

    def resampled(self, kind: str = "borderline", features: Sequence[str] | None = None, **params) -> DataFrame:
        """Training rows balanced by new rows; the test rows stay as they are."""
        balance = {"plain": smote, "borderline": borderline_smote2}[kind]
        return balance(self.train, self.key, features or self.features, self.label, seed=self.seed, **params)


def warning_reports(
    table: DataFrame, features: Sequence[str], dropped: Sequence[str], trees: int = 100, k: int = 5
) -> DataFrame:
    """Forest, forest without weak features, the same on balanced rows, and a tuned forest."""
    study = Study(table, features)
    left = [f for f in features if f not in set(dropped)]
    balanced = stable(study.resampled("borderline", left, k=k))
    return append_tables([
        study.report(study.forest(trees=trees, max_features=None), "all features"),
        study.report(study.forest(left, trees=trees, max_features=None), "features dropped"),
        study.report(study.forest(left, balanced, trees=trees), "balanced"),
        study.report(study.forest(left, balanced, trees=20, max_depth=None, max_features=None, min_leaf=2), "tuned"),
    ])


def tuned_forest(
    table: DataFrame, features: Sequence[str], grid: Sequence[Mapping[str, object]], folds: int = 4, **params
):
    """Grid search on the training rows; the settings table and the best model's test report."""
    study = Study(table, features)
    model, settings = grid_search(
        study.train, study.key, study.features, study.label, grid, folds=folds, seed=study.seed, **params)
    return model, settings, study.report(model, "best setting")


def tree_report(table: DataFrame, features: Sequence[str], test: float = 0.2, **params):
    """A decision tree: rules and test accuracy."""
    study = Study(table, features, test=test, seed=10)
    model = study.tree(**params)
    return tree_rules(model, table.sparkSession), accuracy(predict(model, study.test))


def forest_scores(
    table: DataFrame,
    features: Sequence[str],
    trees: int = 100,
    parallelism: int = 4,
    bootstrap: bool = True,
    **params,
) -> DataFrame:
    """Test accuracy, out-of-bag accuracy, confusion and importances of one forest, long form.

    The out-of-bag trees have the number, depth and feature subset of the forest.
    """
    study = Study(table, features)
    model = study.forest(trees=trees, bootstrap=bootstrap, **params)
    scored = predict(model, study.test)
    test = accuracy(scored).select(F.lit("test accuracy").alias("measure"), F.col("accuracy").alias("value"))
    cells = confusion(scored).select(F.col("label"), F.inline(F.array(*[
        F.struct(F.lit(p).alias("name"), F.col(p).alias("n")) for p in ("predicted_0", "predicted_1")])))
    cells = cells.select(F.concat_ws(" ", F.lit("label"), F.col("label").cast("int").cast("string"), "name").alias("measure"),
                         F.col("n").cast("double").alias("value"))
    oob = oob_score(study.train, study.key, study.features, study.label, trees=trees, seed=study.seed,
                    parallelism=parallelism, **params)
    oob = oob.select(F.lit("oob accuracy").alias("measure"), F.col("oob_accuracy").alias("value"))
    imp = importances(model, table.sparkSession).select(
        F.concat(F.lit("importance "), "feature").alias("measure"), F.col("importance").alias("value"))
    return append_tables([test, cells, oob, imp])


def before_after_smote(table: DataFrame, features: Sequence[str], trees: int = 100, k: int = 5) -> DataFrame:
    """Reports of a forest on the training rows as they are and balanced."""
    study = Study(table, features)
    balanced = stable(study.resampled("plain", k=k))
    return append_tables([
        study.report(study.forest(trees=trees), "as is"),
        study.report(study.forest(train=balanced, trees=trees), "balanced"),
    ])


def _measures(
    study: Study,
    variant: str,
    features: Sequence[str],
    train: DataFrame | None = None,
    repeats: int = 0,
    parallelism: int = 4,
    bootstrap: bool = True,
    **params,
) -> DataFrame:
    """Everything that is asked of one forest, long form: variant, measure, value.

    Report and confusion on the test rows, out-of-bag accuracy on the rows the forest learned from, impurity
    importances and, with ``repeats``, permutation importances.
    """
    spark = study.train.sparkSession
    model = study.forest(features, train, bootstrap=bootstrap, **params)
    scored = stable(predict(model, study.test), "scored")
    name = lambda *parts: F.concat_ws(" ", *parts).alias("measure")
    report = classification_report(scored, study.label)
    numbers = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in ("precision", "recall", "f1", "support")])
    report = report.select("class", F.inline(numbers)).filter("value is not null").select(name(F.lit("report"), "class", "of"), "value")
    cells = confusion(scored, label=study.label)
    cells = cells.select(study.label, F.inline(F.array(*[
        F.struct(F.lit(p).alias("name"), F.col(p).cast("double").alias("value")) for p in ("predicted_0", "predicted_1")])))
    cells = cells.select(name(F.lit("label"), F.col(study.label).cast("int").cast("string"), "name"), "value")
    rows, key = study.train, study.key
    if train is not None:  # a made row has the key of its base row and a number
        key = "_made"
        rows = train.withColumn(key, F.concat_ws("#", F.col(study.key), "syn_no"))
    oob = oob_score(rows, key, features, study.label, seed=study.seed, parallelism=parallelism, **params)
    oob = oob.select(F.lit("oob accuracy").alias("measure"), F.col("oob_accuracy").alias("value"))
    weights = importances(model, spark).select(name(F.lit("importance"), "feature"), F.col("importance").alias("value"))
    parts = [report, cells, oob, weights]
    if repeats:
        drops = permutation_importance(model, study.test, study.key, study.label, repeats, study.seed)
        parts.append(drops.select(name(F.lit("permutation"), "feature"), F.col("importance_mean").alias("value")))
    return append_tables(parts).select(F.lit(variant).alias("variant"), "measure", "value")


TUNED = {"trees": 20, "max_depth": None, "max_features": None, "min_leaf": 2}


def forest_study(
    table: DataFrame,
    features: Sequence[str],
    dropped: Sequence[str] = (),
    balance: str | None = "borderline",
    tuned: Mapping[str, object] | None = None,
    repeats: int = 0,
    seed: int = 42,
    k: int = 5,
    m: int = 10,
    key: str = "row_id",
    **params,
) -> DataFrame:
    """The forests of a course beside one another: variant, measure, value.

    All features; without ``dropped``; without them on balanced rows (``balance``: borderline with ``m`` neighbours
    for the border, plain, or None); and a ``tuned`` forest on the balanced rows.  ``params`` are those of the untuned
    forests.  See :func:`_measures` for what is measured of each.
    """
    study = Study(table, features, key=key, seed=seed)
    left = [f for f in features if f not in set(dropped)]
    out = [_measures(study, "all features", features, repeats=repeats, **params)]
    if dropped:
        out.append(_measures(study, "features dropped", left, repeats=repeats, **params))
    if balance:
        balanced = stable(study.resampled(balance, left, k=k, **({"m": m} if balance == "borderline" else {})), "balanced")
        out.append(_measures(study, "balanced", left, balanced, repeats, **params))
        if tuned:
            out.append(_measures(study, "tuned", left, balanced, repeats, **tuned))
    return append_tables(out)


def task_studies(rows: DataFrame, features: Sequence[str], tasks: Sequence[str] = ("EF", "PF"), **params) -> DataFrame:
    """:func:`forest_study` for each way to cut the grades: task, variant, measure, value."""
    return append_tables([
        forest_study(task(rows, t), features, **params).select(F.lit(t).alias("task"), "*") for t in tasks])


def before_after_study(
    table: DataFrame, features: Sequence[str], trees: int = 100, k: int = 5, whole: bool = False, key: str = "row_id", **params
) -> tuple[DataFrame, DataFrame]:
    """A forest before and after plain balancing: its measures, and actual beside predicted of each test row.

    Balanced are the training rows; with ``whole`` all rows are, before they are split anew, which lets the test rows
    have made ones and neighbours among the training rows.
    """
    study = Study(table, features, key=key)
    if whole:
        rows = smote(table, study.key, features, study.label, k=k, seed=study.seed)
        rows = rows.withColumn(study.key, F.concat_ws("#", F.col(study.key), "syn_no")).drop("syn_no")
        after, train = Study(rows, features, key=key), None
    else:
        after, train = study, stable(study.resampled("plain", k=k), "balanced")
    measures, predicted = [], []
    for variant, of, rows in (("as is", study, None), ("balanced", after, train)):
        measures.append(_measures(of, variant, features, rows, trees=trees, **params))
        model = of.forest(features, rows, trees=trees, **params)
        predicted.append(of.predictions(model).select(F.lit(variant).alias("variant"), F.col(of.key).cast("string").alias(of.key),
                                                      "actual", "predicted"))
    return append_tables(measures), append_tables(predicted)


def ablation(table: DataFrame, features: Sequence[str], drop_sets: Mapping[str, Sequence[str]], **params) -> DataFrame:
    study = Study(table, features)
    return ablate(study.train, study.test, study.features, study.label, drop_sets, seed=study.seed, **params)


def coverage(tables, cohort: Cohort) -> DataFrame:
    """Data points per variable and source, with display names."""
    parts = coverage_parts(tables, cohort)
    return relabel_coverage(append_tables([column_coverage(df, name) for name, df in parts.items()]))


__all__ = [
    "TUNED", "Study", "ablation", "before_after_smote", "before_after_study", "coverage", "forest_scores", "forest_study",
    "task", "task_studies", "tree_report", "tuned_forest", "warning_reports",
]
