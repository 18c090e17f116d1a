"""Trees and forests on Spark ML, and what is read off them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwarn.functions import hash_unit
from cohortwarn.operators.evaluate import accuracy
from cohortwarn.operators.ranks import assign_folds, hash_rank
from cohortwarn.session import new_folder, stable

MAX_DEPTH = 30
FEATURES, LABEL = "features", "label"
# Trees of an out-of-bag score that are fitted and vote in one plan.
TREES_PER_PASS = 10
# From this depth on a fit keeps the node of each row, instead of sending the growing trees to every task of every level.
CACHE_DEPTH = 10
# Says that the label has two classes, which saves every fit a pass to count them.
_TWO_CLASSES = {"ml_attr": {"name": LABEL, "type": "nominal", "vals": ["0", "1"]}}


def _label(name: str) -> Column:
    return F.col(name).cast("double").alias(LABEL, metadata=_TWO_CLASSES)


def assembler(features: Sequence[str], output: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def assemble(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature vector and label by name; a missing value is an error."""
    rows = assembler(features).transform(df)
    return rows.select(*[c for c in rows.columns if c != LABEL], _label(label))


def _depth(max_depth: int | None) -> int:
    """``None`` is as deep as Spark's trees go; a greater depth is an error, not a silent cut."""
    if max_depth is None:
        return MAX_DEPTH
    if max_depth > MAX_DEPTH:
        raise ValueError(f"trees go {MAX_DEPTH} levels deep at most, not {max_depth}")
    return max_depth


def _subset(max_features: str | float | int | None) -> str:
    """Per-split feature subset; a share or a count is passed on as text."""
    if max_features is None:
        return "all"
    return {"auto": "sqrt"}.get(max_features, str(max_features))


def tree_classifier(
    max_depth: int | None = 5, min_leaf: int = 1, max_bins: int = 128, seed: int = 42
) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        featuresCol=FEATURES, labelCol=LABEL, impurity="gini", maxDepth=_depth(max_depth),
        minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed, cacheNodeIds=_depth(max_depth) >= CACHE_DEPTH)


def forest_classifier(
    trees: int = 100,
    max_depth: int | None = 5,
    max_features: str | float | int | None = "sqrt",
    min_leaf: int = 1,
    max_bins: int = 128,
    seed: int = 42,
    bootstrap: bool = True,
) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, impurity="gini", numTrees=trees, maxDepth=_depth(max_depth),
        featureSubsetStrategy=_subset(max_features), minInstancesPerNode=min_leaf, maxBins=max_bins,
        seed=seed, bootstrap=bootstrap, cacheNodeIds=_depth(max_depth) >= CACHE_DEPTH)


def _fit(stage, df: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    rows = df.select(*[c for c in features if c != LABEL], _label(label))
    return Pipeline(stages=[assembler(features), stage]).fit(rows)


def fit_tree(df: DataFrame, features: Sequence[str], label: str, **params) -> PipelineModel:
    return _fit(tree_classifier(**params), df, features, label)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, **params) -> PipelineModel:
    return _fit(forest_classifier(**params), df, features, label)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input rows with ``prediction``; the model's working columns are dropped."""
    return model.transform(df).drop(FEATURES, "rawPrediction", "probability")


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def importances(model: PipelineModel, spark) -> DataFrame:
    """Impurity importance per feature, highest first."""
    names = feature_names(model)
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def tree_rules(model: PipelineModel, spark) -> DataFrame:
    """The fitted tree or forest as numbered text lines with feature names."""
    text = model.stages[-1].toDebugString
    for i, name in reversed(list(enumerate(feature_names(model)))):
        text = text.replace(f"feature {i} ", f"{name} ")
    lines = [(i, line) for i, line in enumerate(text.splitlines()) if line.strip()]
    return spark.createDataFrame(lines, "line_no int, rule string")


def bag_bounds() -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2, ... until they are 1 to double precision."""
    term, upto, bounds = math.exp(-1), 0.0, []
    for n in range(1, 13):
        upto += term
        bounds.append(upto)
        term /= n
    return bounds


def bag_count(seed: int | str, tree: int, key: Column) -> Column:
    """How often a row is in the bag of a tree: Poisson(1) by inverting a hash number."""
    u = hash_unit(f"{seed}bag{tree}", key)
    return sum((F.when(u >= F.lit(b), 1.0).otherwise(0.0) for b in bag_bounds()), F.lit(0.0))


def bag_array(seed: int | str, trees: int, key: Column) -> Column:
    """:func:`bag_count` of every tree in one array, an expression that does not grow with the number of trees."""
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    units = F.transform(numbers, lambda t: hash_unit(F.concat(F.lit(f"{seed}bag"), t.cast("string")), key))

    def count(u: Column) -> Column:
        # The first bound above the number; most numbers are below one of the first.
        first, *rest = bag_bounds()
        n = F.when(u < F.lit(first), F.lit(0))
        for i, b in enumerate(rest, 1):
            n = n.when(u < F.lit(b), F.lit(i))
        return n.otherwise(F.lit(len(rest) + 1)).cast("byte")

    return F.transform(units, count)


def oob_predictions(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    trees: int = 20,
    seed: int = 42,
    parallelism: int = 4,
    **params,
) -> DataFrame:
    """Mean class-1 probability per row over the trees that did not see it: ``key, label, prediction``.

    Spark's forest does not tell which rows a tree was given, so each tree is
    fitted on weights we choose.  The bags are drawn once and kept with the rows.  The
    votes are added up inside the row, ``TREES_PER_PASS`` trees in a pass, so no plan and
    no memory of the driver grows with the number of trees; nothing is shuffled.  Rows
    in every bag have no vote and are left out.
    """
    rows = assemble(df.select(key, *features, label), features, label).select(key, FEATURES, LABEL)
    rows = stable(rows.withColumn("_bags", bag_array(seed, trees, F.col(key))))

    def fit(t: int):
        one = forest_classifier(trees=1, bootstrap=False, seed=seed + t, **params).setWeightCol("_w")
        model = one.fit(rows.withColumn("_w", F.get("_bags", F.lit(t)).cast("double")).filter(F.col("_w") > 0))
        return model.setProbabilityCol(f"_p{t}").setPredictionCol("").setRawPredictionCol("")

    scored = rows.withColumn("_for", F.lit(0.0))
    with ThreadPool(parallelism) as pool:
        for start in range(0, trees, TREES_PER_PASS):
            numbers = range(start, min(trees, start + TREES_PER_PASS))
            for model in pool.map(fit, numbers, chunksize=1):
                scored = model.transform(scored)
            shares = [(F.get("_bags", F.lit(t)) == 0).cast("double") * vector_to_array(f"_p{t}")[1] for t in numbers]
            scored = scored.select(key, FEATURES, LABEL, "_bags", sum(shares, F.col("_for")).alias("_for"))
            if numbers.stop < trees:
                scored = stable(scored, "votes")
    scored = scored.withColumn("_votes", F.size(F.filter("_bags", lambda n: n == 0)))
    prediction = (F.col("_for") * 2 > F.col("_votes")).cast("double")
    return scored.filter(F.col("_votes") > 0).select(key, LABEL, prediction.alias("prediction"))


def oob_score(df: DataFrame, key: str, features: Sequence[str], label: str, **params) -> DataFrame:
    return accuracy(oob_predictions(df, key, features, label, **params), LABEL, "prediction", "oob_accuracy")


def rotation(seed: int, repeat: int, n: int) -> int:
    """By how many ranks the rows of a repeat are shifted: from 1 to n - 1."""
    u = int(hashlib.md5(f"{seed}turn|{repeat}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return int(u * max(1, n - 1)) + 1


def permutation_importance(
    model: PipelineModel, df: DataFrame, key: str, label: str, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Mean and spread of the accuracy lost when one feature is shuffled.

    The rows are ranked once, in hash order of the key; in each repeat a row's partner is the row some ranks further on, round
    the end, the number of ranks being a hash of the repeat.  One join serves all repeats and features: the row keeps its values
    and, per feature, is scored once with the partner's value in its place.
    """
    names, tree = feature_names(model), model.stages[-1]
    rows = stable(hash_rank(df.select(key, *names, label), [key], f"{seed}p", name="_rank"), "ranked")
    n = rows.count()
    turns = F.array(*[F.struct(F.lit(r).alias("_turn"), F.lit(rotation(seed, r, n)).cast("long").alias("_by")) for r in range(repeats)])
    others = rows.select("_rank", *[F.col(x).alias(f"_o_{x}") for x in names]).select("*", F.inline(turns))
    others = others.withColumn("_rank", F.pmod(F.col("_rank") - F.col("_by"), F.lit(max(1, n)))).drop("_by")
    pairs, hits = rows.join(others, "_rank"), []
    for i, name in enumerate([None, *names]):
        inputs = [f"_o_{x}" if x == name else x for x in names]
        scorer = tree.copy().setFeaturesCol("_f").setPredictionCol(f"_p{i}")
        scorer.setProbabilityCol("").setRawPredictionCol("")
        pairs = scorer.transform(assembler(inputs, "_f").transform(pairs)).drop("_f")
        hits.append(F.avg((F.col(f"_p{i}") == F.col(label)).cast("double")).alias(f"a{i}"))
    drops = pairs.groupBy("_turn").agg(*hits).select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("feature"), (F.col("a0") - F.col(f"a{i}")).alias("drop")) for i, x in enumerate(names, 1)])))
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def leaf_rules(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """The leaves of a fitted tree as a table: leaf, depth, rule, prediction, and the rows of ``df`` that fall into each.

    ``rule`` is a condition in SQL over the features, so it can be put into ``expr`` or ``where``; the rules of a tree
    exclude one another and cover every row.  ``n``, ``n_0`` and ``n_1`` count rows by class.  The nodes are read from
    the saved model; there are at most 2 ** (depth + 1) of them.
    """
    spark, tree, names = df.sparkSession, model.stages[-1], feature_names(model)
    path = new_folder(spark, "tree")
    tree.save(path)
    nodes = {r.id: r for r in spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", "split").collect()}
    rows = []

    def walk(at: int, conditions: list[str]) -> None:
        node = nodes[at]
        if node.leftChild < 0:
            rows.append((float(len(rows)), len(conditions), " and ".join(conditions) or "true", node.prediction))
            return
        name, cut = names[node.split.featureIndex], node.split.leftCategoriesOrThreshold[0]
        walk(node.leftChild, [*conditions, f"`{name}` <= {cut!r}D"])
        walk(node.rightChild, [*conditions, f"`{name}` > {cut!r}D"])

    walk(0, [])
    table = spark.createDataFrame(rows, "_leaf double, depth int, rule string, prediction double")
    scored = tree.copy().setLeafCol("_leaf").transform(assembler(names).transform(df.select(*names, F.col(label).alias("_y"))))
    counts = scored.groupBy("_leaf").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y") == 0).alias("n_0"), F.count_if(F.col("_y") == 1).alias("n_1"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_0", "n_1")}
    return table.join(counts, "_leaf", "left").select(
        F.col("_leaf").cast("int").alias("leaf"), "depth", "rule", "prediction", *zero.values())


def param_grid(**choices: Iterable) -> list[dict]:
    """All combinations; values as in :func:`forest_classifier`."""
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def grid_search(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    grid: Sequence[Mapping[str, object]],
    folds: int = 4,
    seed: int = 42,
    parallelism: int = 4,
    bootstrap: bool = True,
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated accuracy of each setting; the best is refitted on all rows.

    Folds are stratified by label.  Returns the model and one row per setting.
    """
    rows = assign_folds(df.select(key, *features, label), key=[key], label=label, folds=folds, seed=seed)
    rows = stable(assemble(rows, features, label).select(FEATURES, LABEL, "fold"))
    forest = forest_classifier(seed=seed, bootstrap=bootstrap)
    setters = {
        "trees": (forest.numTrees, int), "max_depth": (forest.maxDepth, _depth),
        "max_features": (forest.featureSubsetStrategy, _subset), "min_leaf": (forest.minInstancesPerNode, int),
    }
    maps = [{setters[k][0]: setters[k][1](v) for k, v in g.items()} for g in grid]
    for settings in maps:
        settings[forest.cacheNodeIds] = settings.get(forest.maxDepth, forest.getMaxDepth()) >= CACHE_DEPTH
    evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    for i in range(folds):
        if not sizes.get(i):
            raise ValueError(f"The validation data at fold {i} is empty.")
        if sum(sizes.values()) == sizes[i]:
            raise ValueError(f"The training data at fold {i} is empty.")

    def score(at: tuple[int, int]) -> float:
        i, setting = at
        model = forest.fit(rows.filter(F.col("fold") != i), maps[setting])
        return evaluator.evaluate(model.transform(rows.filter(F.col("fold") == i)))

    # Not Spark's CrossValidator: its threads share one set of local properties, among them the number of the running
    # query, which one thread can clear while another reads it.
    with ThreadPool(parallelism) as pool:
        scores = pool.map(score, product(range(folds), range(len(maps))), chunksize=1)
    means = np.mean(np.reshape(scores, (folds, len(maps))), axis=0)
    best = forest.fit(rows, maps[int(np.argmax(means))])
    results = [(i, str(dict(g)), float(m)) for i, (g, m) in enumerate(zip(grid, means, strict=True))]
    table = df.sparkSession.createDataFrame(results, "setting int, params string, accuracy double")
    return PipelineModel([assembler(features), best]), table.orderBy(F.desc("accuracy"), "setting")


def ablate(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    drop_sets: Mapping[str, Sequence[str]],
    **params,
) -> DataFrame:
    """Test accuracy of forests refitted without each named set of features."""
    out = None
    for name, gone in drop_sets.items():
        left = [f for f in features if f not in set(gone)]
        model = fit_forest(train, left, label, **params)
        row = accuracy(predict(model, test), label).select(
            F.lit(name).alias("variant"), F.lit(len(left)).alias("n_features"), "n", "accuracy")
        out = row if out is None else out.unionByName(row)
    return out
