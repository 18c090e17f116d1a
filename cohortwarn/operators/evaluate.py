"""Scores of predictions; everything is read off one count per (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwarn.functions import GRADE_ORDER, NO_GRADE, encode_label, pass_fail, ratio
from cohortwarn.operators.clean import drop_missing, exclude_values
from cohortwarn.operators.summary import crosstab


def accuracy(
    df: DataFrame, label: str = "label", prediction: str = "prediction", name: str = "accuracy"
) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.count(hit).alias("n"), F.avg(hit).alias(name))


def confusion(
    df: DataFrame,
    values: Sequence[object] = (0.0, 1.0),
    names: Sequence[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """True classes down, predicted classes across, zero filled."""
    return crosstab(df, label, prediction, values, names or [f"predicted_{v:g}" for v in values])


def _zero_if_none(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Undefined ratios are 0.  The predictions are read once; the rest works on
    one row per class.
    """
    cells = df.groupBy(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")),
    )
    per = cells.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = _zero_if_none(ratio(F.col("hits"), F.col("predicted")))
    recall = _zero_if_none(ratio(F.col("hits"), F.col("support")))
    per = per.select("class", precision.alias("precision"), recall.alias("recall"), "support", "hits")
    f1 = _zero_if_none(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    per = per.withColumn("f1", f1)
    scores = ("precision", "recall", "f1")
    total = F.sum("support")

    def row(kind, values):
        return F.struct(F.lit(kind).alias("class"), *[values[s].alias(s) for s in scores], total.alias("support"))

    none = F.lit(None).cast("double")
    summary = per.agg(
        F.collect_list(F.struct("class", *scores, "support")).alias("classes"),
        F.array(
            row("accuracy", {"precision": none, "recall": none, "f1": ratio(F.sum("hits"), total)}),
            row("macro avg", {s: F.avg(s) for s in scores}),
            row("weighted avg", {s: ratio(F.sum(F.col(s) * F.col("support")), total) for s in scores}),
        ).alias("means"),
    )
    return summary.select(F.inline(F.concat("classes", "means")))


def prediction_table(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.select(key, F.col(label).alias("actual"), F.col(prediction).alias("predicted"))


def higher_grades(df: DataFrame, grade: str = "grade") -> DataFrame:
    """Complete rows above the pass limit, with their grade, label and pass mark."""
    rows = drop_missing(exclude_values(df, grade, [*GRADE_ORDER[-2:], NO_GRADE]))
    return rows.withColumn("label", encode_label(pass_fail(F.col(grade))))


def higher_grade_check(model: PipelineModel, df: DataFrame, grade: str = "grade") -> DataFrame:
    """Students above the limit, per grade: how many the model would have flagged."""
    scored = model.transform(higher_grades(df, grade))
    return crosstab(scored, grade, "prediction", [0.0, 1.0], ["F", "P"])
