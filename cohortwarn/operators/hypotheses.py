"""Test statistics from group aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortwarn.functions import ratio
from cohortwarn.operators.ranks import quantiles


def _upper_tail(x: float, dof: int) -> float:
    """Survival function of the chi-squared law for a whole number of degrees of freedom."""
    if x is None or math.isnan(x):
        return math.nan
    half, a = x / 2, 0.5 if dof % 2 else 1.0
    tail = math.erfc(math.sqrt(half)) if dof % 2 else math.exp(-half)
    while a < dof / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half > 0 else 0.0
        a += 1
    return tail


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # The fraction 1 / (1 + d1 / (1 + d2 / ...)) is evaluated from the front; ``tiny`` stands for a zero.
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        value *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1)


def f_tail(w: float | None, between: float, within: float) -> float:
    """Survival function of the F law."""
    if w is None or math.isnan(w) or between <= 0 or within <= 0:
        return math.nan
    return _beta_share(within / (within + between * w), within / 2, between / 2)


@F.pandas_udf(DoubleType())
def _f_value(w: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*x) for x in zip(w, between, within, strict=True)])


@F.pandas_udf(DoubleType())
def _p_value(score: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_upper_tail(x, int(d)) for x, d in zip(score, dof, strict=True)])


def chi2_scores(df: DataFrame, features: Sequence[str], label: str, k: int | None = None) -> DataFrame:
    """Feature scores for non-negative features, highest first.

    Per feature: class sums against the sums expected from class shares.  Rows
    are read once; everything after works on one row per class and feature.
    The p-values run in Python on one row per feature.
    """
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in features])
    cells = sums.select("_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("observed")) for c in features])))
    each = Window.partitionBy("feature")
    expected = F.sum("observed").over(each) * F.col("_n") / F.sum("_n").over(each)
    scored = (
        cells.withColumn("expected", expected)
        .groupBy("feature")
        .agg(F.sum(ratio((F.col("observed") - F.col("expected")) ** 2, F.col("expected"))).alias("score"),
             (F.count(F.lit(1)) - 1).cast("int").alias("dof"))
    )
    ranked = scored.orderBy(F.desc_nulls_last("score"), "feature")
    ranked = ranked if k is None else ranked.limit(k)
    return ranked.withColumn("p_value", _p_value("score", "dof"))


def levene(df: DataFrame, col: str, by: str) -> DataFrame:
    """Levene's W around group medians, with its two degrees of freedom and the p-value.

    The median comes from :func:`quantiles`; the rest is a mean and a spread of
    absolute deviations per class, combined over one row per class.  The p-value is
    the upper tail of the F law, worked out in Python on the one row.
    """
    rows = df.select(by, F.col(col).cast("double").alias("v")).na.drop("any")
    centres = quantiles(rows, [by], "v", [0.5]).select(by, F.col("value").alias("centre"))
    z = F.abs(F.col("v") - F.col("centre"))
    groups = rows.join(centres, by).groupBy(by).agg(
        F.count(z).alias("n"), F.avg(z).alias("m"), (F.var_pop(z) * F.count(z)).alias("ss"))
    everything = Window.partitionBy()
    overall = F.sum(F.col("n") * F.col("m")).over(everything) / F.sum("n").over(everything)
    return (
        groups.withColumn("d", F.col("n") * (F.col("m") - overall) ** 2)
        .agg(
            ratio((F.sum("n") - F.count(F.lit(1))) * F.sum("d"), (F.count(F.lit(1)) - 1) * F.sum("ss")).alias("w"),
            (F.count(F.lit(1)) - 1).alias("dof_between"),
            (F.sum("n") - F.count(F.lit(1))).alias("dof_within"),
        )
        .withColumn("p_value", _f_value("w", "dof_between", "dof_within"))
    )
