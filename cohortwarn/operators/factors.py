"""Activity relative to the class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwarn.functions import ratio
from cohortwarn.operators.ranks import quantiles_of

# Factor name -> activity counter.
VIEW_FACTORS = {"page_view_factor": "page_views", "participation_factor": "participations"}
TARDINESS_FACTORS = {"missing_factor": "missing", "on_time_factor": "on_time", "late_factor": "late"}


def _group_stats(df: DataFrame, by: Sequence[str], stats: Mapping[tuple[str, str], str]) -> DataFrame:
    """One row per group; ``stats`` maps (column, statistic) to output name."""
    by = list(by)
    keyed = df.na.drop("any", subset=by)
    means = [F.avg(col).alias(out) for (col, stat), out in stats.items() if stat == "mean"]
    medians = {out: col for (col, stat), out in stats.items() if stat == "median"}
    if len(means) + len(medians) < len(stats):
        raise ValueError("a statistic must be mean or median")
    parts = [keyed.groupBy(*by).agg(*means)] if means else []
    if medians:
        # All columns in the same passes; every group with a row has a median row, null where it has no value.
        long = quantiles_of(keyed, by, sorted(set(medians.values())), [0.5])
        parts.append(long.groupBy(*by).agg(*[
            F.max(F.when(F.col("variable") == col, F.col("value"))).alias(out) for out, col in medians.items()]))
    return reduce(lambda a, b: a.join(b, by, "full"), parts)


def group_stat(
    df: DataFrame, by: Sequence[str], cols: Mapping[str, str], stat: str = "median"
) -> DataFrame:
    """Class statistic on every row; ``cols`` maps output name to column.

    Written as an aggregation joined back, not as a window: a class with a third
    of all rows is combined before the shuffle and split by the skew join, where
    a window would put it into one task.  Rows without a class get null.
    """
    stats = _group_stats(df, by, {(col, stat): out for out, col in cols.items()})
    return df.join(stats, list(by), "left").select(*df.columns, *cols)


def relative_factors(
    df: DataFrame,
    by: Sequence[str],
    factors: Mapping[str, str],
    stat: str | Mapping[str, str] = "median",
    keep_stats: bool = False,
) -> DataFrame:
    """Value over class statistic for each factor; null where that is undefined."""
    chosen = {f: stat if isinstance(stat, str) else stat[f] for f in factors}
    names = {f: f"class_{chosen[f]}_{col}" for f, col in factors.items()}
    stats = _group_stats(df, by, {(col, chosen[f]): names[f] for f, col in factors.items()})
    out = df.join(stats, list(by), "left").select(
        *df.columns,
        *[ratio(F.col(col), F.col(names[f])).alias(f) for f, col in factors.items()],
        *([F.col(n) for n in names.values()] if keep_stats else []),
    )
    return out


def view_factors(df, by=("course",), stat="median", factors=VIEW_FACTORS):
    return relative_factors(df, by, factors, stat)


def tardiness_factors(df, by=("course",), stat="median", factors=TARDINESS_FACTORS):
    return relative_factors(df, by, factors, stat)


def engagement_factors(
    df: DataFrame, by: Sequence[str] = ("course",), stat: str = "median", tardiness_stat: str | None = None
) -> DataFrame:
    """All five factors from one aggregation and one join."""
    factors = {**VIEW_FACTORS, **TARDINESS_FACTORS}
    chosen = {f: (tardiness_stat or stat) if f in TARDINESS_FACTORS else stat for f in factors}
    return relative_factors(df, by, factors, chosen)
