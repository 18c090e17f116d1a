"""De-duplication with a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order_by``; give a total order for a repeatable pick.

    Spark turns ``row_number() = 1`` into a group limit that also runs before
    the shuffle, so a key holding a third of the table sends one row per map task.
    A column given by name sorts missing values last: a row without a year is not the earliest.
    """
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") == 1).drop("_rn")
