"""Table scans and the parametrised reads built on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortwarn.functions import course_is, course_startswith


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table."""
    return spark.table(name)


def load_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A relational table read in parallel ranges of ``partition_column``.

    ``options`` carries url, driver and credentials from the caller's
    configuration; none are kept here.  Filters and projections applied to the
    result are pushed into the database by Spark.
    """
    opts = jdbc_options(options, table, partition_column, bounds, partitions, fetch_size)
    return spark.read.format("jdbc").options(**opts).load()


def jdbc_options(options, table, partition_column=None, bounds=None, partitions=None, fetch_size=10_000):
    """The reader options of one parallel scan."""
    out = {**options, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column is None:
        if bounds or partitions:
            raise ValueError("bounds and partitions need a partition_column")
        return out
    if bounds is None or partitions is None:
        raise ValueError("partition_column needs bounds and partitions")
    out |= {
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }
    return out


def describe_columns(df: DataFrame) -> DataFrame:
    """Name, type and nullability per column, in table order."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def on_month_day(df: DataFrame, day: str, month_day: str) -> Column:
    """Rows of one calendar day in any year.

    On text dates this is a suffix test that Parquet can evaluate; on date and
    timestamp columns it compares month and day.
    """
    if isinstance(df.schema[day].dataType, StringType):
        return F.col(day).endswith(month_day)
    month, dom = (int(x) for x in month_day.split("-"))
    return (F.month(day) == month) & (F.dayofmonth(day) == dom)


def read_cohort(df: DataFrame, course: str, column: str = "course", exact: bool = False) -> DataFrame:
    return df.filter(course_is(F.col(column), course, exact))


def read_snapshot(
    df: DataFrame,
    prefix: str,
    month_day: str,
    column: str = "course",
    day: str = "snapshot_date",
    exact: bool = False,
) -> DataFrame:
    """Activity rows of all classes of a course on one day of the year, over all years."""
    return df.filter(course_startswith(F.col(column), prefix, exact) & on_month_day(df, day, month_day))
