"""Projection, filtering and recoding of cohort tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cohortwarn.functions import NO_GRADE, grade_points, pass_fail, percent_value


def keep(df: DataFrame, cols: Iterable[str], strict: bool = False) -> DataFrame:
    """Keep the listed columns in table order; unknown names are ignored unless ``strict``."""
    wanted = set(cols)
    if strict and wanted - set(df.columns):
        raise ValueError(f"unknown columns: {sorted(wanted - set(df.columns))}")
    return df.select([c for c in df.columns if c in wanted])


def drop_strict(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns; an unknown name is an error, unlike ``DataFrame.drop``."""
    cols = list(cols)
    unknown = sorted(set(cols) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def tag(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has one."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def complete(df: DataFrame, cols: Iterable[str] | None = None) -> Column:
    """True where every listed column has a value."""
    tests = [~is_missing(df, c) for c in (df.columns if cols is None else cols)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def not_in(col: Column, values: Iterable[object]) -> Column:
    """Not in the list; unlike SQL ``NOT IN`` a null passes."""
    return ~F.coalesce(col.isin(*values), F.lit(False))


def exclude_values(df: DataFrame, name: str, values: Iterable[object]) -> DataFrame:
    return df.filter(not_in(F.col(name), values))


def include_values(df: DataFrame, name: str, values: Iterable[object]) -> DataFrame:
    return df.filter(F.col(name).isin(*values))


def any_of(groups: Iterable[Mapping[str, object]]) -> Column:
    """OR over groups of AND-ed equalities."""
    tests = [reduce(lambda a, b: a & b, [F.col(k) == v for k, v in g.items()]) for g in groups]
    return reduce(lambda a, b: a | b, tests)


def drop_sentinel(df: DataFrame, name: str, sentinel: str = "NULL") -> DataFrame:
    """Remove rows holding the sentinel text; nulls go too, as in SQL."""
    return df.filter(F.col(name) != sentinel)


def split_by_class(df: DataFrame, name: str, values: Iterable[object]) -> dict[object, DataFrame]:
    return {v: df.filter(F.col(name) == v) for v in values}


def parse_percent(
    df: DataFrame, name: str, sentinel: str = "NULL", complete_rows: bool = True
) -> DataFrame:
    """Percent text to integer.

    ``complete_rows`` first removes rows with any missing value; the sentinel
    rows go either way.  The cast sees only rows that passed both filters.
    """
    out = drop_missing(df) if complete_rows else df
    out = drop_sentinel(out, name, sentinel)
    # The guard repeats the filter inside the projection: the optimizer may
    # evaluate the strict cast before the filter after a join reorder.
    return out.withColumn(name, F.when(F.col(name) != sentinel, percent_value(F.col(name))))


def grades_to_points(df: DataFrame, name: str, missing: str = "drop") -> DataFrame:
    """Ordinal grades; rows without a grade are dropped (``drop``) or null (``null``)."""
    out = df.withColumn(name, grade_points(F.col(name)))
    if missing == "drop":
        return out.filter(F.col(name).isNotNull())
    if missing == "null":
        return out
    raise ValueError(f"missing must be drop or null, not {missing!r}")


# Grades removed for the two prediction tasks.
TASK_EXCLUDES = {"EF": ("A", "B", "C", "D", NO_GRADE), "PF": (NO_GRADE,)}


def build_task(df: DataFrame, exclude: Iterable[str], grade: str = "grade") -> DataFrame:
    """Grade exclusion, pass/fail recoding, complete rows only."""
    out = exclude_values(df, grade, exclude)
    return drop_missing(out.withColumn(grade, pass_fail(F.col(grade))))


def relabel(df: DataFrame, name: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace values by dictionary, others unchanged; a map literal, no join."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(name)), F.col(name)))
