"""Course-code predicates.

Source systems compare codes without regard to case or trailing blanks.  The
default predicates do the same through ``lower(rtrim(code))``, which no file
format can push down.  Tables that hold one spelling per code (normalise once
when the table is written, see :func:`canonical_code`) pass ``exact=True`` and
get an equality or prefix test that reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_code(col: Column) -> Column:
    return F.lower(F.rtrim(col))


def course_is(col: Column, code: str, exact: bool = False) -> Column:
    if exact:
        return col == F.lit(code)
    return canonical_code(col) == F.lit(code.rstrip().lower())


def course_startswith(col: Column, prefix: str, exact: bool = False) -> Column:
    if exact:
        return col.startswith(prefix)
    return F.lower(col).startswith(prefix.lower())


def course_prefix(col: Column, n: int = 8) -> Column:
    """The course part of a class-level code."""
    return F.substring(col, 1, n)
