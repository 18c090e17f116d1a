"""Grade scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grade scale, best first, and the mark for "no grade set".
GRADE_ORDER = ("A", "B", "C", "D", "E", "F")
NO_GRADE = "-"
PASS_GRADES = GRADE_ORDER[:-1]


def pass_fail(col: Column, passing: tuple[str, ...] = PASS_GRADES, label: str = "P") -> Column:
    """Passing grades become one label; everything else stays as it is."""
    return F.when(col.isin(*passing), F.lit(label)).otherwise(col)


def grade_points(col: Column) -> Column:
    """Best grade 5 down to fail 0; any other text is null."""
    top = len(GRADE_ORDER) - 1
    expr = F.lit(None).cast("int")
    for i, grade in enumerate(GRADE_ORDER):
        expr = F.when(col == grade, F.lit(top - i)).otherwise(expr)
    return expr


def grade_binary(col: Column, zero: str = "F", one: str = "E") -> Column:
    """Two-grade code; other text must itself be a number, as a strict cast demands."""
    return F.when(col == zero, F.lit(0)).when(col == one, F.lit(1)).otherwise(col.cast("int"))


def encode_label(col: Column, negative: str = "F") -> Column:
    """0 for the risk class, 1 for any other value, null stays null."""
    return F.when(col == negative, F.lit(0.0)).when(col.isNotNull(), F.lit(1.0))
