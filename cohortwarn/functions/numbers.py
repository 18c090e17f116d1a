"""Numeric clean-up and hash-based pseudo-random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(col: Column) -> Column:
    """Strict ``YYYY-MM-DD`` text to timestamp: malformed text is an error."""
    return F.to_timestamp(col, "yyyy-MM-dd")


def percent_value(col: Column) -> Column:
    """``'29%'`` to 29; malformed text is an error, as in the strict source cast."""
    return F.replace(col, F.lit("%"), F.lit("")).cast("int")


def coerce_number(col: Column, dtype: str = "double") -> Column:
    return col.try_cast(dtype)


def strict_int(col: Column) -> Column:
    return col.cast("int")


def finite_or_null(col: Column) -> Column:
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def ratio(num: Column, den: Column) -> Column:
    """Division that is null where the divisor is zero or the result is not finite."""
    return finite_or_null(F.try_divide(num.cast("double"), den.cast("double")))


def hash_hex(seed: int | str | Column, *cols: Column) -> Column:
    """md5 over seed and key text: the same on every engine, partitioning and run."""
    text = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", text, *[c.cast("string") for c in cols]))


def hash_unit(seed: int | str | Column, *cols: Column) -> Column:
    """A repeatable number in [0, 1) from the first 32 bits of :func:`hash_hex`."""
    return F.conv(F.substring(hash_hex(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
