"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of the contracts, x20 and x09 to x0D, as a Java character class.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
# Code points with the Unicode property White_Space.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def once(key: str, make: Callable):
    """``make()``, kept for the life of this Python process.

    The functions of this package travel to the executors by value, with fresh globals in every task.  What takes
    long to build (vocabularies, automata) is kept in a module of its own, so a reused worker builds it once.
    """
    kept = sys.modules.setdefault("cohortwarn_kept", types.ModuleType("cohortwarn_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def slices(batches: Iterator, rows: int = 500, size: int = 1 << 20) -> Iterator:
    """Arrow batches in pieces of a few rows and some ``size`` bytes of text, so the Python objects of only that many
    texts exist at once.  A longer text is a piece of its own.  Sizes are those of the top-level text columns."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
                sizes += at - at[:1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(sizes, sizes[first] + size, "right")) - 1
            last = min(max(first + 1, last), first + rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that learning leaves out: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def add_columns(docs: DataFrame, inputs: list[Column], fields: str, make: Callable) -> DataFrame:
    """All columns of ``docs`` plus computed ones, in one pass over Arrow batches without a shuffle.

    ``make()`` is called once for each partition and returns a function from an Arrow batch of ``inputs`` to a list
    of arrays, one for each of ``fields``.  Columns of ``docs`` with the names of new columns are replaced.
    """
    new = T._parse_datatype_string(fields)
    others = [c for c in docs.columns if c not in new.names]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    packed = docs.select(row.alias("_row"), *[x.alias(f"_in{i}") for i, x in enumerate(inputs)])
    schema = T.StructType([packed.schema["_row"], *new.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in slices(batches):
            arrays = compute(batch.select(batch.schema.names[1:]))
            typed = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *typed], names=names)

    names, kinds = ["_row", *new.names], [arrow_type(f.dataType) for f in new.fields]
    return packed.mapInArrow(work, schema).select(*[F.col("_row").getField(c).alias(c) for c in others], *new.names)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
