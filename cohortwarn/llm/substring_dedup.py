"""Substring deduplication by content-defined chunks: repeated passages of more than 50 words, by their true length.

A gear hash rolls over the code points of a text: each step shifts the hash by one bit and adds a random number for the
code point; with 16 bits it depends on the last 16 code points only.  A chunk ends where the hash is the smallest of
``SPAN`` places in a row (the last of equal ones), so no chunk is longer than that, no cut depends on a position, and after
an insertion the cuts are soon the same again, in repetitive text too.

A window is the text of ``PASSAGE`` words, with the white space between them.  It holds several whole chunks whose cuts
follow from its own code points; of every ``CHUNKS`` in a row (of all, where there are fewer) those with the smallest
hash are its anchor, so equal windows have equal anchors wherever they stand, and a text has few different anchors.  One
chunk is often a common word or two, which many texts share; a few in a row seldom are shared by chance.  Anchors are
counted over documents.  From shared chunks the texts around them are compared: windows that follow one another with the
same anchor are a run, which is digested (128 bits).  An anchor that always comes in the same run makes later runs
copies as they are; of one that comes in different runs all windows are digested, one for each word, and equal windows
meet.  Of these the first, by doc_id, stays; the others are copies.  The union of overlapping copies is a span, so nothing
is lost at its edges or to a passage whose parts also stand elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwarn.llm.common import add_columns, slices
from cohortwarn.session import stable

#: Words of the shortest passage; places of which the smallest hash ends a chunk; code points that a hash depends on;
#: chunks in a row that are an anchor.
PASSAGE, SPAN, MEMORY, CHUNKS = 51, 24, 16, 4
_SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """A random 16-bit number for each code point (the finaliser of a 32-bit hash, upper half)."""
    x = codes * np.uint32(0x9E3779B1) + np.uint32(1)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return ((x ^ (x >> np.uint32(16))) >> np.uint32(16)).astype(np.uint16)


def rolling(codes: np.ndarray) -> np.ndarray:
    """The hash after each code point, h = 2 h + gear, for all at once: sums over 1, 2, 4, 8, 16 code points."""
    h = gear(codes)
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint16(k) if len(h) > k else 0
        h = h + shifted
    return h


def cut_at(codes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each run of ``span`` places the place with the smallest hash (the last of equal ones); these never decrease.

    A chunk ends behind every such place.
    """
    n = len(codes)
    if n < span:
        return np.zeros(0, np.int64)
    # Hash and place in one number; the later place is the smaller.
    low = rolling(codes).astype(np.uint64) << np.uint64(40) | (np.uint64((1 << 40) - 1) - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n - span + 1], low[span - size : span - size + n - span + 1])
    return ((1 << 40) - 1) - (low & np.uint64((1 << 40) - 1)).astype(np.int64)


def smallest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest of the values from ``first`` on and before ``last``, for many stretches (none is empty)."""
    level = np.frexp((last - first).astype(float))[1] - 1  # 2 ** level is the greatest power in the stretch
    out, table = np.empty(len(first), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[: -(1 << k - 1)], table[1 << k - 1 :])
        at = level == k
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k)])
    return out


class Windows:
    """The windows of ``words`` words of one text after the other."""

    def __init__(self, words: int = PASSAGE):
        self.words = words
        # A window of so many words of one letter has to hold a whole chunk.
        self.span = max(1, min(SPAN, (2 * words - 1 - MEMORY) // 3))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            base, n = 0x9E3779B97F4A7C15, max(n, 2 * len(self.powers))
            for name, factor in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
                factors = np.full(n, factor, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (code points) and anchor of each window of a text in UTF-32."""
        codes = np.frombuffer(data, "<u4")
        letter = ~np.isin(codes, _SPACE)
        starts = np.flatnonzero(letter & np.r_[True, ~letter[:-1]])
        ends = np.flatnonzero(letter & np.r_[~letter[1:], True]) + 1
        if len(starts) < self.words:
            return (np.zeros(0, np.int64),) * 3
        self.grow(len(codes) + 1)
        # Sums of hashed code points times powers give the hash of any stretch of the text.
        sums = np.r_[np.uint64(0), np.cumsum(_mixed(codes.astype(np.uint64)) * self.powers[: len(codes)], dtype=np.uint64)]
        last = len(starts) - self.words + 1
        a, b = starts[:last], ends[self.words - 1 :]
        if self.span < 2:  # too few words to be sure of a chunk: the whole window is its anchor
            return a, b, _mixed((sums[b] - sums[a]) * self.inverse[a]).view(np.int64)
        places = cut_at(codes, self.span)
        number = np.r_[0, np.cumsum(places[1:] != places[:-1])]  # of the cut that a run of places gives
        cuts = places[np.r_[True, places[1:] != places[:-1]]] + 1
        # Only cuts that follow from the window's own code points, and as many chunks in a row as lie between them.
        first, last = number[a + MEMORY - 1], number[b - self.span]
        joined, out = np.minimum(last - first, CHUNKS), np.empty(len(a), np.uint64)
        for k in np.unique(joined).tolist():
            at = np.flatnonzero(joined == k)
            hashes = _mixed((sums[cuts[k:]] - sums[cuts[:-k]]) * self.inverse[cuts[:-k]])
            out[at] = smallest(hashes, first[at], last[at] - k + 1)
        return a, b, out.view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def passages(docs: DataFrame, words: int = PASSAGE, within: bool = False) -> DataFrame:
    """One row for each repeated span of at least ``words`` words: doc_id, start, end (code points), words, keep_doc_id.

    A span starts and ends with whole words and is covered by windows of ``words`` words that stand, character by
    character, in a document with a smaller doc_id (``within``: or at an earlier place of the same document).
    ``keep_doc_id`` is the first document with the span's first window.  Null texts and documents without an id have no
    spans, nor has an empty table; repeated rows count as one document.  Only doc_id and text are read.
    """
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(words)
        for batch in slices(batches, 200):
            columns: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode("utf-32-le", "surrogatepass")
                a, b, anchors = windows.of(data)
                if not len(anchors):
                    continue
                first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
                last = np.r_[first[1:], len(anchors)] - 1
                starts, ends, view = a[first].tolist(), b[last].tolist(), memoryview(data)
                digests = [xxhash.xxh3_128_intdigest(view[4 * x : 4 * y]) for x, y in zip(starts, ends, strict=True)]
                for column, values in zip(columns, (
                        [doc_id] * len(first), anchors[first].tolist(), [(d >> 64) - (1 << 63) for d in digests],
                        [(d & (1 << 64) - 1) - (1 << 63) for d in digests], first.tolist(), last.tolist(), starts, ends),
                        strict=True):
                    column += values
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "anchor", "hi", "lo", "at", "last", "start", "end"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(words)
        for batch in slices(batches, 50):
            ids, at, starts, ends, hi, lo = [], [], [], [], [], []
            for doc_id, text, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode("utf-32-le", "surrogatepass")
                a, b, anchors = windows.of(data)
                chosen = np.flatnonzero(np.isin(anchors, np.array(known, np.int64)))
                a, b, view = a[chosen].tolist(), b[chosen].tolist(), memoryview(data)
                digests = [xxhash.xxh3_128_intdigest(view[4 * x : 4 * y]) for x, y in zip(a, b, strict=True)]
                ids += [doc_id] * len(a)
                at += chosen.tolist()
                starts += a
                ends += b
                hi += [(d >> 64) - (1 << 63) for d in digests]
                lo += [(d & (1 << 64) - 1) - (1 << 63) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(starts, pa.int32()),
                 pa.array(ends, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())],
                names=["doc_id", "at", "start", "end", "hi", "lo"])

    anchors = stable(rows.mapInArrow(
        find_runs, "doc_id long, anchor long, hi long, lo long, at int, last int, start int, end int"), "anchors")
    # Counts are written before they are joined, so that a hot anchor or window is split by the skew join.
    again = anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("hi").alias("hi"),
        F.max("hi").alias("hi2"), F.min("lo").alias("lo"), F.max("lo").alias("lo2"),
        F.sum(F.col("last") - F.col("at") + 1).alias("n"))
    again = again.filter("n > 1" if within else "first_doc < last_doc").select(
        "anchor", "first_doc", F.lit(False).alias("same") if within else F.expr("hi = hi2 and lo = lo2").alias("same"))
    shared = stable(anchors.drop("hi", "lo").join(stable(again, "shared-anchors"), "anchor"), "shared")
    # Where all windows of an anchor stand in equal runs, the runs are copied as they are.
    whole = shared.filter("same and doc_id > first_doc").select("doc_id", "at", "last", "start", "end", "first_doc")
    known = shared.filter("not same").groupBy("doc_id").agg(F.collect_set("anchor").alias("known"))
    windows = stable(rows.join(known, "doc_id").select("doc_id", "text", "known").mapInArrow(
        digest, "doc_id long, at int, start int, end int, hi long, lo long"), "windows")
    first = windows.groupBy("hi", "lo").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    first = stable(first.filter("n > 1" if within else "first_doc < last_doc").select("hi", "lo", "first_doc"), "first")
    copies = windows.join(first, ["hi", "lo"])
    if within:
        places = copies.filter("doc_id = first_doc").groupBy("hi", "lo").agg(F.min("start").alias("first_start"))
        copies = copies.join(places, ["hi", "lo"]).filter("doc_id > first_doc or start > first_start")
    else:
        copies = copies.filter("doc_id > first_doc")
    copies = copies.select("doc_id", "at", F.col("at").alias("last"), "start", "end", "first_doc").unionByName(whole)
    by_place = Window.partitionBy("doc_id").orderBy("start", "end", "at", "first_doc")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = copies.withColumn("begins", F.coalesce(before < F.col("start"), F.lit(True)).cast("int")).withColumn(
        "run", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("last") - F.min("at") + words).cast("long").alias("words"),
        F.min(F.struct("start", "first_doc"))["first_doc"].alias("keep_doc_id")).drop("run")


def without_repeats(docs: DataFrame, words: int = PASSAGE, within: bool = False) -> DataFrame:
    """All columns of ``docs``, with repeated spans cut out of ``text``."""
    spans = passages(docs, words, within).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")).withColumnRenamed("doc_id", "_id")
    both = docs.join(stable(spans, "spans"), F.col("doc_id") == F.col("_id"), "left").drop("_id")

    def make():
        def cut(text: str | None, spans: list | None) -> str | None:
            if text is None or not spans:
                return text
            ends = [0, *[s["end"] for s in spans]]
            starts = [*[s["start"] for s in spans], len(text)]
            return "".join([text[a:b] for a, b in zip(ends, starts, strict=True)])

        return lambda batch: [[cut(*x) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]]

    return add_columns(both, [F.col("text"), F.col("_spans")], "text string", make).select(
        *[F.col(f"`{c}`") for c in docs.columns])
