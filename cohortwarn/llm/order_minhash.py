"""Document fingerprints by Order MinHash, which notices edits that a set of shingles does not.

The k-mers of a text (k code points) are numbered by occurrence, so the second "abcde" differs from the first.  Each
of ``HASHES`` hash functions selects the ``TUPLE`` numbered k-mers with the smallest values, puts them back in the
order of the text, and hashes that tuple.  The signature is the list of these hashes; the share of equal ones grows
as the edit distance falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwarn.llm.common import sha256_hex, slices, text_of
from cohortwarn.session import stable

K, TUPLE, HASHES = 5, 2, 32
BLOCK = 2048  # k-mers hashed at once
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = mix(np.arange(101, HASHES + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROWS = np.arange(HASHES)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def numbered(c: np.ndarray) -> np.ndarray:
    """A 64-bit value for each k-mer with the number of its occurrence; a text shorter than k is one k-mer."""
    if not len(c):
        return np.zeros(0, np.uint64)
    n = max(1, len(c) - K + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(K, len(c))):
        h = h * np.uint64(0x100000001B3) + c[j : j + n] + np.uint64(1)
    h = mix(h)
    order = np.argsort(h, kind="stable")
    at = np.arange(n)
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    times = np.empty(n, np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mix(h + times * np.uint64(0x9E3779B97F4A7C15))


class Smallest:
    """The ``TUPLE`` smallest values of each hash function so far, with place and k-mer."""

    def __init__(self):
        self.value = np.full((HASHES, TUPLE), MOST)
        self.place = np.full((HASHES, TUPLE), -1)
        self.kmer = np.zeros((HASHES, TUPLE), np.uint64)

    def add(self, x: np.ndarray, offset: int) -> Smallest:
        """A new one that has also seen the k-mers ``x``, the first of them at place ``offset``."""
        out = Smallest()
        values, places, kmers = [self.value], [self.place], [self.kmer]
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            h = part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
            for _ in range(min(TUPLE, len(part))):
                i = h.argmin(axis=1)
                values.append(h[_ROWS, i][:, None])
                places.append((i + (at + offset))[:, None])
                kmers.append(part[i][:, None])
                h[_ROWS, i] = MOST
        value, place, kmer = (np.concatenate(v, axis=1) for v in (values, places, kmers))
        best = np.argsort(value, axis=1, kind="stable")[:, :TUPLE]
        out.value, out.place, out.kmer = (np.take_along_axis(v, best, axis=1) for v in (value, place, kmer))
        return out

    def signature(self) -> np.ndarray:
        order = np.argsort(self.place, axis=1, kind="stable")
        tuples = np.take_along_axis(self.kmer, order, axis=1)
        h = _SHIFTS.copy()
        for j in range(TUPLE):
            h = mix(h * np.uint64(3) + tuples[:, j])
        return (h >> np.uint64(48)).astype(">u2")


def fingerprint(text: str) -> str:
    """Signature in hexadecimal, four digits for each hash function."""
    return Smallest().add(numbered(codes(text)), 0).signature().tobytes().hex()


class Document:
    """A text with its signature, ready for the signature of an edited text that shares its beginning."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.codes = doc_id, text, codes(text)
        self.cut = len(text) - len(text) // 3
        self.shared = max(0, self.cut - K + 1)  # k-mers that the end of the text has no part in
        x = numbered(self.codes)
        self.beginning = Smallest().add(x[: self.shared], 0)
        self.signature = self.beginning.add(x[self.shared :], self.shared).signature()

    def row(self, following: Document) -> tuple:
        edited = self.text[: self.cut] + following.text[: len(self.text) - self.cut]
        x = numbered(np.concatenate([self.codes[: self.cut], following.codes[: len(self.text) - self.cut]]))
        other = self.beginning.add(x[self.shared :], self.shared).signature()
        return (self.doc_id, len(self.text), sha256_hex(edited), self.signature.tobytes().hex(),
                other.tobytes().hex(), float((self.signature == other).mean()),
                float((self.signature == following.signature).mean()))


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple], part: int, kind: str, text: str | None = None) -> pa.RecordBatch:
    cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [*cols, pa.array([part] * n, pa.int64()), pa.array([text] * n, pa.string()), pa.array([kind] * n)],
        names=[*NAMES, "part", "text", "kind"])


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` with the columns ``COLUMNS``.

    The edited text has its last third (rounded down) replaced by as many first code points of the next document in
    descending order of doc_id, or all it has; after the last comes the first.  Null ids come last, rows with equal
    ids are in order of their text.  A null text counts as empty; two texts without k-mers are alike (1.0).

    Documents are dealt out by ranges of doc_id, once; a task knows the next document of all its rows but the last.
    For these, one for each task, the first document of the next range is brought in afterwards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                now = Document(doc_id, text)
                if last is not None:
                    out.append(last.row(now))
                else:
                    first = now
                last = now
            if out:
                yield _batch(out, part, "done")
        for doc, kind in ((first, "first"), (last, "last")):
            if doc is not None:
                yield _batch([(doc.doc_id, *[None] * (len(NAMES) - 1))], part, kind, doc.text)

    found = rows.mapInArrow(work, f"{COLUMNS}, part long, text string, kind string")
    found = stable(found, "order-minhash", "kind")
    done = found.filter("kind = 'done'").select(*NAMES)
    # A row for each task; the window sees numbers only.
    firsts = found.filter("kind = 'first'").select("part", F.col("doc_id").alias("next_id"), F.col("text").alias("next"))
    order = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy()))
                              .alias("next_part"))
    edges = found.filter("kind = 'last'").select("part", "doc_id", "text").join(following, "part").join(
        firsts.withColumnRenamed("part", "next_part"), "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            out = [Document(i, t).row(Document(j, u)) for i, t, j, u in pairs]
            if out:
                yield _batch(out, 0, "done").select(NAMES)

    return done.union(edges.select("doc_id", "text", "next_id", "next").mapInArrow(finish, COLUMNS))
