"""Near-duplicates by SimHash: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance, components.

Fingerprints that differ in at most two bits share at least two of four 16-bit blocks.  Each distinct fingerprint
is therefore filed under its six pairs of blocks; those with the same pair are compared.  A bucket with more than
``BUCKET`` fingerprints is not compared in one task: its members are filed again under pairs of quarter blocks of
the bits the bucket does not fix (32 bits, then 16), by the same argument.  A bucket of the last level
fixes 56 bits and so has at most 256 members; nothing is ever cut.

Within a bucket, links are emitted as a spanning forest, never as all pairs, so the output is at most one row for
each member.  Components are found by alternating two steps that hang nodes onto smaller neighbours; each round is
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwarn.llm.common import add_columns
from cohortwarn.session import stable

SEED, WORDS, DISTANCE = 42, 3, 2
#: Fingerprints of one bucket that a task compares; larger buckets are filed again.
BUCKET = 2048


def fingerprint(text: str | None) -> int:
    """SimHash over word 3-shingles (repeats count); 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; white space x20, x09-x0D
    if not words:
        return 0
    n = min(WORDS, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))
    count = len(words) - n + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 8192):  # a very long text needs no more memory
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > count, bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` plus the fingerprint as a signed 64-bit number."""

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            out = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64)
            return [out.view(np.int64)]

        return compute

    return add_columns(docs, [F.col("text")], f"`{name}` long", make)


def free_bits(level: int) -> list[int]:
    """Bits that a key of this level leaves open: the level lists, in base 16, the pairs of quarters it fixed."""
    tags, free = [], list(range(64))
    while level:
        tags.append(level % 16)
        level //= 16
    for tag in reversed(tags):
        q = len(free) // 4
        free = [bit for i in range(4) if i not in divmod(tag, 4) for bit in free[i * q : (i + 1) * q]]
    return free


def fixed_mask(level: int) -> int:
    mask = (1 << 64) - 1 - sum(1 << bit for bit in free_bits(level))
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_keys(prints: DataFrame, level: int = 0) -> DataFrame:
    """File each ``fp`` under the six pairs of quarters of the bits that ``level`` leaves open."""
    levels = [level * 16 + a * 4 + b for a, b in combinations(range(4), 2)]
    keys = [F.struct(F.lit(x).cast("long").alias("level"), F.col("fp").bitwiseAND(fixed_mask(x)).alias("bits"))
            for x in levels]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.level", "k.bits")


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket; at most one edge less than members."""
    n, out = len(fp), []
    left = np.arange(n)  # not yet reached
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= DISTANCE
            for other in left[near].tolist():
                out.append((at, other))
                queue.append(other)
            left = left[~near]
    return out


def _links(keyed: DataFrame) -> DataFrame:
    """Spanning links of all buckets; the rows of a bucket arrive together, in order of the key."""
    parts = keyed.repartition("level", "bits").sortWithinPartitions("level", "bits", "fp")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            level, bits = batch["level"].to_numpy(), batch["bits"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (bits[1:] != bits[:-1])]) \
                if len(batch) else np.array([], int)
            if not len(starts):
                continue
            yield _bucket_links(batch, starts)
            rest = batch.iloc[starts[-1]:]
        if rest is not None and len(rest):
            yield _bucket_links(rest, np.array([0, len(rest)]))

    return parts.mapInPandas(work, "a long, b long")


def _bucket_links(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Links of the buckets between consecutive starts; the last start only ends the one before."""
    fp = batch["fp"].to_numpy()
    edges: list[tuple[int, int]] = []
    sizes = np.diff(starts)
    for k in np.flatnonzero(sizes > 1):
        a, b = starts[k], starts[k + 1]
        own = fp[a:b]
        edges += [(own[x], own[y]) for x, y in forest(own.view(np.uint64))]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in one or two bits, enough to connect all that
    are connected.  Buckets over ``bucket`` members are filed again; the last level has at most 256 members."""
    keyed, found = bucket_keys(prints), None
    for refine in (True, True, False):
        large = None
        if refine:
            large = stable(keyed.groupBy("level", "bits").count().filter(F.col("count") > bucket)
                           .select("level", "bits"), "large-buckets")
            large = None if large.isEmpty() else large
        part = _links(keyed if large is None else keyed.join(large, ["level", "bits"], "left_anti"))
        found = part if found is None else found.union(part)
        if large is None:
            break
        # 6 kinds of key at the first level, 36 at the second.
        kinds = sorted(r[0] for r in large.select("level").distinct().collect())
        members = keyed.join(large, ["level", "bits"], "left_semi")
        again = [bucket_keys(members.filter(F.col("level") == x).select("fp"), x) for x in kinds]
        keyed = reduce(DataFrame.union, again)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node (``root``) that each ``node`` of the undirected edges (a, b) can reach.

    Rounds of two steps: each node hangs its larger neighbours, then itself and its smaller neighbours, onto the
    smallest node around it.  When a round changes nothing, each edge leads to a root.
    """
    edges = stable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = stable(hung.union(least.toDF("a", "b")).distinct(), "edges")
    roots = edges.toDF("node", "root")
    return roots.union(roots.select("root", "root").distinct())


def _digest(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each document: doc_id, fp (signed fingerprint), component_id.

    ``component_id`` is the smallest doc_id that links of at most two differing bits reach.  A null text has no
    words, so its fingerprint is zero and it links like any other; a null doc_id is never a component's id unless
    no document of the component has one.  Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = stable(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    prints = stable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(prints.select("fp"), bucket)).toDF("fp", "root")
    prints = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = prints.join(firsts, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a near-duplicate with a smaller doc_id stands for; all columns stay.

    Documents without an id are not dropped.
    """
    dropped = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stable(dropped, "dropped"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
