"""Phrase collocations by dynamic itemset counting.

The texts are dealt into shards that are scanned in a circle.  Words are counted from the first scan on.  A longer
phrase becomes active with the scan after both its subphrases (all words but the last, all but the first) have
reached the threshold, and is counted in as many scans as there are shards, so each shard counts for it once, wherever
it joined.  Phrases of different lengths are therefore counted in the same scans.  The circle ends when nothing is
active.

What a task has to know is only in which scan a subphrase reached the threshold.  That is one byte in a table of
fixed size at a slot that the hash of the phrase names.  Where two phrases share a slot the earlier scan stands for
both, but not one before the phrase itself was active: a phrase may then be counted that need not have been, but
always in a whole circle, so counts are exact.

A scan cuts texts into words and counts phrases with array operations, adds up within a slice of some megabytes, and
sends (lang, phrase, n) to be summed.  Sums combine map-side, so a very common phrase is one row of each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwarn.llm.common import slices, text_of
from cohortwarn.session import stable

#: Longest phrase, least occurrences, scores in millionths of this, share (%) from which a longer phrase takes over.
LONGEST, LEAST, SCALE, ABSORB, TOP = 4, 30, 2_000_000, 80, 2000
#: Shards of the circle, bytes of text in a slice, bytes of text for a slot, and bounds of the table of slots.
SHARDS, SLICE, BYTES_A_SLOT, SLOTS = 2, 4 << 20, 256, (16, 26)
#: Rows of counts that a task hands over at once.
SENT = 1 << 15
NEVER = 255
UNKNOWN = "und"

_BREAK, _SPACE = 10, 32
# Ends of a piece are . , ; : ! ? and x0A to x0D; words end at x20 and x09 too.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[ord("A") : ord("Z") + 1] += 32
_TABLE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_TABLE[9] = _SPACE


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined_hash(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last, and that of the last word."""
    return _mix(left * np.uint64(0x9E3779B97F4A7C15) + word)


def word_hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
    return np.fromiter(map(xxhash.xxh64_intdigest, words, map(seeds.__getitem__, langs)), np.uint64, len(words))


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The same hash from phrases as text."""
    cut = [p.encode().split(b" ") for p in phrases]
    flat = [w for words in cut for w in words]
    each = word_hashes([x for x, words in zip(langs, cut, strict=True) for _ in words], flat)
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    first = np.cumsum(sizes) - sizes
    out = each[first] if len(cut) else each
    for k in range(1, int(sizes.max(initial=0))):
        more = sizes > k
        out[more] = joined_hash(out[more], each[first[more] + k])
    return out


def _numbered(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and for each key its number among them; keys are below ``most``."""
    if most > 20 * len(key) + 1000:
        return np.unique(key, return_inverse=True)
    there = np.zeros(most, bool)
    there[key] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[key]


def _packed(columns: list[np.ndarray], size: int):
    """One number for each row of numbers below ``size``, and the way back from such numbers to columns."""
    key, span, tables = columns[0], size, []
    for c in columns[1:]:
        table = None
        if span * size >= 1 << 63:  # would not fit: what there is so far is numbered anew
            table, key = np.unique(key, return_inverse=True)
            span = len(table)
        tables.append(table)
        key, span = key * size + c, span * size

    def unpack(keys: np.ndarray) -> list[np.ndarray]:
        out = []
        for table in reversed(tables):
            out.append(keys % size)
            keys = keys // size
            keys = keys if table is None else table[keys]
        return [keys, *reversed(out)]

    return key, unpack


class Words:
    """The words of many texts: number of each in ``terms`` (of a language), and the piece in which it stands."""

    def __init__(self, langs: pa.Array, texts: pa.StringArray):
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        data = _TABLE[raw]
        begun = np.zeros(len(data) + 1, bool)
        begun[at[:-1]] = True
        begun = begun[:-1]  # an empty last text begins behind the data
        cut = data == _BREAK
        inside = ~(cut | (data == _SPACE))
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | begun))
        # A slice has fewer bytes than the offsets of an Arrow array can name.
        self.piece = np.cumsum(cut | begun, dtype=np.int32)[starts]
        ends = np.cumsum(inside, dtype=np.int32)
        offsets = np.r_[ends[starts] - 1, ends[-1:] if len(ends) else 0].astype(np.int32)
        body = data[inside]
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        coded = found.dictionary_encode()
        doc = np.searchsorted(at, starts, "right") - 1
        lang = langs.dictionary_encode()
        codes, names = lang.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64), lang.dictionary.to_pylist()
        key = codes * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        known, self.ids = _numbered(key, len(names) * len(coded.dictionary))
        which = known % max(1, len(coded.dictionary))
        self.lang = [names[i] for i in (known // max(1, len(coded.dictionary))).tolist()]
        self.terms = coded.dictionary.take(pa.array(which)).cast(pa.string())
        self.hashes = word_hashes(self.lang, coded.dictionary.take(pa.array(which)).to_pylist())


COUNTS = "lang string, phrase string, words int, act int, n long"


def count_shard(rows: DataFrame, reached, scan: int, shards: int) -> DataFrame:
    """lang, phrase, words, act, n of the active phrases of a shard (lang, text); a row without words has all words.

    ``reached`` is a broadcast table: the scan in which the phrases of a slot reached the threshold.
    """

    def count(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = Words(batch.column(0), batch.column(1))
        mask, size = np.uint64(len(table) - 1), max(1, len(found.terms))
        names = pa.array(found.lang, pa.string())
        ids, last, n = found.ids, found.ids, len(found.ids)

        def rows_of(of: np.ndarray, columns: list[np.ndarray], act: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            parts = [found.terms.take(pa.array(x)) for x in columns]
            phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(of)), phrase, pa.array(np.full(len(of), len(parts)), pa.int32()),
                 pa.array(act, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "act", "n"])

        totals = np.bincount(ids, minlength=len(found.terms)) if n else np.zeros(0, np.int64)
        if scan < shards and n:
            every = np.arange(len(found.terms))
            yield rows_of(every, [every], np.zeros(len(every), np.int64), totals)
            code = names.dictionary_encode()
            sums = np.bincount(code.indices.to_numpy(zero_copy_only=False), totals.astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [code.dictionary, pa.array([""] * len(sums)), pa.array(np.zeros(len(sums)), pa.int32()),
                 pa.array(np.zeros(len(sums)), pa.int32()), pa.array(sums)], names=["lang", "phrase", "words", "act", "n"])
        # Of the phrases of one length that begin at these words: place, hash, and when they reached the threshold.
        place, hashes = np.arange(n), found.hashes[ids] if n else found.hashes
        when = table[found.hashes & mask][ids] if n else np.zeros(0, np.uint8)
        for length in range(2, LONGEST + 1):
            known = when < scan
            place, hashes, when = place[known], hashes[known], when[known]
            # Both subphrases stand side by side, in one piece.
            pairs = np.flatnonzero(place[1:] == place[:-1] + 1)
            pairs = pairs[found.piece[place[pairs]] == found.piece[place[pairs] + length - 1]]
            act = np.maximum(when[pairs], when[pairs + 1]).astype(np.int64) + 1
            place, hashes = place[pairs], joined_hash(hashes[pairs], found.hashes[ids[place[pairs] + length - 1]])
            now = np.flatnonzero(scan < act + shards)
            if len(now):
                key, unpack = _packed([ids[place[now] + k] for k in range(length)], size)
                # There are few different scans in which a phrase became active, and each is counted by itself.
                for begun in np.unique(act[now]).tolist():
                    keys, counts = np.unique(key[act[now] == begun], return_counts=True)
                    columns = unpack(keys)
                    yield rows_of(columns[0], columns, np.full(len(keys), begun), counts)
            if length < LONGEST:
                when = np.maximum(table[hashes & mask], act)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(reached.value, np.uint8)
        for batch in slices(batches, 1 << 20, SLICE):
            for found in count(batch, table):
                for at in range(0, found.num_rows, SENT):
                    yield found.slice(at, SENT)

    return rows.select("lang", "text").mapInArrow(work, COUNTS)


def _slots(found: DataFrame, bits: int) -> list:
    """Slots of the phrases (lang, phrase), as bitmaps of runs of slots; all together ``2 ** bits`` bits at most."""
    run = min(18, bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = phrase_hashes(*[c.to_pylist() for c in batch.columns]) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["slot"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in np.unique(at >> run).tolist():
                held.setdefault(k, np.zeros(1 << run, bool))[at[at >> run == k] & ((1 << run) - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())],
            names=["run", "bits"])

    slots = found.select("lang", "phrase").mapInArrow(place, "slot long").withColumn("run", F.shiftright("slot", run))
    return slots.repartition("run").select("slot").mapInArrow(gather, "run long, bits binary").collect()


def frequent_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to ``LONGEST`` words with ``least`` occurrences, and (lang, n) of
    all words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).cast("string").alias("lang"), text_of().alias("text"),
                       (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    rows = stable(rows, "shards", "shard")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // BYTES_A_SLOT).bit_length(), SLOTS[0]), SLOTS[1])
    table = np.full(1 << bits, NEVER, np.uint8)
    counts, done, scan, last = None, [], 0, 0
    while scan < shards or scan <= last + shards:
        if scan >= NEVER:
            raise ValueError("too many shards")  # at most LONGEST * shards scans
        reached = spark.sparkContext.broadcast(table.tobytes())
        new = count_shard(rows.filter(F.col("shard") == scan % shards), reached, scan, shards).withColumn(
            "reach", F.lit(None).cast("int"))
        both = new if counts is None else new.unionByName(counts)
        summed = both.groupBy("lang", "phrase", "words", "act").agg(F.sum("n").alias("n"), F.min("reach").alias("reach"))
        summed = summed.withColumn("reach", F.coalesce("reach", F.when(F.col("n") >= least, F.lit(scan))))
        # A phrase whose circle ends here below the threshold is of no use any more; word sums always are.
        ends = F.col("act") + shards - 1 <= scan
        kept = stable(summed.withColumn("ends", ends).filter("not ends or reach is not null or words = 0"), "counts")
        done.append(kept.filter("ends").drop("ends"))
        counts = kept.filter("not ends").drop("ends")
        fresh = kept.filter((F.col("reach") == scan) & F.col("words").between(1, LONGEST - 1))
        for run, packed in _slots(fresh, bits):
            part = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            here = table[run * len(part) : (run + 1) * len(part)]
            here[part & (here == NEVER)] = scan
            last = scan
        reached.unpersist()
        scan += 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    totals = every.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return stable(every.filter("words > 0").select("lang", "phrase", "words", "n"), "phrases"), totals


def _part(first: int, words: int):
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, words), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A to Z), a null text counts as empty, a null language as ``und``.  Repeated rows count
    each time.  The order is total, so ties cannot change the result; an empty table gives no rows.  Only text and
    lang are read.
    """
    found, totals = frequent_phrases(docs, least, shards)
    single = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    longer = found.filter("words > 1")
    # The two parts of each cut: both have reached the threshold, so both are among the phrases.
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = longer.select("lang", "phrase", F.col("n").alias("a"), "words", cuts)
    left = F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("words") - F.col("k")), " ")
    cut = cut.withColumn("part", left).join(single.withColumnRenamed("f", "l"), ["lang", "part"])
    cut = cut.withColumn("part", right).join(single.withColumnRenamed("f", "r"), ["lang", "part"])
    score = F.expr(f"cast(a as decimal(19,0)) * {SCALE}bd div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every phrase of two words or more inside a longer one.
    inner = []
    for words in range(3, LONGEST + 1):
        inner += [F.when(F.col("words") == words, _part(i, m)) for m in range(2, words) for i in range(words - m + 1)]
    over = longer.filter("words > 2").select("lang", "n", F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
    over = over.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    absorbed = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * ABSORB
    stays = best.join(over, ["lang", "phrase"], "left").filter(~F.coalesce(absorbed, F.lit(False)))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stays.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn(
        "rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
