"""Packing of documents into sequences, in their order, by dynamic programming over the cuts.

The documents of a range of ids, each with an end token, are one long row of tokens.  It is cut into windows of at
most ``LENGTH`` tokens; each becomes a sequence.  Cuts may lie at the ends of documents and of sentences (a token that
ends in a full stop, a question mark, an exclamation mark or a line break), and every ``STEP`` tokens where sentences are
longer.  With f(j) the least cost of cutting all tokens before j,

    f(j) = charge(j) + min over i of f(i) + padding(j - i) + WINDOW

where charge(j) is the price of breaking a document off there.  The padding of a window is LENGTH minus its tokens, so
the minimum over all cuts within LENGTH is that of f(i) + i, which a monotone queue hands on from cut to cut; a window
whose tokens are a power of two is not padded, and those few cuts are looked up one by one.

Tokens are dealt out by ranges of doc_id (rows of one doc_id by a hash) and packed as a stream: after each ``BLOCK`` tokens the
windows are settled but for the last, which goes on with the tokens behind it.  Only the last window of a range is cut short.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwarn.llm.common import once, slices
from cohortwarn.llm.records import encode, encoder
from cohortwarn.session import stable

#: Tokens of a sequence, and of a block after which windows are settled.
LENGTH, BLOCK = 1024, 1 << 19
#: Least distance of sentence cuts, distance of cuts in long sentences.
SPACING, STEP = 16, 32
#: Costs in tokens of padding: of a window, of breaking a document between sentences, and within one.
WINDOW, SENTENCE, WITHIN = 8, 4, 48


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each token id whether a sentence may end with it."""

    def make() -> np.ndarray:
        library = encoder(tokenizer).library
        size = library.get_vocab_size(with_added_tokens=True)
        texts = library.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        return np.array(["\n" in t or t.rstrip("\"'»”)]")[-1:] in (".", "!", "?") and bool(t) for t in texts])

    return once(f"sentence-ends:{tokenizer}", make)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, spacing: int = SPACING,
               step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places of cuts in a row of tokens, with their charges; the end of the row is one.

    ``doc_ends`` are the places behind the documents, ``ends`` tells the tokens that end a sentence.
    """
    known = ids < len(ends)
    stops = np.flatnonzero(ends[np.where(known, ids, 0)] & known) + 1
    # Of each stretch of some tokens the last sentence end.
    stops = stops[np.r_[stops[1:] // spacing != stops[:-1] // spacing, True]] if len(stops) else stops
    marked = np.zeros(len(ids) + 1, bool)
    marked[stops] = marked[doc_ends] = marked[len(ids)] = True
    at = np.flatnonzero(marked)
    gaps = np.diff(np.r_[0, at])
    long = np.flatnonzero(gaps > step)
    counts = (gaps[long] - 1) // step
    begin = np.repeat(at[long] - gaps[long], counts)
    more = begin + step * (np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    marked[more] = True
    cuts = np.flatnonzero(marked)
    charge = np.full(len(cuts), WITHIN)
    charge[np.searchsorted(cuts, stops)] = SENTENCE
    charge[np.searchsorted(cuts, doc_ends)] = 0
    return cuts, charge


def windows(cuts: np.ndarray, charge: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest cuts of the row from 0 to the last of ``cuts``; neighbours are at most ``length`` apart."""
    places = np.r_[0, cuts]
    # Pairs of a cut and one that lies a power of two before it, in the order of the first.
    number = np.full(int(places[-1]) + 1, -1)
    number[places] = np.arange(len(places))
    later, earlier, size = [], [], 1
    while size <= length:
        j = np.searchsorted(places, size)
        at = number[places[j:] - size]
        hit = np.flatnonzero(at >= 0)
        later.append(hit + j)
        earlier.append(at[hit])
        size *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    near = earlier[np.argsort(later, kind="stable")].tolist()
    upto = np.cumsum(np.bincount(later, minlength=len(places))).tolist()
    where, price = places.tolist(), [0, *charge.tolist()]
    cost, back, best = [0] * len(where), [0] * len(where), [0] * len(where)  # best: f(i) + i
    queue, n = deque([0]), 0  # cuts, best first
    for j in range(1, len(where)):
        x = where[j]
        while where[queue[0]] < x - length:
            queue.popleft()
        i = queue[0]
        value = best[i] + length - x
        if upto[j] > n:
            for k in near[n : upto[j]]:
                if cost[k] < value:
                    value, i = cost[k], k
            n = upto[j]
        cost[j] = value = value + WINDOW + price[j]
        back[j] = i
        best[j] = value = value + x
        while queue and best[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = back[j]
    return out[::-1]


def padding(tokens: int, length: int = LENGTH) -> int:
    """Padding of a sequence: none at a power of two."""
    return 0 if tokens & (tokens - 1) == 0 else length - tokens


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window long, offset long"


class Packer:
    """The windows of a stream of documents."""

    def __init__(self, ends: np.ndarray, length: int, block: int):
        self.ends, self.length, self.block = ends, length, block
        self.ids, self.docs, self.size, self.window = [], deque(), 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.ids.append(ids)
        # A document, its tokens, and how many of them have been given out.
        self.docs.append([doc, len(ids), 0])
        self.size += len(ids)
        if self.size >= self.block:
            yield from self.settle(False)

    def settle(self, final: bool) -> Iterator[tuple]:
        """Pieces of the windows that no later token can change much: all but the last, or all."""
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([n - done for _, n, done in self.docs])
        cuts = windows(*candidates(ids, doc_ends, self.ends), self.length)
        if not final:
            cuts.pop()
        a = 0
        for b in cuts:
            offset = 0
            while a < b:
                doc = self.docs[0]
                take = min(b - a, doc[1] - doc[2])
                crc = zlib.crc32(ids[a : a + take].tobytes())
                yield doc[0], doc[2], take, crc, doc[1], self.window, offset
                a, offset, doc[2] = a + take, offset + take, doc[2] + take
                if doc[2] == doc[1]:
                    self.docs.popleft()
            self.window += 1
        self.ids, self.size = [ids[a:]], len(ids) - a


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A piece is the run of a document's tokens from ``start`` that stands in a sequence from ``offset``; a document's
    last token is ``end_id``.  Sequences are numbered from 0 in the order of doc_id, null first.  A null text counts as
    empty (the end token alone), repeated rows are packed each, an empty table gives no rows.  Only doc_id and text are
    read.
    """
    encoded = stable(encode(docs, tokenizer, end_id), "token-ids")
    rows = encoded.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part = Packer(sentence_ends(tokenizer), length, block), TaskContext.get().partitionId()

        def table(found: list[tuple]) -> pa.RecordBatch:
            doc, start, take, crc, tokens, window, offset = zip(*found, strict=True)
            whole = [pa.array(x, pa.int64()) for x in (doc, start, take, crc, tokens)]
            return pa.RecordBatch.from_arrays(
                [*whole, pa.array([part] * len(found), pa.int32()), pa.array(window, pa.int64()),
                 pa.array(offset, pa.int64())], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in slices(batches, 200):
            found: list[tuple] = []
            for doc, wide, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found += packer.add(doc, np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4"))
            if found:
                yield table(found)
        if found := list(packer.settle(True)):
            yield table(found)

    pieces = stable(rows.select("doc_id", "wide", "ids").mapInArrow(work, PIECES), "pieces")
    # One row for each range.
    sizes = pieces.groupBy("part").agg((F.max("window") + 1).alias("windows"))
    before = F.sum("windows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    return pieces.join(bases, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset")
