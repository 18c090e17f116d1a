"""Token ids as length-delimited binary records with an offset index.

A shard is a sequence of records, each framed as

    length of the payload, unsigned 64-bit
    masked CRC-32C of those 8 bytes, unsigned 32-bit
    payload
    masked CRC-32C of the payload, unsigned 32-bit

all little-endian.  A payload is one document: 32-bit flags (1: it has an id, 2: wide), 64-bit doc_id, then its token
ids as unsigned 16-bit integers, or 32-bit where an id is 65,536 or more (wide).  The index file beside a shard has the offset of each record as unsigned 64-bit integers,
the end of the shard last, so any record can be read alone, in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from cohortwarn.llm.common import UNICODE_SPACE, once, slices, text_of

MASK, POLY = 0xA282EAD8, 0x82F63B78  # fixed values of the record format and of CRC-32C
HEAD = "<Iq"
#: Bytes for which the checksum has one table; longer payloads are folded from such blocks.
BLOCK = 1024
#: Records that are read from a shard at once.
READ_AT_ONCE = 256
#: Pieces that a task keeps with their ids, and the longest of them; others are encoded again.
KEPT_PIECES, KEPT_LENGTH = 1_000_000, 64
#: Of the kept pieces, those that are looked up as numbers: how many, and bytes of the longest.
SHORT_PIECES, SHORT_LENGTH = 1_000_000, 15


class Crc32c:
    """CRC-32C of many byte strings at once, as the sum of what each byte adds at its distance from the end."""

    def __init__(self):
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
        self.step = t
        rows = [t]
        for _ in range(BLOCK - 1):  # one more byte of zeros behind it
            rows.append((rows[-1] >> 8) ^ t[rows[-1] & 0xFF])
        self.at = np.stack(rows[::-1])  # [position in block, byte]
        self.where = np.arange(BLOCK)
        one = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        for _ in range(BLOCK):  # the state after a block of zeros, for each byte of the state before it
            one = [(x >> 8) ^ t[x & 0xFF] for x in one]
        self.skip = [x.tolist() for x in one]

    def of(self, data: bytes) -> int:
        return self.many([data])[0]

    def many(self, items: list[bytes]) -> list[int]:
        blocks, counts = [], []
        for x in items:
            n = -(-len(x) // BLOCK)
            pad = n * BLOCK - len(x)
            # Leading zeros change nothing when the state starts at zero; a start of all ones is the same as the
            # first four bytes inverted.
            head = bytes(b ^ 0xFF for b in x[:4])
            blocks.append(bytes(pad) + head + x[4:])
            counts.append(n)
        flat = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK)
        sums: list[int] = []
        for at in range(0, len(flat), 64):
            part = flat[at : at + 64]
            sums += np.bitwise_xor.reduce(self.at[self.where, part], axis=1).tolist()
        out, k, (s0, s1, s2, s3) = [], 0, self.skip
        for x, n in zip(items, counts, strict=True):
            if len(x) < 4:
                out.append(self._short(x))
                k += n
                continue
            crc = 0
            for s in sums[k : k + n]:
                crc = s0[crc & 0xFF] ^ s1[crc >> 8 & 0xFF] ^ s2[crc >> 16 & 0xFF] ^ s3[crc >> 24] ^ s
            k += n
            out.append(crc ^ 0xFFFFFFFF)
        return out

    def _short(self, x: bytes) -> int:
        crc = 0xFFFFFFFF
        for b in x:
            crc = (crc >> 8) ^ int(self.step[(crc ^ b) & 0xFF])
        return crc ^ 0xFFFFFFFF


def crc32c() -> Crc32c:
    return once("crc32c", Crc32c)


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payloads: list[bytes]) -> list[bytes]:
    crc = crc32c()
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = crc.many(heads + payloads)
    n = len(payloads)
    return [h + struct.pack("<I", masked(sums[i])) + p + struct.pack("<I", masked(sums[n + i]))
            for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def unframe(data: bytes, offsets: list[int], where: str) -> list[bytes]:
    """Payloads of the records between consecutive offsets (relative to ``data``); raises if a checksum is wrong."""
    crc = crc32c()
    heads = [data[a : a + 8] for a in offsets[:-1]]
    payloads = [data[a + 12 : b - 4] for a, b in zip(offsets, offsets[1:], strict=False)]
    sums, n = crc.many(heads + payloads), len(payloads)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        length, = struct.unpack("<Q", heads[i])
        head_sum, = struct.unpack_from("<I", data, a + 8)
        sum_, = struct.unpack_from("<I", data, b - 4)
        if length != b - a - 16 or head_sum != masked(sums[i]) or sum_ != masked(sums[n + i]):
            raise ValueError(f"{where}: record at {a} is damaged")
    return payloads


class ShortPieces:
    """Ids of pieces of up to ``SHORT_LENGTH`` bytes, looked up for many pieces at once.

    A piece is two 64-bit numbers, its bytes and behind them its length, so equal numbers are equal pieces.  They stand
    in the first free place from the one that their hash names, in tables of twice as many places as pieces are kept.
    When these are full, all pieces are forgotten.
    """

    def __init__(self, pieces: int):
        self.pieces, self.bits = pieces, max(4, (2 * pieces - 1).bit_length())
        self.first, self.second = np.zeros((2, 1 << self.bits), np.uint64)
        self.start, self.size = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.uint8)
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = self.count = 0

    def forget(self) -> None:
        self.second[:] = 0
        self.used = self.count = 0

    def look(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each piece, or -1."""
        place, open_ = np.full(len(first), -1), np.arange(len(first))
        at = self._home(first, second)
        while len(open_):
            there = self.second[at]
            same = (there == second[open_]) & (self.first[at] == first[open_])
            place[open_[same]] = at[same]
            on = np.flatnonzero(~same & (there != 0))
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return place

    def add(self, first: np.ndarray, second: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Different pieces that are not known yet; ``start`` and ``size`` say where their ids stand."""
        open_, at = np.arange(len(first)), self._home(first, second)
        self.count += len(first)
        while len(open_):
            free = np.flatnonzero(self.second[at] == 0)
            # Of pieces that want one place the last has it.
            self.start[at[free]] = open_[free]
            had = free[self.start[at[free]] == open_[free]]
            here, got = at[had], open_[had]
            self.first[here], self.second[here] = first[got], second[got]
            self.start[here], self.size[here] = start[got], size[got]
            left = np.ones(len(open_), bool)
            left[had] = False
            open_, at = open_[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def put(self, ids: np.ndarray) -> int:
        """Write ids behind those in use; returns where."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def _home(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        x = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)


# Of a number of 8 bytes those that a piece of 0 to 8 bytes has.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of up to 15 bytes as two numbers each."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    words = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    first = words[starts] & _BYTES[np.minimum(sizes, 8)]
    second = words[starts + 8] & _BYTES[np.maximum(sizes - 8, 0)]
    return first, second | sizes.astype(np.uint64) << np.uint64(56)


class PieceEncoder:
    """Whole texts as the tokenizers library encodes them, each different piece once.

    The byte-level splitter never puts a character and a later white space into one token; a single space belongs to
    what follows it, and of longer white space the last character stands apart.  Texts are cut by that rule with array
    operations, and the library's ids of the pieces are the ids of the text.  A sign behind a letter or digit at the
    end of a piece is never one token with it either, so it is cut off.  Texts with other white space than ASCII, or
    with a special token, are cut one by one by the same rule, written as an expression.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.odd = "|".join([_OTHER_SPACE, *[re.escape(x) for x in self.special]])
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.short = ShortPieces(SHORT_PIECES)
        # Longer pieces, in two generations, so that what is used stays when the older half goes.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode_array(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text (none is null) as unsigned 32-bit integers."""
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        ids, ends = self._ids(data, at - at[0])
        out = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._one(texts[i].as_py())
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.encode_array(pa.array(texts, pa.string()))]

    def _ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Ids of texts that lie behind one another in ``data``, and where those of each text end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), [0] * (len(at) - 1)
        starts = np.flatnonzero(_cut(data, at))
        lengths, short = np.diff(np.r_[starts, n]), self.short
        if short.count >= short.pieces:
            short.forget()
        small = np.flatnonzero(lengths <= SHORT_LENGTH)
        first, second = _numbers(data, starts[small], lengths[small])
        place = short.look(first, second)
        begin, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[small], sizes[small] = short.start[place], short.size[place]
        # What is not known as a number: short pieces that are kept from now on, then all others.
        new = np.flatnonzero(place < 0)
        rest = np.r_[small[new], np.flatnonzero(lengths > SHORT_LENGTH)]
        if len(rest):
            offsets = np.r_[starts, n].astype(np.int32)
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            coded = pieces.take(pa.array(rest)).dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            # The dictionary is in the order of first appearance.
            fresh = int(which[: len(new)].max(initial=-1)) + 1
            found = self._encode(set(names[:fresh]))
            known = [*map(found.__getitem__, names[:fresh]), *self._look(names[fresh:])]
            counts = np.fromiter(map(len, known), np.int64, len(known)) // 4
            behind = np.cumsum(counts) - counts + short.put(np.frombuffer(b"".join(known), "<u4"))
            begin[rest], sizes[rest] = behind[which], counts[which]
            if keep := min(fresh, short.pieces - short.count):
                one = np.zeros(fresh, np.int64)
                one[which[: len(new)]] = new
                one = one[:keep]
                short.add(first[one], second[one], behind[:keep], counts[:keep])
                short.used += int(counts[:keep].sum())
        ends = np.cumsum(sizes)
        ids = short.ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        upto = np.searchsorted(starts, at[1:], "left")
        return ids, np.r_[0, ends][upto].tolist()

    def _one(self, text: str) -> np.ndarray:
        out = []
        for raw in self.specials.split(text) if self.specials else [text]:
            if raw in self.special:
                out.append(struct.pack("<I", self.special[raw]))
            else:
                out += self._look([p.encode() for p in _PIECES(raw)])
        return np.frombuffer(b"".join(out), "<u4")

    def _look(self, pieces: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        missing = {p for p in pieces if p not in young}
        again = {p: x for p in missing if (x := old.get(p)) is not None}
        found = self._encode(missing.difference(again))
        young.update(again)
        young.update(found)
        out = [young[p] for p in pieces]
        for p in [p for p in found if len(p) > KEPT_LENGTH]:
            del young[p]
        if len(young) > KEPT_PIECES // 2:
            self.old, self.young = young, {}
        return out

    def _encode(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Pieces without white space go to the library as the lines of one text, whose ids are cut at the breaks."""
        out = {}
        single = [p for p in pieces if self.line is None or p == b" " or _WHITE(p, p[:1] == b" ")]
        found = self.library.encode_batch_fast([p.decode() for p in single], add_special_tokens=False)
        for piece, got in zip(single, found, strict=True):
            out[piece] = np.asarray(got.ids, "<u4").tobytes()
        lines = list(pieces.difference(single))
        if lines:
            [got] = self.library.encode_batch_fast([b"\n".join(lines).decode()], add_special_tokens=False)
            ids = np.asarray(got.ids, "<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.line) * 4).tolist()
            for piece, a, b in zip(lines, [0, *[e + 4 for e in ends]], [*ends, len(data)], strict=True):
                out[piece] = data[a:b]
        return out


# Fixed rule of the splitter: a run of other characters with one space before it, or white space up to the last
# before such a run.
_PIECES = re.compile(f" ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+").findall
_OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE = re.compile(
    rb"[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
_IS_SPACE, _IS_SIGN, _IS_WORD = np.zeros((3, 256), bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_SIGN[list(b".,;:!?")] = True
_IS_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def _cut(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a piece begins, for texts in UTF-8 that begin at ``at`` (the end of the last one included)."""
    n = len(data)
    begun = np.zeros(n + 1, bool)
    begun[at] = True
    ended, begun = begun[1:], begun[:-1]
    space = _IS_SPACE[data]
    after_space, before_space = np.zeros(n, bool), np.zeros(n, bool)
    after_space[1:], before_space[:-1] = space[:-1], space[1:]
    blank = np.zeros(n, bool)
    blank[1:] = data[:-1] == 32
    start = begun | (space & (~after_space | ~(before_space | ended))) | (~space & after_space & ~blank)
    # A sign at the end of a piece, behind an ASCII letter or digit or one of the letters from U+00C0 to U+00FF.
    word = _IS_WORD[data]
    word[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    behind = np.zeros(n, bool)
    behind[1:] = word[:-1]
    return start | (_IS_SIGN[data] & behind & (before_space | ended))


def encoder(path: str) -> PieceEncoder:
    return once(f"pieces:{path}", lambda: PieceEncoder(path))


def filesystem(folder: str) -> tuple[afs.FileSystem, str]:
    """Arrow's file system for a folder: file, hdfs, s3, gs or abfs addresses, or a plain path."""
    if "://" not in folder:
        return afs.LocalFileSystem(), folder.removeprefix("file:")
    return afs.FileSystem.from_uri(folder)


def _publish(store: afs.FileSystem, path: str, write) -> None:
    """Write under a name of this attempt, then rename: a repeated task replaces the file by an equal one."""
    mine = f"{path}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(mine) as out:
        write(out)
    store.move(mine, path)


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, bounds: list[int] | None = None) -> DataFrame:
    """doc_id, wide, ids: the token ids of each text with ``end_id`` behind them, in place and without a shuffle.

    ``ids`` are unsigned 16-bit integers, or 32-bit (``wide``) where one is 65,536 or more.  With ``bounds`` also
    ``shard``: how many of them lie below doc_id.  A doc_id that is a bound several times is dealt out to the shards
    between them, so that not even one doc_id throughout makes one shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, of = np.array([end_id], np.uint32), encoder(tokenizer).encode_array
        for batch in slices(batches, 5000):
            found = [np.concatenate([x, end]) for x in of(batch.column(1))]
            wide = [bool(x.max() >= 1 << 16) for x in found]
            packed = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(found, wide, strict=True)]
            columns = [batch.column(0), pa.array(wide), pa.array(packed, pa.binary())]
            if bounds is not None:
                ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                low, high = (np.searchsorted(bounds, ids, side) for side in ("left", "right"))
                spread = np.fromiter(map(zlib.crc32, packed), np.int64, len(packed))
                columns.append(pa.array(low + spread % (np.maximum(high - 1, low) - low + 1), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, wide boolean, ids binary" + ", shard int" * (bounds is not None)
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(work, schema)


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Values of doc_id that cut the rows into about as many parts of one size."""
    cuts = F.percentile_approx(F.col("doc_id").cast("long"), [i / shards for i in range(1, shards)], 10 * max(1000, shards))
    return (docs.agg(cuts).first()[0] or []) if shards > 1 else []


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as shards in ascending order of doc_id; null ids come first.

    Returns the manifest that is also written to ``folder``/manifest: shard, path, records, tokens.  Texts are encoded
    where they are read; the ids are dealt out by ranges of doc_id, about ``shards`` of one size (default: the
    session's shuffle partitions), and sorted in each; no task holds more than a record at a time.  Each
    document ends with ``end_id``.  A null text counts as empty, repeated rows give repeated records, an empty
    table gives an empty manifest.  Other columns are not written.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = encode(docs, tokenizer, end_id, shard_bounds(docs, shards))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        parts = (part for batch in slices(batches, 200) for part in _by_shard(batch))
        ahead = next(parts, None)
        while ahead is not None:
            shard, tokens, offsets = ahead[0], 0, [0]

            def write(out) -> None:
                nonlocal ahead, tokens
                while ahead is not None and ahead[0] == shard:
                    payloads = []
                    for doc, wide, ids in zip(*[c.to_pylist() for c in ahead[1].columns[:3]], strict=True):
                        tokens += len(ids) // (4 if wide else 2)
                        payloads.append(struct.pack(HEAD, (doc is not None) | wide << 1, doc or 0) + ids)
                    for record in frame(payloads):
                        out.write(record)
                        offsets.append(offsets[-1] + len(record))
                    ahead = next(parts, None)

            store.create_dir(base, recursive=True)
            path = f"{base}/shard-{shard:06d}.rec"
            _publish(store, path, write)
            _publish(store, f"{path}.idx", lambda out: out.write(np.asarray(offsets, "<u8").tobytes()))
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.rec"], "records": [len(offsets) - 1],
                 "tokens": [tokens]})

    manifest = rows.mapInArrow(work, "shard long, path string, records long, tokens long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _by_shard(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch that is sorted by shard."""
    shards = batch.column(3).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(shards[a]), batch.slice(a, b - a)


def read_at(folder_path: str, positions: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard by number, in the order asked for, through the offset index."""
    store, path = filesystem(folder_path)
    with store.open_input_file(f"{path}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    out = []
    with store.open_input_file(path) as f:
        for i in positions:
            a, b = int(offsets[i]), int(offsets[i + 1])
            out.append(parse(unframe(f.read_at(b - a, a), [0, b - a], path)[0]))
    return out


def payload(doc: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    return struct.pack(HEAD, (doc is not None) | wide << 1, doc or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc = struct.unpack_from(HEAD, data)
    ids = np.frombuffer(data, "<u4" if flags & 2 else "<u2", offset=struct.calcsize(HEAD))
    return doc if flags & 1 else None, ids.astype("<u4")


def read_records(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Documents of a folder of shards: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and,
    if asked, token_ids.  Each shard is read in runs of records by its index; checksums are verified."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    # One row for each shard: the running sum is over as many rows as there are tasks.
    n = max(1, manifest.count())
    shards = shards.repartition(n, "shard")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = filesystem(row["path"])
                with store.open_input_file(f"{path}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").tolist()
                start = row["base"]
                with store.open_input_file(path) as f:
                    for at in range(0, len(offsets) - 1, READ_AT_ONCE):
                        span = offsets[at : at + READ_AT_ONCE + 1]
                        data = f.read_at(span[-1] - span[0], span[0])
                        got = [parse(p) for p in unframe(data, [x - span[0] for x in span], path)]
                        counts = [len(x) for _, x in got]
                        starts = (start + np.cumsum([0, *counts[:-1]])).tolist()
                        start += sum(counts)
                        cols = [pa.array([d for d, _ in got], pa.int64()), pa.array(starts, pa.int64()),
                                pa.array(counts, pa.int64()),
                                pa.array([zlib.crc32(x.tobytes()) for _, x in got], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            cols.append(pa.array([x.tolist() for _, x in got], pa.list_(pa.int64())))
                            names.append("token_ids")
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * ids
    return shards.select("path", "base").mapInArrow(work, schema)
