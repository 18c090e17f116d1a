"""BPE encoding and decoding by a deterministic automaton that is compiled from the merges.

The automaton reads tokens and accepts exactly the token sequences that byte-pair merging produces.  It starts
with one state in which every base symbol is a loop.  The merges are then applied in their order, each as a gadget:

* merge k, ``u v -> w``: wherever an arc ``u`` is followed by an arc ``v``, an arc ``w`` is added that leads where
  ``v`` led, and the arcs ``u`` are led to a copy of their state from which ``v`` is removed.

All arcs with one label lead to one state, so the state is named by the last token, and a copy differs from its
origin by one removed arc.  The table therefore holds, for each token, its two parts and the number of its merge,
and for each merge the removed arc; an arc ``y`` out of the state of ``x`` is there unless some gadget removed it
from a state that the state of ``x`` was copied from (the right parts of ``x``, each up to the time of its copy), or
removed an arc that ``y`` was built on (the left parts of ``y``, each up to the time it was used).  Looked-up arcs are
kept in a transition table.

Because the automaton is deterministic and accepts one sequence for each string, the last token before each
position of a word is unique: a word is encoded from left to right, each position being left at most once.  Decoding writes out the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortwarn.llm.common import UNICODE_SPACE, add_columns, once, text_of

#: Parts between white space, pieces and arcs that a task keeps, longest of them; more are computed again.
KEPT_WORDS, KEPT_PIECES, KEPT_ARCS, KEPT_LENGTH = 150_000, 150_000, 200_000, 64
#: Tokens that are written out as text at once.
WRITTEN = 1 << 18


class Kept:
    """A bounded dictionary in two generations: what is used stays when the older half goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class MergeAutomaton:
    """Deterministic automaton over tokens, for merges given in order of priority.

    ``tokens`` maps token text to id, ``merges`` lists pairs of token texts.  A merge whose result exists already
    would give a token two pairs of parts; such vocabularies are refused.
    """

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.tokens, self.suffix = tokens, suffix
        self.labels = {i: t for t, i in tokens.items()}
        self.made: dict[int, int] = {}  # number of the merge that made the token
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}  # (state, arc) -> number of the merge that removed it
        # Looked-up arcs, by state and label in one number.
        self.arcs, self.width = Kept(KEPT_ARCS), max(tokens.values(), default=0) + 1
        for k, (u, v) in enumerate(merges):
            self.gadget(k, tokens[u], tokens[v], tokens[u + v])
        self.start = {i for i in self.labels if i not in self.made or i in self.parts}
        self.longest = max(map(len, tokens), default=1)

    def gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.made:
            raise ValueError(f"two merges make {self.labels[w]!r}")
        self.made[w] = k
        there = all(t not in self.made or t in self.parts for t in (u, v))
        if there and self.follows(u, v):  # else no arc u is followed by v, and nothing leads to w
            self.parts[w] = (u, v)
        self.removed[u, v] = k

    def follows(self, x: int, y: int) -> bool:
        """Is there an arc y out of the state that the arcs x lead to?"""
        until_x = len(self.removed)
        while True:
            token, until_y = y, len(self.removed)
            while True:
                k = self.removed.get((x, token))
                if k is not None and k < until_x and k <= until_y:
                    return False
                if token not in self.parts:
                    break
                token, until_y = self.parts[token][0], min(until_y, self.made[token])
            if x not in self.parts:
                return True
            x, until_x = self.parts[x][1], min(until_x, self.made[x])

    def step(self, x: int, y: int) -> bool:
        found = self.arcs.get(x * self.width + y)
        if found is None:
            found = self.follows(x, y)
            self.arcs.put(x * self.width + y, found)
        return found

    def encode(self, symbols: str) -> list[int]:
        """Tokens of one word, given as base symbols without the word-end suffix.

        Follows arcs from the left, the longest label first.  A path of arcs to a position is the one way to read
        that far, so a position from which the word cannot be finished is left for good.
        """
        n, get, start, arcs, step, width = len(symbols), self.tokens.get, self.start, self.arcs.young, self.step, self.width
        longest, whole = self.longest, symbols + self.suffix
        t = get(whole)
        if t is not None and t in start:
            return [t]
        path, ends, dead, at, last, end = [], [], set(), 0, -1, min(n, longest)
        while at < n:
            t, found = None, False
            while end > at:
                if end not in dead:
                    t = get(symbols[at:end] if end < n else whole[at:])
                    if t is not None and t in start:
                        ok = arcs.get(last * width + t) if last >= 0 else True
                        if ok or (ok is None and step(last, t)):
                            found = True
                            break
                end -= 1
            if found:
                path.append(t)
                ends.append(end)
                at, last, end = end, t, min(n, end + longest)
            else:
                dead.add(at)
                path.pop()
                end = ends.pop() - 1
                at, last = (ends[-1], path[-1]) if path else (0, -1)
        return path

    def decode(self, ids: list[int]) -> list[str]:
        return [self.labels[i] for i in ids]


class WordTokenizer:
    """The normalising, splitting and encoding that a tokenizer file with word ends asks for.

    Text is put in NFC and lower case, split into contractions, runs of letters, single digits and runs of other
    signs; white space goes.  No piece spans white space, so a text is taken apart at white space and each part is
    looked up among the parts already encoded.  Strings of special tokens are taken out of the raw text first.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        tokens = dict(model["vocab"])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(tokens, merges, model["end_of_word_suffix"] or "")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.symbols = byte_symbols()
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.labels = {**self.automaton.labels, **{i: t for t, i in self.special.items()}}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.odd = "|".join([_OTHER_SPACE, *map(re.escape, self.special)])
        # Ids of parts between white space and of pieces, as unsigned 32-bit integers.
        self.words, self.kept = Kept(KEPT_WORDS), Kept(KEPT_PIECES)
        size = max(self.labels, default=0) + 1
        self.numbers = _Strings([str(i).encode() for i in range(size)])
        self.names = _Strings([self.labels.get(i, "").encode("utf-8", "surrogatepass") for i in range(size)])

    def _piece(self, piece: str, symbols: str | None = None) -> bytes:
        found = self.kept.get(piece)
        if found is None:
            ids = self.automaton.encode(symbols or "".join([self.symbols[b] for b in piece.encode("utf-8")]))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= KEPT_LENGTH:
                self.kept.put(piece, found)
        return found

    def _word(self, part: str) -> bytes:
        if not _SETTLED(part):
            # Python and the library may have different versions of Unicode: the library splits, and gives symbols.
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            return b"".join([self._piece(f"\0{x}", x) for x, _ in pieces])
        plain = part if part.isascii() else unicodedata.normalize("NFC", part)
        plain = plain.lower() if "Σ" not in plain else "".join(c.lower() for c in plain)
        if plain.isalpha():  # one run of letters
            return self._piece(plain)
        if plain[-1:] in _SIGNS and plain[:-1].isalpha():
            return self._piece(plain[:-1]) + self._piece(plain[-1])
        return b"".join([self._piece(x) for x in self.pieces(plain)])

    def part(self, part: bytes) -> bytes:
        """Ids of a part between white space."""
        found = self.words.get(part)
        if found is None:
            found = self._word(part.decode("utf-8", "surrogatepass"))
            if len(part) <= KEPT_LENGTH:
                self.words.put(part, found)
        return found

    def _one(self, text: str) -> bytes:
        """Ids of a text that may have special tokens or white space beyond ASCII."""
        out = []
        for raw in self.specials.split(text) if self.specials else [text]:
            if raw in self.special:
                out.append(struct.pack("<I", self.special[raw]))
            else:
                out += [self.part(p.encode("utf-8", "surrogatepass")) for p in _PARTS(raw)]
        return b"".join(out)

    def encode_array(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none is null) behind one another, and where those of each text end.

        Each different part between white space is looked up once.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if len(data) else np.zeros(len(texts), bool)
        inside = ~_IS_SPACE[data]
        for i in np.flatnonzero(odd).tolist():
            inside[at[i] : at[i + 1]] = False
        begun = np.zeros(len(data) + 1, bool)
        begun[at] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | begun[:-1]))
        upto = np.cumsum(inside)
        offsets = np.r_[upto[starts] - 1, upto[-1:]].astype(np.int32) if len(data) else np.zeros(1, np.int32)
        parts = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        known = [self.part(p) for p in parts.dictionary.to_pylist()]
        which = parts.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        lengths, flat = sizes[which], np.frombuffer(b"".join(known), "<u4")
        ends = np.cumsum(lengths)
        ids = flat[_runs((np.cumsum(sizes) - sizes)[which], lengths)]
        ends = np.r_[0, ends][np.searchsorted(starts, at[1:], "left")]
        if odd.any():
            rows = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd).tolist():
                rows[i] = np.frombuffer(self._one(texts[i].as_py()), "<u4")
            ids, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
        return ids, ends

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Labels joined by a space, as for a file without a decoder; ids without a label are left out."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs behind one another, each from a start on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


class _Strings:
    """Strings by number, with a space before each, to be written behind one another."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) + 1 for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b" " + b" ".join(strings), np.uint8)

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of the strings of each run of ids, joined by a space; some ids are written out at a time."""
        out, sha, begun, stops = [], hashlib.sha256(), False, ends.tolist()
        for a in range(0, len(ids), WRITTEN):
            part = ids[a : a + WRITTEN]
            sizes = self.sizes[part]
            data, at = memoryview(self.flat[_runs(self.starts[part], sizes)]), np.r_[0, np.cumsum(sizes)]
            here = a
            while here < a + len(part):
                stop = min(stops[len(out)], a + len(part))
                piece = data[int(at[here - a]) : int(at[stop - a])]
                sha.update(piece if begun or not len(piece) else piece[1:])
                begun, here = begun or stop > here, stop
                if stop == stops[len(out)]:
                    out.append(sha.hexdigest())
                    sha, begun = hashlib.sha256(), False
        return out + [sha.hexdigest()] * (len(stops) - len(out))


_SIGNS = frozenset(".,;:!?")
# Latin, Greek and Cyrillic: these blocks have been the same in all versions of Unicode for long.
_SETTLED = re.compile("[\0-\u052f]*").fullmatch
_OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PARTS = re.compile(f"[^{UNICODE_SPACE}]+").findall


def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, compiled once in each Python process."""

    def make() -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            return WordTokenizer(json.load(f))

    return once(f"bpe:{path}", make)


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``token_ids``.

    ``path`` is a tokenizer file that every executor has.  One pass over the rows without a shuffle; a task holds
    the tables of the automaton, a bounded number of encoded words, and the ids of some megabytes of text.  A null text counts as empty (no tokens).
    Columns of ``docs`` with the names of new columns are replaced.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def make():
        tokenizer = load(path)

        def compute(batch: pa.RecordBatch) -> list:
            found, ends = tokenizer.encode_array(batch.column(0))
            counts = np.diff(np.r_[0, ends])
            out = [pa.array(counts), tokenizer.numbers.digests(found, ends), tokenizer.names.digests(found, ends)]
            if ids:
                at = pa.array(np.r_[0, ends].astype(np.int32))
                out.append(pa.ListArray.from_arrays(at, pa.array(found.astype(np.int32))))
            return out

        return compute

    return add_columns(docs, [text_of()], fields, make)
