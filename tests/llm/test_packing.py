import random
import sys
import zlib

import numpy as np
import pytest
from llm.conftest import CLASHING, read
from tokenizers import Tokenizer

from cohortwarn.llm import packing
from cohortwarn.llm.queries import BYTE_TOKENIZER, QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_TOKENIZER)


def check(pieces, rows, library, length=1024):
    """Every token lies in one piece, in order, and no sequence is too long; the padding."""
    want = sorted([(i, len(ids := [*library.encode(t or "", add_special_tokens=False).ids, 0]), ids) for i, t in rows],
                  key=lambda x: (x[0] is not None, x[0] or 0))
    by_sequence = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    sequences: dict[int, int] = {}
    for r in by_sequence:
        assert r.offset == sequences.get(r.sequence_id, 0) and r.length > 0
        sequences[r.sequence_id] = r.offset + r.length
    assert sorted(sequences) == list(range(len(sequences))) and max(sequences.values(), default=0) <= length
    place = 0
    ids_of = {}
    for i, n, ids in want:
        ids_of.setdefault(i, []).append(ids)
    for r in by_sequence:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
                   == r.ids_crc32 for ids in ids_of[r.doc_id])
    for i, n, _ in want:
        got = 0
        while got < n:
            r = by_sequence[place]
            assert r.doc_id == i and r.start == got
            got += r.length
            place += 1
            n = r.doc_tokens if r.start == 0 else n
    assert place == len(by_sequence)
    return sum(packing.padding(x, length) for x in sequences.values()), sum(sequences.values())


def brute_windows(cuts, charge, length):
    places, price = [0, *cuts.tolist()], [0, *charge.tolist()]
    cost = [0] + [None] * len(cuts)
    for j in range(1, len(places)):
        ways = [cost[i] + packing.padding(places[j] - places[i], length) for i in range(j)
                if cost[i] is not None and places[j] - places[i] <= length]
        cost[j] = min(ways) + packing.WINDOW + price[j] if ways else None
    return cost[-1]


def test_cuts_cost_least():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 120)
        cuts = np.array(sorted({n, *range(16, n, 16), *(rng.randint(1, n) for _ in range(rng.randint(0, 30)))}))
        charge = np.array([rng.choice((0, 4, 48)) for _ in cuts])
        found = packing.windows(cuts, charge, 32)
        price = dict(zip(cuts.tolist(), charge.tolist(), strict=True))
        cost = sum(packing.padding(b - a, 32) + packing.WINDOW + price[b] for a, b in zip([0, *found], found, strict=False))
        assert found[-1] == n and cost == brute_windows(cuts, charge, 32)


def test_few_calls_for_a_cut():
    """The search is most of a task's time; where nearly every cut lies a power of two behind another too."""
    cuts = np.cumsum(np.random.default_rng(2).integers(8, 25, 20_000))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        packing.windows(cuts, np.zeros(len(cuts), int))
    finally:
        sys.setprofile(None)
    assert calls < 3 * len(cuts)


def test_candidates_are_ends_and_steps():
    ends = np.zeros(10, bool)
    ends[7] = True
    ids = np.array(([1] * 20 + [7]) * 5 + [1] * 200 + [0])
    cuts, charge = packing.candidates(ids, np.array([50, len(ids)]), ends)
    found = dict(zip(cuts.tolist(), charge.tolist(), strict=True))
    assert found[50] == 0 and found[len(ids)] == 0 and found[21] == packing.SENTENCE and found[105 + 32] == packing.WITHIN
    assert np.diff(np.r_[0, cuts]).max() <= packing.STEP


def test_sentences_end_with_signs(library):
    ends = packing.sentence_ends(BYTE_TOKENIZER)
    for text, want in ((".", True), ("!", True), ("\n", True), ("word", False), (",", False)):
        [i] = library.encode(text, add_special_tokens=False).ids
        assert ends[i] == want


def test_query(spark, small, library):
    rows = [(r.doc_id, r.text) for r in read(spark, small).collect()]
    lost, tokens = check(QUERIES["op12_packing"](spark, small).collect(), rows, library)
    assert lost < 0.01 * tokens + 4 * 1024
    docs = read(spark, small).repartition(5)
    lost, tokens = check(packing.pack(docs, BYTE_TOKENIZER, block=5000).collect(), rows, library)
    assert lost < 0.01 * tokens + 5 * 1024


def test_odd_rows(spark, odd, odd_rows, clashing, empty, library):
    for docs in (odd, clashing):
        check(packing.pack(docs, BYTE_TOKENIZER).collect(), [r[:2] for r in odd_rows], library)
    assert packing.pack(empty, BYTE_TOKENIZER).count() == 0
    names = ", ".join(f"{x} string" for x in ("part", "window", "offset", "ids", "wide", "base", "length"))
    many = spark.createDataFrame([(1, "same words here. " * 40, *["x"] * 7)] * 300, f"doc_id long, text string, {names}")
    check(packing.pack(many, BYTE_TOKENIZER, length=64).collect(), [(1, "same words here. " * 40)] * 300, library, 64)
    assert CLASHING
