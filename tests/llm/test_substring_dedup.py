import random

import numpy as np
import pytest
from llm.conftest import read
from llm.test_passages import brute, collect, filler

from cohortwarn.llm import substring_dedup
from cohortwarn.llm.queries import QUERIES


def codes_of(text):
    return np.array([ord(c) for c in text], np.uint32)


def plain_cuts(text, span=substring_dedup.SPAN):
    """The recurrence of the rolling hash, code point by code point, and its smallest values."""
    h, hashes = 0, []
    for g in substring_dedup.gear(codes_of(text)).tolist():
        h = (2 * h + g) & 0xFFFF
        hashes.append(h)
    return [min(range(j, j + span), key=lambda i: (hashes[i], -i)) for j in range(len(text) - span + 1)]


def test_cuts_are_the_smallest_hashes():
    rng = random.Random(3)
    for n in (0, 1, 23, 24, 25, 300, 3000):
        text = "".join(rng.choice("abcdefgh éß🙂") for _ in range(n))
        for span in (2, 11, 24, 32):
            assert substring_dedup.cut_at(codes_of(text), span).tolist() == plain_cuts(text, span)
    # The hash of one letter over and over is the same once it has filled its memory.
    same = np.diff(substring_dedup.cut_at(codes_of("a" * 500)))
    assert same[substring_dedup.MEMORY :].tolist() == [1] * (500 - substring_dedup.SPAN - substring_dedup.MEMORY)


def test_chunks_are_short_and_resist_insertions():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))

    def pieces(t):
        at = np.unique(substring_dedup.cut_at(codes_of(t))) + 1
        assert np.diff(at).max() <= substring_dedup.SPAN
        return {t[a:b] for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)}

    assert len(pieces(text) - pieces(text[:500] + "inserted" + text[500:])) <= 6


def test_smallest_of_stretches():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 200).astype(np.uint64)
    first = rng.integers(0, 150, 500)
    last = first + rng.integers(1, 50, 500)
    want = [values[a:b].min() for a, b in zip(first, last, strict=True)]
    assert substring_dedup.smallest(values, first, last).tolist() == want


@pytest.mark.parametrize("words", [2, 9, 20, 51])
def test_equal_windows_have_equal_anchors(words):
    """Wherever a window stands, also one of the shortest words, and in text that repeats itself."""
    rng = random.Random(words)
    windows = substring_dedup.Windows(words)
    for _ in range(60):
        word = rng.choice(["a", "b", "x y", "lorem", filler(rng, 1)])
        passage = rng.choice([" ".join([word] * words), " ".join(rng.choice("abcde") for _ in range(words)), filler(rng, words)])
        found = set()
        for _ in range(6):
            text = f"{filler(rng, rng.randint(0, 9))} {passage} {filler(rng, rng.randint(0, 9))}"
            a, b, anchors = windows.of(text.encode("utf-32-le"))
            places = [k for x, y, k in zip(a.tolist(), b.tolist(), anchors.tolist(), strict=True) if text[x:y] == passage]
            found.update(places)
            assert places or len(passage.split()) != words
        assert len(found) <= 1


def test_texts_of_common_words_seldom_share_anchors():
    """Texts without a common passage, from few words: their windows are not compared one by one."""
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(50)]
    windows = substring_dedup.Windows()
    found = [windows.of(" ".join(rng.choice(known) for _ in range(1050)).encode("utf-32-le"))[2] for _ in range(60)]
    assert np.isin(found[0], np.concatenate(found[1:])).mean() < 0.05


def test_planted_passages_are_cut_out(spark):
    rng = random.Random(5)
    texts = [filler(rng, 400) for _ in range(120)]
    planted = set()
    for _ in range(20):
        passage = filler(rng, 52)
        for j in rng.sample(range(60), 3):
            at = texts[j].find(" ", rng.randrange(len(texts[j]) - 50))
            texts[j] = f"{texts[j][:at]} {passage} {texts[j][at + 1:]}"
            planted.add(j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring_dedup.passages(df).collect()
    assert sorted(map(tuple, found)) == brute(list(enumerate(texts)))
    assert {r.doc_id for r in found} | {r.keep_doc_id for r in found} == planted
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    for r in found:
        assert texts[r.doc_id][r.start : r.end] not in left[r.doc_id]
    assert all(left[j] == texts[j] for j in range(60, 120))


def test_short_repeats_stay_by_default(spark):
    rng = random.Random(9)
    part = filler(rng, 50)
    df = spark.createDataFrame([(i, f"{filler(rng, 30)} {part} {filler(rng, 30)}") for i in range(3)], "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.without_repeats(df).collect())) == sorted(map(tuple, df.collect()))


def test_within_a_document(spark):
    rng = random.Random(6)
    part = filler(rng, 80)
    df = spark.createDataFrame([(1, f"{part} and then {part}")], "doc_id long, text string")
    assert substring_dedup.passages(df).count() == 0
    [r] = substring_dedup.passages(df, within=True).collect()
    assert (r.keep_doc_id, r.start, r.end, r.words) == (1, len(part) + 10, 2 * len(part) + 10, 80)


def test_odd_rows(odd, clashing, empty, odd_rows):
    left = substring_dedup.without_repeats(clashing, words=2)
    assert left.columns == clashing.columns and left.count() == len(odd_rows)
    assert substring_dedup.passages(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


def test_query(spark, small):
    want = brute([(r.doc_id, r.text) for r in read(spark, small).collect()])
    assert collect(QUERIES["op6_substring_dedup"](spark, small)) == want and want
