import random

from llm.conftest import read

from cohortwarn.llm import substring_dedup
from cohortwarn.llm.queries import QUERIES


def brute(rows, words=substring_dedup.PASSAGE):
    """Union of the copied windows of each document, with dictionaries of their texts."""
    first, out = {}, []
    windows = {}
    for doc_id, text in sorted({(i, t) for i, t in rows if i is not None and t}):
        places, at = [], 0
        for word in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" "):
            places += [(at, at + len(word))] * bool(word)
            at += len(word) + 1
        windows[doc_id] = [(a, b, text[a:b], i) for i, (a, b) in enumerate(zip(
            [p[0] for p in places], [p[1] for p in places[words - 1 :]], strict=False))]
        for w in windows[doc_id]:
            first.setdefault(w[2], doc_id)
    for doc_id, found in windows.items():
        run = None
        for a, b, text, i in found:
            if first[text] == doc_id:
                continue
            if run and a <= run[2]:
                run[2:4] = b, i
                continue
            if run:
                out.append(run)
            run = [doc_id, a, b, i, i, first[text]]
        out += [run] if run else []
    return sorted((d, a, b, j - i + words, k) for d, a, b, j, i, k in out)


def collect(df):
    return sorted(map(tuple, df.collect()))


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_every_later_copy_of_a_short_passage_is_found_at_its_place(spark):
    rng = random.Random(11)
    texts, want = [], []
    for i in range(600):
        n = rng.choice((50, 51, 52, 55, 60))
        passage, heads = filler(rng, n), [f"{filler(rng, rng.randint(0, 60))} ".lstrip() for _ in range(2)]
        texts += [f"{head}{passage} {filler(rng, rng.randint(1, 60))}" for head in heads]
        if n > 50:
            want.append((2 * i + 1, len(heads[1]), len(heads[1]) + len(passage), n, 2 * i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert collect(substring_dedup.passages(df)) == want


def test_repetitive_passages_at_shifted_offsets(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        part = filler(rng, rng.choice((1, 1, 2, 7)))
        passage = " ".join([part] * (60 // len(part.split()) + 1))
        rows += [(2 * i + j, f"{filler(rng, 3)[: rng.randint(1, 9)]} {passage} {filler(rng, 9)}") for j in range(2)]
    found = collect(substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows) and {r[0] for r in found} == set(range(1, 120, 2))


def test_passages_made_of_parts_of_other_documents(spark):
    rng = random.Random(13)
    a, b, c, d = [filler(rng, 30) for _ in range(4)]
    rows = [(1, f"{filler(rng, 20)} {a} {filler(rng, 20)}"), (2, f"{b} {filler(rng, 30)}"), (3, f"{c} {a} {b} {d}"),
            (4, f"{filler(rng, 5)} {a} {b} {filler(rng, 5)}"), (None, f"{a} {b}"), (5, None), (6, "")]
    found = collect(substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows) and [(r[0], r[3], r[4]) for r in found] == [(4, 60, 3)]


def test_passages_against_brute_force(spark, odd, clashing, odd_rows, small):
    for docs in (odd, clashing):
        assert collect(substring_dedup.passages(docs, words=2)) == brute([r[:2] for r in odd_rows], words=2)
    want = brute([(r.doc_id, r.text) for r in read(spark, small).collect()])
    assert collect(QUERIES["op6_substring_dedup"](spark, small)) == want and want
