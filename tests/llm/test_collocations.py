import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import read

from cohortwarn.llm import collocations
from cohortwarn.llm.queries import QUERIES

SCHEMA = "text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, least=30, top=2000):
    """The contract in plain Python: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def collect(df):
    return sorted(map(tuple, df.collect()))


def texts(rng, n, vocabulary=12, length=40):
    words = ["Word", "aé", "B2", "x", "the", "of", "…", "quo\xa0ted", "日本", "it's", "UND", "zz"][:vocabulary]
    seps = [" ", " ", " ", "\t ", ", ", ". ", "\n", "!", "  "]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("shards", [1, 2, 3, 5])
def test_against_plain_python(spark, shards):
    rng = random.Random(shards)
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts(rng, 120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collect(collocations.collocations(df, least=5, shards=shards)) == brute(rows, least=5)


def test_shared_slots_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLOTS", (4, 4))
    rng = random.Random(7)
    rows = [(t, "en") for t in texts(rng, 150)] + [(" ".join(f"w{rng.randint(0, 60)}" for _ in range(50)), "en") for _ in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert collect(collocations.collocations(df, least=8)) == brute(rows, least=8)


def test_memory_of_a_slice():
    """Words are cut with numbers of 32 bits."""
    size, text = 2_000_000, "some-longer-words stand-between-blanks. "
    langs, rows = pa.array(["en"]), pa.array([text * (size // len(text))])
    tracemalloc.start()
    try:
        found = collocations.Words(langs, rows)
        assert len(found.ids) == 2 * (size // len(text)) and tracemalloc.get_traced_memory()[1] < 20 * size
    finally:
        tracemalloc.stop()


def test_keys_go_back_to_columns():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 20, 1 << 31):
        columns = [rng.integers(0, size, 500) for _ in range(4)]
        key, unpack = collocations._packed(columns, size)
        assert all((a == b).all() for a, b in zip(unpack(key), columns, strict=True))


def test_odd_rows(spark, odd, clashing, empty, odd_rows):
    rows = [(r[1], r[2]) for r in odd_rows]
    want = brute(rows, least=3)
    for docs in (odd, clashing):
        assert collect(collocations.collocations(docs, least=3)) == want and want
    assert collocations.collocations(empty).count() == 0
    # One phrase over and over, ties in all values, a language of its own for every row.
    same = [("a b c d " * 2000, "x")] + [(f"p{i} q{i} " * 40, "y") for i in range(5)] + [("k l. " * 30, f"l{i}") for i in range(80)]
    assert collect(collocations.collocations(spark.createDataFrame(same, SCHEMA))) == brute(same)


def test_query(spark, small):
    rows = [(r.text, r.lang) for r in read(spark, small).collect()]
    assert collect(QUERIES["op13_collocations"](spark, small)) == brute(rows)
