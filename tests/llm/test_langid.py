import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from llm.conftest import read

from cohortwarn.llm import langid
from cohortwarn.llm.common import held_out
from cohortwarn.llm.queries import QUERIES


def model():
    words = {"the": [-1.0, -9.0], "und": [-9.0, -1.0]}
    grams = {"sch": [-8.0, -2.0], "ing": [-2.0, -8.0], "a": [-1.0, -1.5]}
    return langid.Model(["en", "de"], words, grams)


def test_words_come_first_then_long_grams_then_short():
    predict = model().predictor()
    assert predict("the the und") == ("en", 1 / (1 + np.exp(-8)))
    assert predict("schting schsch")[0] == "de"
    assert predict("singing")[0] == "en"
    assert predict("aa")[0] == "en"  # single letters
    assert predict("zzz") == ("en", 0.5)  # letters, but nothing known: all languages alike
    assert predict("und, UND! (the)") [0] == "de"


def test_no_letters_is_undetermined():
    predict = model().predictor()
    for text in (None, "", "  ", "12 34", "!!! _ _", "½ ²"):
        assert predict(text) == ("und", 0.0)


def test_counts_and_bounds(spark):
    rows = spark.createDataFrame(
        [("a", "x", 5), ("a", "y", 3), ("a", "z", 3), ("a", "w", 1), ("b", "x", 1)], "lang string, term string, n long")
    kept = lambda most: sorted((r.lang, r.term, r.total) for r in langid.frequent(rows, most).collect())
    assert kept(1) == [("a", "x", 12), ("b", "x", 1)]
    assert kept(2) == [("a", "x", 12), ("b", "x", 1)]  # terms with equal counts are kept together or not at all
    assert kept(3) == [("a", "x", 12), ("a", "y", 12), ("a", "z", 12), ("b", "x", 1)]


def test_held_out_accuracy(spark, medium):
    docs = read(spark, medium)
    found = langid.predict(docs, langid.learn(docs)).filter(held_out()).filter("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    turned = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 "
                             "then 'xx' else lang end as lang")
    assert langid.learn(turned).languages == langid.learn(docs).languages


def test_odd_rows(odd, clashing, empty, odd_rows):
    learned = langid.learn(odd)
    for docs in (odd, clashing):
        found = langid.predict(docs, learned).collect()
        assert len(found) == len(odd_rows)
        assert {r.lang_pred for r in found if r.text is None or not any(c.isalpha() for c in r.text)} == {"und"}
        assert all(0 <= r.score <= 1 for r in found)
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, learned).count() == 0


def test_query(spark, small):
    found = QUERIES["op9_language"](spark, small)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == read(spark, small).count()


def test_rare_and_letterless_languages_take_nothing_from_others(spark):
    learned = [i for i in range(1, 900) if zlib.crc32(str(i).encode()) % 3 != 1]
    english = ["the report of the day came to the people in the town", "words of the people and the town are here"]
    rows = [(i, english[i % 2], "en") for i in learned[:200]]
    rows += [(i, "hyvää päivää kaikille", "fi") for i in learned[200:203]] + [(i, "12 34 56", "xx") for i in learned[203:210]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.learn(docs)).collect()
    assert {(r.lang, r.lang_pred) for r in found} == {("en", "en"), ("fi", "fi"), ("xx", "und")}


def plain_model(rows):
    """Counts of words and n-grams with dictionaries; every word is known, every n-gram kept."""
    words, pieces = defaultdict(Counter), defaultdict(Counter)
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            words[lang].update(w for t in text.lower().split() for w in regex.findall(r"\p{L}+", t))
    for lang, counts in words.items():
        for word, n in counts.items():
            for size in range(1, 6):
                for g in langid.grams(word, size):
                    pieces[lang][g] += n
    return {k: v for k, v in words.items() if v}, pieces


def plain_scores(text, words, pieces):
    langs = sorted(words)
    found = [w for t in (text or "").lower().split() for w in regex.findall(r"\p{L}+", t)]
    floor = math.log(0.5 / (max(sum(c.values()) for c in words.values()) + 1))
    by_length = {n: {x: {g: k for g, k in pieces[x].items() if len(g) == n} for x in langs} for n in range(1, 6)}
    log = lambda counts, term, total: math.log((counts[term] + 0.5) / (total + 1)) if counts.get(term) else None

    def vector(term, tables):
        values = [log(tables[x], term, sum(tables[x].values())) for x in langs]
        return None if all(v is None for v in values) else np.array([floor if v is None else v for v in values])

    total = np.zeros(len(langs))
    for w in found:
        v = vector(w, words)
        n = 5
        while v is None and n:
            some = [x for g in langid.grams(w, n) if (x := vector(g, by_length[n])) is not None]
            v, n = (np.mean(some, axis=0) if some else None), n - 1
        total += 0 if v is None else v
    return (langs[int(total.argmax())], float(1 / np.exp(np.maximum(total - total.max(), -700)).sum())) if found else ("und", 0.0)


@pytest.mark.parametrize("in_memory", [0, 3, 200_000])
def test_learned_words_and_scores_against_plain_python(spark, in_memory):
    """No learned word is dropped, however few are in memory; a tie of all counts empties no language."""
    rng = random.Random(in_memory)
    vocab = {x: [f"{a}{b}{rng.choice(tail)}" for a in "abcdé" for b in "lmno"] for x, tail in (("en", "th"), ("de", "ßt"), ("fr", "éa"))}
    rows = []
    for i in range(90):
        lang = rng.choice(list(vocab))
        words = [rng.choice(vocab[lang] + ["x²", "Die", "½", "12ab!"]) for _ in range(rng.randint(0, 15))] + [f"new{lang}{i}"] * (i % 3)
        rows.append((i, " ".join(words) + rng.choice(["", ".", "\u2003end", "\n"]), rng.choice([lang, lang, lang, None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    words, pieces = plain_model(rows)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.learn(df, words=in_memory)).collect()}
    for doc_id, text, _ in rows:
        want = plain_scores(text, words, pieces)
        assert found[doc_id][0] == want[0] and found[doc_id][1] == pytest.approx(want[1])
