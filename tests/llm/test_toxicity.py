import random

import pytest
from llm.conftest import read

from cohortwarn.llm import toxicity
from cohortwarn.llm.common import held_out
from cohortwarn.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_over_the_trie_is_edit_distance(edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
    terms = {w for _ in range(40) if (w := word())}
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms})
    for _ in range(500):
        w = word()
        best = min((distance(w, t), t) for t in terms)
        assert lexicon.within(w, edits) == ((best[1], best[0]) if best[0] <= edits else None)


def test_the_filter_before_the_automaton_loses_nothing():
    rng = random.Random(9)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms})
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(5, 8)))
        near = min(distance(w, t) for t in terms) <= 1
        assert (lexicon.find(w) is not None) == near


def test_kinds_and_context():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "vequ*": 3.0})
    kinds = lambda text: [(h[1], h[4]) for h in lexicon.hits(text)]
    assert kinds("You are an idiot, really") == [("exact", False)]
    assert kinds("an Idiit and an id1ot") == [("near", False), ("near", False)]
    assert kinds("vequille vequ") == [("stems", False)]
    assert kinds('He said "idiot" to nobody') == [("exact", True)]
    assert kinds('The text "what an idiot he" goes on') == [("exact", True)]
    assert kinds('You, you idiot, said it') == [("exact", False)]
    assert lexicon.features('He said "idiot" to nobody')[0] == 0.0
    assert kinds("") == []


def test_learned_from_labels(spark, medium):
    docs, labels = read(spark, medium), read(spark, medium, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter(held_out()).collect()
    bad = [r for r in scored if r.toxic]
    good = [r for r in scored if not r.toxic]
    assert sum(r.predicted for r in bad) >= 0.6 * len(bad) and sum(r.predicted for r in good) <= 0.02 * len(good)
    assert sum(r.score for r in bad) / len(bad) > 0.5 > sum(r.score for r in good) / len(good)


def test_labels_of_the_held_out_third_are_not_read(spark, medium):
    docs, labels = read(spark, medium), read(spark, medium, "labels")
    turned = labels.filter(~held_out()).union(labels.filter(held_out()).selectExpr("doc_id", "quality", "1 - toxic"))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert a.weights == b.weights and a.coefficients == b.coefficients


def test_odd_rows(spark, odd, clashing, empty, empty_labels, odd_rows):
    model = toxicity.Model({"hello": 4.0}, [3.0, 0, 0, 0, 0, 0], -1.5)
    for docs in (odd, clashing):
        found = toxicity.score(docs, model).collect()
        assert len(found) == len(odd_rows)
        assert {r.predicted for r in found if not (r.text or "").strip()} == {0}
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert toxicity.score(empty, model).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (empty_labels, one):  # not both classes: no lexicon, every text alike
        flat = toxicity.learn(odd, labels)
        assert flat.weights == {} and len({r.score for r in toxicity.score(odd, flat).collect()}) == 1
    left = toxicity.keep_civil(clashing, empty_labels)
    assert left.columns == clashing.columns and left.count() == len(odd_rows)
    assert toxicity.keep_civil(empty, empty_labels).count() == 0


def test_query(spark, small):
    found = QUERIES["op7_toxicity"](spark, small)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == read(spark, small).count()
