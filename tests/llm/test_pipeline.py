"""The pipeline against plain Python, stage by stage, each on its own input."""

import hashlib
from collections import Counter, defaultdict

import pytest
from llm.conftest import read
from llm.test_bpe_automaton import LIBRARY
from llm.test_simhash import plain_fingerprint, reachable

import corpus_pipeline
from cohortwarn.llm import mixing, toxicity
from cohortwarn.session import stable


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = read(spark, small), []
    for name, stage in corpus_pipeline.STAGES:
        after = stable(stage(spark, docs, small), "test-stage")
        out.append((name, docs.collect(), after.collect(), docs, after))
        docs = after
    return out


def test_columns(stages):
    for _, _, _, before, after in stages[:-1]:
        assert after.columns == before.columns
    assert {"n_tokens", "token_ids"} <= set(stages[-1][4].columns)


def test_toxic_documents_go(spark, small, stages):
    _, before, after, docs, _ = stages[0]
    score = toxicity.learn(docs, read(spark, small, "labels")).scorer()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if score(r.text) < toxicity.THRESHOLD)


def test_one_of_equal_texts_stays(stages):
    _, before, after, *_ = stages[1]
    last = {}
    for r in before:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        last[norm] = max(last.get(norm, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())


def test_one_of_each_near_group_stays(stages):
    _, before, after, *_ = stages[2]
    group = reachable({r.doc_id: plain_fingerprint(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(group.values()))


def test_documents_are_taken_as_mixed(stages):
    _, before, after, docs, _ = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in after) == {i: c for i, c in copies.items() if c}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    for r in after:
        taken[r.source] += len((r.text or "").split())
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.1)


def test_encoded_as_the_library(stages):
    _, before, after, *_ = stages[4]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    for r in after:
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_is_its_stages(spark, small, stages):
    found = corpus_pipeline.run(spark, small)
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert Counter(map(key, found.collect())) == Counter(map(key, stages[-1][2]))


def test_stages_on_odd_tables(spark, small, odd, empty, odd_rows):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stable(stage(spark, docs, small), "test-stage")
        assert docs.count() <= 3 * len(odd_rows)
