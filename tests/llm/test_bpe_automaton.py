import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import read
from tokenizers import Tokenizer

from cohortwarn.llm import bpe_automaton
from cohortwarn.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def merged(word, merges):
    """Byte-pair merging by its definition."""
    parts = list(word)
    for u, v in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


def test_automaton_accepts_what_merging_gives():
    rng = random.Random(1)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(0, 14)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        try:
            automaton = bpe_automaton.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        except ValueError:
            continue
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert automaton.decode(automaton.encode(word)) == merged(word, merges), (merges, word)


def test_two_merges_of_one_token_are_refused():
    tokens = {t: i for i, t in enumerate(["a", "b", "ab", "ba", "aba"])}
    with pytest.raises(ValueError):
        bpe_automaton.MergeAutomaton(tokens, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    mine = bpe_automaton.load(PATH)
    assert mine.encode(text) == want
    assert mine.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def check(found, rows):
    assert len(found) == len(rows)
    by_text = {r[1]: LIBRARY.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in found:
        ids = by_text[r.text]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.token_ids == ids


def test_odd_rows(odd, clashing, empty, odd_rows):
    check(bpe_automaton.encode(odd, PATH).collect(), odd_rows)
    found = bpe_automaton.encode(clashing, PATH)
    check(found.collect(), odd_rows)
    assert "score" in found.columns and found.columns.count("n_tokens") == 1
    assert bpe_automaton.encode(empty, PATH).count() == 0


def test_query(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op2_bpe"](spark, small).collect()}
    for r in read(spark, small).collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_long_texts_are_written_out_in_parts(spark, monkeypatch):
    """Digests do not depend on how many ids are written out at once; empty texts stand between."""
    texts = ["", "a b c", "word " * 5000, "", "", "x" * 300, "end of it all.", ""]
    mine = bpe_automaton.load(PATH)
    import pyarrow as pa

    ids, ends = mine.encode_array(pa.array(texts))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 3, 1000, 1 << 18):
        monkeypatch.setattr(bpe_automaton, "WRITTEN", size)
        assert mine.numbers.digests(ids, ends) == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want]
        assert mine.names.digests(ids, ends) == [
            hashlib.sha256(LIBRARY.decode(w, skip_special_tokens=False).encode()).hexdigest() for w in want]
