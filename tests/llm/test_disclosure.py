import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from llm.conftest import read

from cohortwarn.llm import disclosure
from cohortwarn.llm.queries import QUERIES


def brute(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, disclosure.KINDS[k]) for a, k, b in sorted(out)]


@pytest.mark.parametrize("alphabet", ["ab1.@-+ ", "0123456789.", "0123456789 -", "+01234567 ().-", "a@b.c@ 1..2+é"])
def test_base_spans_as_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(10_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
        assert disclosure.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    text = "1" * 200_000 + "@" + "a" * 200_000 + " " + "1." * 100_000 + "+" + " " * 100_000
    assert isinstance(disclosure.base_spans(text), list)


def people(n=60):
    """Documents in which a rare name goes with an address, and common words with everything."""
    rows = [(i, f"the report of day {i} and more common words") for i in range(n)]
    for i in range(4):
        rows.append((n + i, f"letter {i} came: Zaphod wrote to zaphod.b@example.org about the report"))
    rows.append((n + 9, "Zaphod alone without any address in the report"))
    return rows


def test_terms_that_reveal_an_entity(spark):
    df = spark.createDataFrame(people(), "doc_id long, text string")
    found = {r.doc_id: r for r in disclosure.find(df).collect()}
    one = found[60]
    text = dict(people())[60]
    spans = [s.split(":") for s in one.spans.split(",")]
    terms = [text[int(a) : int(b)] for k, a, b in spans if k == "term"]
    # The name and the verb come with the address only (the name once without); common words come everywhere.
    assert "Zaphod" in terms and "wrote" in terms and "report" not in terms and "the" not in terms
    assert spans == sorted(spans, key=lambda s: int(s[1]))
    assert one.n_email == 1 and found[69].spans == "" and found[0].spans == ""
    clean = {r.doc_id: r.clean_text for r in disclosure.sanitise(df).collect()}
    assert "Zaphod" not in clean[60] and "[EMAIL]" in clean[60] and "[WORD]" in clean[60]
    assert clean[69] == dict(people())[69]


def test_words_seen_once_prove_nothing(spark):
    rows = [*people()[:60], (80, "Marvin may be met at marvin@example.org today"),
            (81, "Marvin may be met at marvin@example.org today")]
    found = {r.doc_id: r for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term" not in found[80].spans and found[80].n_email == 1  # two copies are one text


def plain_terms(rows):
    """(doc_id, start, end) of all added spans, by counting in dictionaries; texts may repeat."""
    n, by_text, held, n_t = len(rows), {}, {}, Counter()
    for _, text in rows:
        by_text[text] = by_text.get(text, 0) + 1
    for text, copies in by_text.items():
        for t in {w.strip(disclosure.STRIP) for w in text.lower().split()}:
            n_t[t] += copies
        spans = brute(text)
        found = disclosure.terms(text, spans)
        held[text] = ({disclosure.entity(k, text[a:b]) for a, b, k in spans}, {x["term"] for x in found}, found)
    owners = defaultdict(set)
    for text, (entities, _, _) in held.items():
        for e in entities:
            owners[e].add(text)
    marked = defaultdict(set)
    for texts in {frozenset(v) for v in owners.values()}:
        n_e = sum(by_text[t] for t in texts)
        for term in {w for t in texts for w in held[t][1]} if n_e < n else ():
            both = [t for t in texts if term in held[t][1]]
            known = sum(by_text[t] for t in both) * (len(both) - disclosure.DOUBT) / len(both)
            if math.log(known * n / (n_t[term] * n_e)) / math.log(n / n_e) >= disclosure.GENERALISE:
                for t in both:
                    marked[t].add(term)
    return {(i, x["start"], x["end"]) for i, text in rows for x in held[text][2] if x["term"] in marked[text]}


def added(found):
    return {(r.doc_id, x["start"], x["end"]) for r in found for x in r.added or []}


def test_added_terms_of_a_given_table(spark, medium):
    rows = [(r.doc_id, r.text or "") for r in read(spark, medium).collect()]
    found = added(disclosure.find(read(spark, medium)).collect())
    assert found == plain_terms(rows) and found


def test_added_terms_of_entities_in_several_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        words = [f"word{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(3, 30))]
        words += [f"p{rng.randint(0, 12)}@example.org" for _ in range(rng.choice((0, 0, 1, 2, 5)))]
        rng.shuffle(words)
        rows += [(len(rows) + j, " ".join(words)) for j in range(rng.choice((1, 1, 1, 3)))]
    found = added(disclosure.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert found == plain_terms(rows) and found


def test_odd_rows(odd, clashing, empty, odd_rows):
    for docs in (odd, clashing):
        found = disclosure.find(docs).collect()
        assert len(found) == len(odd_rows)
        assert {r.base_sha256 for r in found if not r.base} == {hashlib.sha256(b"").hexdigest()}
    cleaned = disclosure.sanitise(clashing)
    assert cleaned.count() == len(odd_rows) and cleaned.columns.count("spans") == 1
    assert disclosure.find(empty).count() == 0 and disclosure.sanitise(empty).count() == 0


def test_query(spark, medium):
    texts = {r.doc_id: r.text or "" for r in read(spark, medium).collect()}
    found = QUERIES["op8_personal_data"](spark, medium).collect()
    assert len(found) == len(texts)
    for r in found:
        base = brute(texts[r.doc_id])
        names = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k in disclosure.KINDS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == names


def test_terms_far_from_the_entity(spark):
    far = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"the report {far}") for i in range(60)]
    rows += [(60 + i, f"Dear Trillian letter {i} {far} write to tm@example.org or ask Trillian") for i in range(3)]
    found = {r.doc_id: r for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, spans = dict(rows)[60], [s.split(":") for s in found[60].spans.split(",")]
    terms = [text[int(a) : int(b)] for k, a, b in spans if k == "term"]
    assert terms.count("Trillian") == 2 and "common3" not in terms
