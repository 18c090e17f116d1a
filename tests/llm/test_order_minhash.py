import hashlib
import random

from llm.conftest import read

from cohortwarn.llm import order_minhash
from cohortwarn.llm.queries import QUERIES


def brute(text):
    """The signature by its definition, one hash function after the other."""
    codes = order_minhash.codes(text)
    x = order_minhash.numbered(codes)
    out = ""
    for i in range(order_minhash.HASHES):
        h = [int(v) for v in x * order_minhash._FACTORS[i] + order_minhash._SHIFTS[i]]
        places = sorted(sorted(range(len(h)), key=lambda p: (h[p], p))[: order_minhash.TUPLE])
        kmers = [0] * (order_minhash.TUPLE - len(places)) + [int(x[p]) for p in places]
        s = order_minhash._SHIFTS[i : i + 1].copy()
        for k in kmers:
            s = order_minhash.mix(s * order_minhash.np.uint64(3) + order_minhash.np.uint64(k))
        out += f"{int(s[0]) >> 48:04x}"
    return out


def test_numbers_of_occurrence():
    x = order_minhash.numbered(order_minhash.codes("abcabcabcabc"))
    assert len(x) == 8 and len(set(x.tolist())) == 8  # the same k-mer counts anew each time it comes


def test_signature_is_the_definition():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 6, 7, 30, 400, 5000):
        text = "".join(rng.choice("abcdé🙂 ") for _ in range(n))
        assert order_minhash.fingerprint(text) == brute(text)


def test_order_matters():
    words = [f"word{i}" for i in range(400)]
    text, back = " ".join(words), " ".join(words[200:] + words[:200])
    near = " ".join(words[:390] + words[395:])
    like = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / order_minhash.HASHES
    a, b, c = map(order_minhash.fingerprint, (text, back, near))
    assert like(a, c) > 0.8 and like(a, b) < 0.8


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        m = len(t) // 3
        out.append((i, t, t[: len(t) - m] + u[:m], u))
    return out


def check(found, rows):
    want = expected(rows)
    like = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / order_minhash.HASHES
    prints = {x: order_minhash.fingerprint(x) for r in want for x in r[1:]}
    rows = sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], prints[e],
                    like(prints[t], prints[e]), like(prints[t], prints[u])) for i, t, e, u in want], key=repr)
    assert sorted(map(tuple, found), key=repr) == rows


def test_odd_rows(spark, odd, clashing, empty, odd_rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for docs in (odd, clashing):
            check(order_minhash.compare_with_edited(docs).collect(), [r[:2] for r in odd_rows])
        one = odd.filter("doc_id = 1")
        check(order_minhash.compare_with_edited(one).collect(), [(1, "Hello World again")])
        assert order_minhash.compare_with_edited(empty).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_over_many_partitions(spark, small):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["op5_order_minhash"](spark, small).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(found, [(r.doc_id, r.text) for r in read(spark, small).collect()])
    assert sum(r.near_edited > r.near_next for r in found) > 0.95 * len(found)
