import random
import re

import xxhash
from llm.conftest import read

from cohortwarn.llm import simhash
from cohortwarn.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints):
    """Smallest id that links of at most two bits reach, by comparing all."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 50):
        text = " ".join(rng.choice(["Aa", "é", "b", " x", "c\x1cd"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint("A b") == simhash.fingerprint("a\tB\n")


def test_chains_and_hot_buckets(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(5):
        x = y = rng.getrandbits(64)
        for _ in range(50):
            y ^= 1 << rng.randrange(64)  # a chain
            prints |= {y, x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(8)}  # a crowd around x
    want = reachable({signed(x): x for x in prints})
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for bucket in (simhash.BUCKET, 6):  # with 6, buckets are filed again on all levels
        links = simhash.links(df, bucket).collect()
        assert len(links) <= 6 * 7 * len(prints)
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
        roots = dict(map(tuple, simhash.components(simhash.links(df, bucket)).collect()))
        groups = {x: roots.get(x, x) for x in want}
        assert {x: min(y for y in want if groups[y] == groups[x]) for x in want} == want


def test_a_path_of_many_nodes(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (500, 501)], "a long, b long")
    roots = dict(map(tuple, simhash.components(edges).collect()))
    assert roots == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}


def test_free_bits():
    assert simhash.free_bits(0) == list(range(64))
    assert simhash.free_bits(1) == list(range(32, 64))  # the first two quarters are fixed
    assert simhash.free_bits(1 * 16 + 1) == list(range(48, 64))
    assert len(simhash.free_bits((11 * 16 + 2) * 16 + 7)) == 8


def expected(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    group = reachable({k: k for k in prints})
    out = []
    for fp, ids in prints.items():
        near = [i for other, ids2 in prints.items() if group[other] == group[fp] for i in ids2 if i is not None]
        out += [(i, signed(fp), min(near, default=None)) for i in ids]
    return sorted(out, key=repr)


def test_odd_rows(odd, clashing, empty, odd_rows):
    want = expected([r[:2] for r in odd_rows])
    for docs in (odd, clashing):
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == want
    left = simhash.keep_first(clashing)
    assert left.columns == clashing.columns
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted(
        {c for i, _, c in want if i is not None})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_query(spark, medium):
    rows = [(r.doc_id, r.text) for r in read(spark, medium).collect()]
    found = QUERIES["op10_simhash"](spark, medium).collect()
    want = {i: (f"{fp & (1 << 64) - 1:016x}", c) for i, fp, c in expected(rows)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == want and len(found) == len(rows)
