import re
from collections import defaultdict

import pytest
from llm.conftest import read
from pyspark.sql import functions as F

from cohortwarn.llm import mixing
from cohortwarn.llm.queries import QUERIES


def shares(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing again what sources cannot take, until none is above its limit."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[n] for n in full)
        open_ = sum(w[n] for n in names if n not in full)
        over = {n for n in names if n not in full and left * w[n] / open_ > limit * sizes[n]}
        if not over:
            return {n: limit * sizes[n] if n in full else left * w[n] / open_ for n in names}
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 5000, "c": 7, "d": 90, None: 20}, {"a": 0, "b": 10}, {"x": 4},
    {"a": 1, "b": 2, "c": 3, "d": 100_000}, {"a": 0, "b": 0}, {"Z": 5, "a": 1, "é": 900},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def test_words_are_taken_near_the_targets(spark, medium):
    found = mixing.mix(read(spark, medium)).collect()
    text = {r.doc_id: r.text for r in read(spark, medium).collect()}
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    assert target == pytest.approx(shares(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = mixing.mix(read(spark, medium).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_thresholds_are_nested_and_exact(spark, medium):
    rows = mixing.mix(read(spark, medium)).select("source", "size", "key").cache()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    before = {}
    for share in (0.1, 0.3, 0.30001, 0.8):
        cut = mixing.thresholds(rows, sizes.withColumn("target", F.col("source_size") * share)).collect()
        for c in cut:
            assert c.threshold >= before.get(c.source, "") and c.whole == 0
            before[c.source] = c.threshold
            mine = sorted((r.key, r.size) for r in rows.filter(F.col("source") == c.source).collect())
            got = sum(s for k, s in mine if k < c.threshold or (k == c.threshold and c.takes))
            want, best, run = share * sum(s for _, s in mine), None, 0
            for _, s in [("", 0), *mine]:
                run += s
                best = abs(run - want) if best is None else min(best, abs(run - want))
            assert abs(got - want) == pytest.approx(best)


def test_odd_rows(odd, clashing, empty, odd_rows):
    for docs in (odd, clashing):
        found = mixing.mix(docs).collect()
        assert len(found) == len(odd_rows)
        assert {r.size for r in found if r.doc_id in (3, 4, 5)} == {0}
        assert all(r.target <= 3 * r.source_size + 1e-6 for r in found)
        twice = [r.taken for r in found if r.doc_id == 2]
        assert len(twice) == 2 and len(set(twice)) == 1
    mixed = mixing.apply_mix(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(clashing).collect())
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_query(spark, small):
    found = QUERIES["op3_mixing"](spark, small)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert found.count() == read(spark, small).count()
