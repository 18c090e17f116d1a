import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortwarn.operators import ranks


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_hash_rank_is_the_row_number_in_hash_order(people):
    got = {r.id: r.hash_rank for r in ranks.hash_rank(people, ["id"], 5, ["y"]).collect()}
    spec = Window.partitionBy("y").orderBy(F.md5(F.concat_ws("|", F.lit("5"), F.col("id").cast("string"))), "id")
    want = {r.id: r.rn - 1 for r in people.withColumn("rn", F.row_number().over(spec)).collect()}
    assert got == want


def test_rank_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id long, y long")
    got = ranks.hash_rank(df, ["id"], 5, ["y"]).collect()
    assert sorted((r.y is None, r.hash_rank) for r in got) == [(False, 0), (True, 0), (True, 1)]


@pytest.mark.parametrize("n, kwargs, want", [
    (143, {"train": 0.8}, 114), (143, {"test": 0.2}, 114), (10, {"test": 0.25}, 7), (1, {"train": 0.8}, 0),
    (5, {"train": 1.0}, 5), (0, {"train": 0.8}, 0)])
def test_split_sizes(spark, n, kwargs, want):
    train, test = ranks.split(spark.range(n), ["id"], **kwargs)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert len(a) == want and not a & b and a | b == set(range(n))


def test_split_does_not_depend_on_partitioning_but_on_seed(people):
    def pick(df, seed):
        return {r.id for r in ranks.split(df, ["id"], train=0.7, seed=seed)[0].collect()}

    assert pick(people.repartition(1), 3) == pick(people.repartition(7), 3) != pick(people, 4)


def test_rows_with_one_key_stay_together(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id")
    train, test = ranks.split(df, ["k"], train=0.8)
    a = {r.k for r in train.collect()}
    b = {r.k for r in test.collect()}
    assert not a & b and len(a | b) == 2


def test_split_needs_one_share(people):
    with pytest.raises(ValueError):
        ranks.split(people, ["id"], train=0.5, test=0.5)


def test_threshold_split_is_a_partition(people):
    a, b = ranks.threshold_split(people, ["id"], 0.8)
    assert a.count() + b.count() == 1000 and 700 < a.count() < 900


def test_folds_are_stratified(people):
    got = ranks.assign_folds(people, ["id"], "y", 4).groupBy("y", "fold").count().collect()
    for y, n in ((0, 666), (1, 334)):
        sizes = [r["count"] for r in got if r.y == y]
        assert len(sizes) == 4 and sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=500), np.full(400, 1.5), rng.exponential(size=101) * 1e6, [-0.0, 0.0, 1e-320, -1e300]])
    data = [("hot", float(v)) for v in x] + [("one", 3.0), ("nan", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in ranks.quantiles(df, ["g"], "v", probs).collect()}
    want = {("hot", p): float(np.quantile(x, p)) for p in probs} | {("one", p): 3.0 for p in probs}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_neighbouring_doubles_are_told_apart(spark):
    values = [np.nextafter(1.0, 2.0), 1.0, np.nextafter(1.0, 0.0)] + [float(2**52 + i) for i in range(4)]
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    got = {r.prob: r.value for r in ranks.quantiles(df, ["g"], "v", [i / 6 for i in range(7)]).collect()}
    assert [got[i / 6] for i in range(7)] == sorted(values)


def test_several_columns_in_the_same_passes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 3), int(a), float(b), None if i % 5 else int(a) * 10**12) for i, (a, b) in
            enumerate(zip(rng.integers(-50, 500, 300), rng.normal(size=300), strict=True))]
    df = spark.createDataFrame(rows, "g int, a int, b double, c long")
    got = {(r.g, r.variable, r.prob): r.value for r in ranks.quantiles_of(df, ["g"], ["a", "b", "c"], [0.1, 0.5]).collect()}
    for g in range(3):
        for j, name in enumerate("abc", 1):
            x = [r[j] for r in rows if r[0] == g and r[j] is not None]
            for p in (0.1, 0.5):
                assert got[g, name, p] == pytest.approx(float(np.quantile(x, p)))


def test_a_hot_group_is_counted_before_the_shuffle(spark, monkeypatch):
    """No pass sends rows of a group to one task: it sends 16-bit counts, joined by key to the few open buckets."""
    seen = []
    real = ranks.stable
    monkeypatch.setattr(ranks, "stable", lambda df, name: seen.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    df = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), F.rand(5).alias("v"))
    ranks.quantiles(df, ["g"], "v", [0.5]).collect()
    assert 2 <= len(seen) <= 5
    for plan in seen:
        # Windows and lists stand above the count only.
        below = plan[plan.index("Aggregate [g"):]
        assert "Window" not in below.split("Join")[0] and "collect_list(_v" not in plan and "percentile" not in plan


def test_integer_quantiles(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 10)], "g string, v int")
    got = {r.prob: r.value for r in ranks.quantiles(df, ["g"], "v", [0.25, 0.5]).collect()}
    assert got == {0.25: 1.75, 0.5: 2.5}


def test_cutting_does_not_shuffle_the_rows(people):
    plan = ranks.mark_split(people, ["id"], train=0.8)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main
