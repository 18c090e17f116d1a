import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwarn.operators import neighbours, smote
from cohortwarn.operators.neighbours import nearest_neighbours


def brute(q: pd.DataFrame, r: pd.DataFrame, k: int):
    out = {}
    for row in q.itertuples():
        d = (r.a - row.a) ** 2 + (r.b - row.b) ** 2
        t = pd.DataFrame({"d": d, "k": r.k})
        out[row.k] = list(t[t.k != row.k].sort_values(["d", "k"]).head(k).k)
    return out


@pytest.fixture(scope="module")
def cloud():
    """A third of the rows are copies of one point; many ties elsewhere."""
    rng = np.random.default_rng(0)
    n = 900
    pdf = pd.DataFrame({"k": np.arange(n), "a": rng.integers(0, 20, n) * 1.0, "b": rng.normal(size=n).round(1),
                        "y": (rng.random(n) > 0.2) * 1.0})
    pdf.loc[: n // 3, ["a", "b"]] = [3.0, 0.5]
    return pdf


@pytest.mark.parametrize("leaf_rows, visitors", [(4096, 8192), (60, 8)])
def test_exact_against_brute_force(spark, cloud, leaf_rows, visitors):
    df = spark.createDataFrame(cloud)
    out = nearest_neighbours(df.filter("y = 0"), df, "k", ["a", "b"], 6, "y", leaf_rows, visitors)
    got = {r.k: [n.key for n in r.neighbours] for r in out.collect()}
    assert got == brute(cloud[cloud.y == 0], cloud, 6)


def test_distances_and_tags_belong_to_the_neighbour(spark, cloud):
    df = spark.createDataFrame(cloud)
    at = cloud.set_index("k")
    for r in nearest_neighbours(df.filter("y = 0"), df, "k", ["a", "b"], 3, "y").collect():
        for n in r.neighbours:
            assert n.tag == at.y[n.key] and tuple(n.vec) == (at.a[n.key], at.b[n.key])
            assert n.d2 == pytest.approx((r.a - n.vec[0]) ** 2 + (r.b - n.vec[1]) ** 2)


def test_all_rows_alike(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.lit(1.0).alias("a"), F.lit(-0.0).alias("b"))
    got = {r.k: [n.key for n in r.neighbours] for r in nearest_neighbours(df, df, "k", ["a", "b"], 2).collect()}
    assert got[0] == [1, 2] and got[1] == [0, 2] and got[49] == [0, 1]


def test_fewer_rows_than_wanted(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "k long, a double")
    got = {r.k: [n.key for n in r.neighbours] for r in nearest_neighbours(df, df, "k", ["a"], 5).collect()}
    assert got == {1: [2], 2: [1]}


def test_text_keys(spark):
    df = spark.createDataFrame([("x", 0.0), ("y", 1.0), ("z", 1.0)], "k string, a double")
    got = {r.k: [n.key for n in r.neighbours] for r in nearest_neighbours(df, df, "k", ["a"], 1).collect()}
    assert got == {"x": ["y"], "y": ["z"], "z": ["y"]}


@pytest.mark.parametrize("kind", [smote.smote, smote.borderline_smote2])
def test_resampling_balances_and_repeats(spark, cloud, kind):
    def run(parts):
        df = spark.createDataFrame(cloud).repartition(parts)
        return kind(df, "k", ["a", "b"], "y", seed=7).toPandas().sort_values(["k", "syn_no"]).reset_index(drop=True)

    one, two = run(1), run(6)
    pd.testing.assert_frame_equal(one, two)
    assert one.groupby("y").size().nunique() == 1
    assert not one.duplicated(["k", "syn_no"]).any()
    kept = one[one.syn_no == 0]
    assert len(kept) == len(cloud)
    per = one[one.syn_no > 0].groupby("k").size()
    assert per.max() - per.min() <= 1


def test_new_rows_lie_on_a_segment_to_a_neighbour(spark, cloud):
    out = smote.smote(spark.createDataFrame(cloud), "k", ["a", "b"], "y", k=4, seed=7).toPandas()
    small = cloud[cloud.y == 0]
    near, at = brute(small, small, 4), cloud.set_index("k")
    for r in out[out.syn_no > 0].itertuples():
        base, p = at.loc[r.k, ["a", "b"]].to_numpy(), np.array([r.a, r.b])
        ends = [at.loc[n, ["a", "b"]].to_numpy() for n in near[r.k]]
        gaps = [np.linalg.norm(p - base) + np.linalg.norm(e - p) - np.linalg.norm(e - base) for e in ends]
        assert min(gaps) < 1e-9


def test_danger_counts(spark, cloud):
    out = smote.danger_points(spark.createDataFrame(cloud), "k", ["a", "b"], "y", m=7).collect()
    near, at = brute(cloud[cloud.y == 0], cloud, 7), cloud.set_index("k")
    for r in out:
        n = sum(at.y[x] != 0 for x in near[r.k])
        assert r.n_majority == n and r.danger == int(3.5 <= n < 7)


def test_no_border_adds_nothing(spark):
    data = [(i, float(i % 3), 0.0) for i in range(8)] + [(i, 1e6 + i, 1.0) for i in range(8, 30)]
    df = spark.createDataFrame(data, "k long, a double, y double")
    assert smote.borderline_smote2(df, "k", ["a"], "y", m=4).count() == 30


def test_too_few_rows_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 1.0)], "k long, a double, y double")
    with pytest.raises(ValueError, match="too few"):
        smote.smote(df, "k", ["a"], "y")


def test_many_features_and_clustered_queries(spark, monkeypatch):
    """Queries that all fall into few leaves are split, and few boxes are visited in the second round."""
    from cohortwarn.operators import neighbours

    rng = np.random.default_rng(8)
    n, features = 1200, [f"f{j}" for j in range(8)]
    x = rng.normal(size=(n, 8))
    x[:200] = 0.1 * rng.normal(size=(200, 8))  # the cluster
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"k long, {', '.join(f'{f} double' for f in features)}")
    visited, sizes, real = [], [], neighbours.Placement._search_leaves

    def counted(self, travel, wants, schema):
        per_leaf = travel.groupBy("_block", "_leaf").count().collect()
        visited.append(sum(r["count"] for r in per_leaf))
        sizes.append(max((r["count"] for r in per_leaf), default=0))
        return real(self, travel, wants, schema)

    monkeypatch.setattr(neighbours.Placement, "_search_leaves", counted)
    out = neighbours.nearest_neighbours(df.filter("k < 200"), df, "k", features, 4, leaf_rows=40, visitors=16)
    got = {r.k: [e.key for e in r.neighbours] for r in out.collect()}
    for i in range(200):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert got[i] == np.argsort(d, kind="stable")[:4].tolist()
    leaves = df.count() / 40
    assert len(visited) == 3 and visited[0] == 200 and visited[1] <= 200 * neighbours.FIRST_BOXES
    assert visited[2] < 200 * (leaves - 1 - neighbours.FIRST_BOXES)  # in eight dimensions most boxes overlap


@pytest.mark.parametrize("leaf_rows, visitors", [(4096, 8192), (30, 16)])
def test_lists_by_class_from_one_search(spark, cloud, leaf_rows, visitors):
    from cohortwarn.operators.neighbours import Placement

    df = spark.createDataFrame(cloud)
    placed = Placement(df, "k", ["a", "b"], 6, "y", leaf_rows, visitors)
    found = placed.search(df.filter("y = 0"), {"every": (None, 6), "small": (0.0, 4), "large": (1.0, 3), "none": (7.0, 2)})
    rows, asked = found.collect(), cloud[cloud.y == 0]
    wants = {"every": brute(asked, cloud, 6), "small": brute(asked, cloud[cloud.y == 0], 4), "large": brute(asked, cloud[cloud.y == 1], 3)}
    for name, want in wants.items():
        assert {r.k: [n.key for n in r[name]] for r in rows} == want
    assert all(r["none"] == [] for r in rows)
    with pytest.raises(ValueError):
        placed.search(df, {"every": (None, 7)})


def test_leaves_stay_small_and_trees_lie_in_blocks(spark):
    """There is no bound on leaves: a leaf holds few points, and the driver the square root of their number."""
    from cohortwarn.operators.neighbours import Placement

    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((6000, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    placed = Placement(df, "k", ["a", "b"], 3, leaf_rows=20)
    sizes = [r["count"] for r in placed.placed.groupBy("_block", "_leaf").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) > 200 and max(sizes) < 100 and len(placed.block_boxes) <= 18


def test_small_leaves_share_a_group(spark, cloud):
    """F16: a group holds several leaves, and a point is searched in its own leaf only."""
    from cohortwarn.operators import neighbours

    q = pd.DataFrame({"_vec": [np.array([0.0]), np.array([5.0]), np.array([9.0])], "_leaf": [1, 0, 7]})
    r = pd.DataFrame({"_vec": [np.array([x]) for x in (4.0, 0.5, 7.0, 5.5)], "_leaf": [1, 0, 1, 0],
                      "_key": [3, 2, 1, 0], "_tag": [0.0, 1.0, 1.0, 1.0]})
    out = neighbours._search([(None, 1), (1.0, 2)])(q, r)
    got: dict = {}
    for row in out.itertuples(index=False):
        got.setdefault((float(row[0][0]), row[1]), []).append(row[3])
    assert got == {(0.0, 0): [3], (5.0, 0): [0], (0.0, 1): [1], (5.0, 1): [0, 2]}
    placed = neighbours.Placement(spark.createDataFrame(cloud), "k", ["a", "b"], 3, leaf_rows=16, visitors=8)
    assert placed.bundle == neighbours.LEAF_ROWS // 16 and placed.visitors == 8 * placed.bundle


def test_distance_tables_fit_a_cache_and_cuts_of_queries_do_not_matter():
    from cohortwarn.operators import neighbours

    rng = np.random.default_rng(3)
    q, r = rng.integers(0, 4, (150, 3)).astype(float), rng.integers(0, 4, (neighbours.LEAF_ROWS, 3)).astype(float)
    assert neighbours._block(len(r)) * len(r) * 8 <= 1 << 20
    found = [np.concatenate(x) for x in zip(*neighbours._nearest(q, r, 3), strict=True)]
    d2 = ((q[:, None, :] - r[None, :, :]) ** 2).sum(axis=2)
    want = np.argsort(d2, axis=1, kind="stable")[:, :3]
    assert (found[0] == np.repeat(np.arange(len(q)), 3)).all()
    assert (found[1] == want.ravel()).all()
    assert (found[2] == np.take_along_axis(d2, want, axis=1).ravel()).all()


def test_a_visit_brings_back_what_is_within_its_bounds_only():
    """Leaves of one group, small and large, answer a query together: k rows of each list at most, none beyond its bound."""
    rng = np.random.default_rng(3)
    n = 2 * neighbours._SMALL + 40
    r = pd.DataFrame({"_vec": list(rng.integers(0, 30, (n, 2)) * 1.0), "_key": rng.permutation(n), "_tag": rng.integers(0, 2, n) * 1.0,
                      "_leaf": np.where(np.arange(n) < neighbours._SMALL + 20, 0, rng.integers(1, 8, n))})
    bounds = [9.0, 4.0]
    asked = [np.array([3.0 * i, 29.0 - i]) for i in range(10)]
    q = pd.DataFrame({"_vec": asked, "_leaf": 0, "_leaves": [np.arange(8)] * 10, "_bounds": [np.array(bounds)] * 10})
    got = neighbours._search([(None, 5), (1.0, 3)])(q, r)
    points = np.stack(r["_vec"])
    for v in asked:
        d2 = ((points - v) ** 2).sum(axis=1)
        for no, (of, k) in enumerate(((d2 <= 9, 5), ((d2 <= 4) & (r["_tag"] == 1), 3))):
            want = sorted(zip(d2[of], r["_key"][of], strict=True))[:k]
            here = got[(got["_list"] == no) & got["_vec"].map(lambda x, v=v: tuple(x) == tuple(v))]
            assert sorted(zip(here["_d2"], here["_key"], strict=True)) == want


def test_two_rounds_visit_every_leaf_once_in_whatever_order_boxes_arrive():
    """Eight boxes equally far away: the second round has to know which of them the first one went to."""
    boxes = pd.DataFrame({"_block": 0, "_leaf": range(9), "_lo": [np.zeros(2)] * 9, "_hi": [np.ones(2)] * 9})
    q = pd.DataFrame({"_vec": [np.full(2, 0.5)], "_block": 0, "_leaf": 4, "_reach": 1.0, "_bounds": [np.ones(1)]})
    seen = []
    for first, given in ((True, boxes), (False, boxes[::-1].reset_index(drop=True))):
        seen += [x for leaves in neighbours._leaves_in_reach(first, 3)(q, given)["_leaves"] for x in leaves]
    assert sorted(seen) == [0, 1, 2, 3, 5, 6, 7, 8]
