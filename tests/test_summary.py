import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwarn.operators import hypotheses, summary
from cohortwarn.operators.clean import drop_missing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fail_counts_and_threshold(spark):
    data = [("M", "F")] * 6 + [("K", "F")] * 2 + [("K", "A")]
    df = spark.createDataFrame(data, "course string, grade string").withColumn("student_id", F.lit(1))
    assert [tuple(r) for r in summary.fail_counts(df).collect()] == [("M", 6), ("K", 2)]
    assert rows(summary.fail_counts(df, min_n=5)) == [("M", 6)]


def test_coverage_counts_values_not_nan(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, math.nan), (3, "c", None)], "id long, t string, x double")
    assert rows(summary.column_coverage(df, "tab")) == [("t", 2, "tab"), ("x", 1, "tab")]


def test_crosstab_is_zero_filled(spark):
    df = spark.createDataFrame([("A", 0.0), ("A", 0.0), ("B", 1.0)], "g string, p double")
    out = summary.crosstab(df, "g", "p", [0.0, 1.0], ["F", "P"])
    assert out.columns == ["g", "F", "P"] and rows(out) == [("A", 2, 0), ("B", 0, 1)]


def test_crosstab_loses_no_value(spark):
    df = spark.createDataFrame([("A", "E"), ("A", "X"), ("B", None)], "g string, p string")
    assert rows(summary.crosstab(df, "g", "p", ["E"], other="other")) == [("A", 1, 1), ("B", 0, 1)]
    with pytest.raises(Exception, match="values other than"):
        summary.crosstab(df, "g", "p", ["E"]).collect()


@pytest.fixture(scope="module")
def school(spark):
    grades = spark.createDataFrame(
        [(1, 1, "M", "F"), (2, 2, "M", "E"), (3, 3, "M", "-"), (4, 4, "M", None), (5, 5, "M", "A"), (6, 1, "M", "A"),
         (7, 6, "K", "F")], "id long, student_id long, course string, grade string")
    absence = spark.createDataFrame(
        [(1, "M", 2020, 1.0), (2, "M", 2020, None), (2, "M", 2021, 9.0), (3, "M", 2020, 1.0), (4, "M", 2020, 1.0)],
        "student_id long, course string, year int, absence double")
    diag = spark.createDataFrame([(1, 5.0, None), (2, 6.0, "x"), (3, None, "x"), (4, 1.0, "x")],
                                 "student_id long, math double, note string")
    act = spark.createDataFrame(
        [(i, s, "M-1", d, 2, 2, 2, 2, 2) for i, (s, d) in enumerate(
            [(1, "2020-02-15"), (1, "2021-02-15"), (2, "2021-02-15"), (4, "2021-02-15"), (1, "2021-03-15")])],
        "id long, student_id long, course string, snapshot_date string, page_views int, participations int, "
        "missing int, on_time int, late int")
    return SimpleNamespace(grades=grades, absence=absence, diagnostics=diag, activity=act)


def test_funnel_counts_complete_rows_but_carries_the_others(school):
    out = summary.attrition_funnel(school, "M", "M", "02-15", ["year"], diagnostics_drop=["note"])
    got = {r.stage: r.n for r in out.collect()}
    # Student 2's first record lacks a value, student 4 has no grade: both are
    # out of the second count and of the tasks, yet stay in the later joins.
    assert got == {"Grades": 5, "Absence": 2, "Diagnostics": 3, "Diagnostics P-F": 1, "Diagnostics E-F": 1,
                   "Activity": 4, "Activity P-F": 2, "Activity E-F": 2}
    kept = {r.stage: r.retention for r in summary.retention(out).collect()}
    assert kept["Grades"] == pytest.approx(0.2) and kept["Absence"] == pytest.approx(0.08)


def test_correlation_is_pairwise_and_null_for_constants(spark):
    data = [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 5.0, 7.0), (4.0, 4.0, 7.0), (math.nan, 1.0, 7.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r.a, r.b): (r.r, r.n) for r in summary.corr_matrix(df).collect()}
    assert len(got) == 9
    want = np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1]
    assert got["a", "b"] == got["b", "a"] == (pytest.approx(want), 3)
    assert got["a", "a"] == (pytest.approx(1.0), 4)
    assert got["a", "c"] == (None, 4) and got["c", "c"] == (None, 5)


def test_pairs_without_complete_rows_are_listed(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    got = {(r.a, r.b): (r.r, r.n) for r in summary.corr_matrix(df).collect()}
    assert got == {("a", "a"): (None, 1), ("b", "b"): (None, 1), ("a", "b"): (None, 0), ("b", "a"): (None, 0)}


@pytest.mark.parametrize("shared", [False, True])
def test_histogram_edges(spark, shared):
    data = [("P", float(i)) for i in range(11)] + [("F", 4.0), ("F", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.bin): r.n for r in summary.histogram_by(df, "g", ["v"], 5, shared).collect()}
    assert {b: n for (g, b), n in got.items() if g == "P"} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert {b: n for (g, b), n in got.items() if g == "F"} == {2: 1}


@pytest.mark.parametrize("shared", [False, True])
def test_ranges_go_to_the_rows(spark, shared):
    df = spark.range(3_000_000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    out = summary.histogram_by(df, "g", ["v"], 2, shared)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert {(r.g, r.bin): r.n for r in out.collect()} == {(g, b): 750_000 for g in "01" for b in (0, 1)}


def test_every_pass_of_describe_reads_a_kept_table(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a", 1.0), ("a", 2.5)], "g string, v double").write.parquet(f"{tmp_path}/t")
    real, read = summary.quantiles, []
    monkeypatch.setattr(summary, "quantiles", lambda df, *a: read.extend(df.inputFiles()) or real(df, *a))
    out = summary.describe_by(spark.read.parquet(f"{tmp_path}/t"), "g", "v")
    assert read and not [f for f in [*read, *out.inputFiles()] if str(tmp_path) in f]
    assert list(out.first())[1:3] == [2, 1.75]


def test_pair_bins_count_complete_pairs(spark):
    df = spark.createDataFrame([("P", 0.0, 0.0), ("P", 1.0, 1.0), ("F", 1.0, None)], "g string, a double, b double")
    assert rows(summary.pair_bins(df, "g", ["a", "b"], 2)) == [("a", "b", "P", 0, 0, 1), ("a", "b", "P", 1, 1, 1)]


def test_describe(spark):
    x = np.random.default_rng(3).normal(size=101)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None)], "g string, v double")
    r = summary.describe_by(df, "g", "v").first()
    want = [101, x.mean(), x.std(ddof=1), x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max()]
    assert list(r)[1:] == pytest.approx(want)


def test_chi2_scores_and_tails(spark):
    data = [(0, 1.0, 5.0), (0, 2.0, 5.0), (1, 9.0, 5.0), (1, 8.0, 5.0)]
    df = spark.createDataFrame(data, "y int, x double, same double")
    got = {r.feature: r for r in hypotheses.chi2_scores(df, ["x", "same"], "y").collect()}
    score = (3 - 10) ** 2 / 10 + (17 - 10) ** 2 / 10
    assert got["x"].score == pytest.approx(score)
    assert got["x"].p_value == pytest.approx(math.erfc(math.sqrt(score / 2)))
    assert got["same"].score == 0 and got["same"].p_value == 1
    # 5 % points of the chi-squared tables for 1 to 4 degrees of freedom.
    for dof, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729)):
        assert hypotheses._upper_tail(x, dof) == pytest.approx(0.05, abs=1e-6)


def test_levene(spark):
    rng = np.random.default_rng(4)
    groups = [rng.normal(scale=s, size=n) for s, n in ((1, 30), (3, 41))]
    data = [(i, float(v)) for i, g in enumerate(groups) for v in g]
    z = [np.abs(g - np.median(g)) for g in groups]
    n, k, m = sum(map(len, z)), len(z), np.concatenate(z).mean()
    want = (n - k) / (k - 1) * sum(len(g) * (g.mean() - m) ** 2 for g in z) / sum(((g - g.mean()) ** 2).sum() for g in z)
    got = hypotheses.levene(spark.createDataFrame(data, "g int, v double"), "v", "g").first()
    # The tail of the F law with one degree of freedom is that of the square of Student's t.
    t = np.linspace(0, np.sqrt(want), 200_001)
    density = (1 + t**2 / 69) ** -35 * np.exp(math.lgamma(35) - math.lgamma(34.5)) / np.sqrt(69 * np.pi)
    tail = 1 - 2 * np.trapezoid(density, t)
    assert tuple(got) == (pytest.approx(want), 1, 69, pytest.approx(tail, abs=1e-9))


def test_f_tail_at_known_points():
    for w in (0.01, 0.5, 1.0, 3.0, 20.0):
        for d in (1, 2, 7, 100, 59_997):
            assert hypotheses.f_tail(w, 2, d) == pytest.approx((d / (d + 2 * w)) ** (d / 2), rel=1e-9, abs=1e-12)
            assert hypotheses.f_tail(w, d, 2) == pytest.approx(1 - (d * w / (d * w + 2)) ** (d / 2), rel=1e-9, abs=1e-11)
    assert hypotheses.f_tail(1.0, 30, 30) == pytest.approx(0.5) and math.isnan(hypotheses.f_tail(None, 2, 5))


def test_group_means_skip_missing(spark):
    df = spark.createDataFrame([("A", 1.0, "t"), ("A", None, "t"), ("B", 3.0, "t")], "g string, x double, t string")
    assert rows(summary.group_means(df, ["g"])) == [("A", 1.0), ("B", 3.0)]
    assert drop_missing(df).count() == 2
