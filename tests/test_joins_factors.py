import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwarn.operators import factors, joins


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_join_suffixes_only_clashing_columns(spark):
    a = spark.createDataFrame([(1, 10, "m")], "s long, id long, kurs string")
    b = spark.createDataFrame([(1, 20, 5)], "s long, id long, v long")
    assert joins.join_suffixed(a, b, ["s"]).columns == ["s", "id_x", "kurs", "id_y", "v"]
    assert joins.merge_keep(a, b, ["s"], ["id_y", "v", "zz"]).columns == ["id_y", "v"]


@pytest.fixture(scope="module")
def school(spark):
    grades = spark.createDataFrame(
        [(1, "s1", "M1", "A"), (2, "s1", "M1", "F"), (3, "s2", "M1", "E"), (4, "s3", "K1", "F")],
        "id long, student_id string, course string, grade string")
    absence = spark.createDataFrame(
        [("s1", "M1", 2020, 5.0), ("s1", "M1", 2019, 7.0), ("s2", "K1", 2018, 9.0), ("s2", "M1", 2019, 3.0)],
        "student_id string, course string, year int, absence double")
    diag = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "student_id string, math double")
    return grades, absence, diag


def test_features_are_one_row_per_student(school):
    out = joins.cohort_features(*school, "M1", ["year"])
    assert rows(out.select("student_id", "grade", "absence")) == [("s1", "A", 7.0), ("s2", "E", 3.0)]


def test_features_can_take_absence_of_another_course(school):
    out = joins.cohort_features(*school, "M1", ["year"], scope="student")
    assert rows(out.select("student_id", "absence")) == [("s1", 7.0), ("s2", 9.0)]
    with pytest.raises(ValueError):
        joins.cohort_features(*school, "M1", ["year"], scope="other")


def test_prior_grades_need_every_course_and_skip_ungraded(spark):
    data = [(1, "a", "M1", "-"), (2, "a", "M1", "B"), (3, "a", "M2", "F"), (4, "b", "M1", "A"), (5, "a", "M1", "C")]
    df = spark.createDataFrame(data, "id long, student_id string, course string, grade string")
    assert rows(joins.prior_grades(df, {"M1": "m1", "M2": "m2"})) == [("a", 4, 0)]


def test_left_join_and_predictions_by_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    p = spark.createDataFrame([(2, 1.0)], "k long, prediction double")
    assert rows(joins.attach_predictions(a, p, "k")) == [(2, "y", 1.0)]


@pytest.fixture(scope="module")
def activity(spark):
    data = [(1, "a", 4, 0), (2, "a", 2, 0), (3, "a", None, 1), (4, "b", 0, 5), (5, "b", 0, None), (6, None, 7, 1)]
    return spark.createDataFrame(data, "id long, course string, page_views int, missing int")


@pytest.mark.parametrize("stat, centre", [("mean", 3.0), ("median", 3.0)])
def test_factor_is_null_without_class_or_with_zero_centre(activity, stat, centre):
    out = factors.relative_factors(activity, ["course"], {"f": "page_views"}, stat, keep_stats=True)
    got = {r.id: (r.f, r[f"class_{stat}_page_views"]) for r in out.collect()}
    assert got == {1: (4 / 3, centre), 2: (2 / 3, centre), 3: (None, centre), 4: (None, 0.0), 5: (None, 0.0),
                   6: (None, None)}


def test_every_row_stays(activity):
    assert factors.group_stat(activity, ["course"], {"m": "page_views"}).count() == 6


def test_statistic_can_differ_per_factor(activity):
    out = factors.relative_factors(
        activity, ["course"], {"f": "page_views", "g": "missing"}, {"f": "median", "g": "mean"}, keep_stats=True)
    assert {"class_median_page_views", "class_mean_missing"} <= set(out.columns)
    with pytest.raises(ValueError):
        factors.relative_factors(activity, ["course"], {"f": "page_views"}, "mode")


def test_median_of_doubles_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(str(i % 3), float(x)) for i, x in enumerate(rng.normal(size=301).round(2))]
    df = spark.createDataFrame(data, "course string, v double")
    out = factors.group_stat(df, ["course"], {"m": "v"}).select("course", "m").distinct()
    want = {c: float(np.median([v for k, v in data if k == c])) for c in "012"}
    assert {r.course: pytest.approx(r.m) for r in out.collect()} == want


def test_one_hot_class_is_combined_before_the_shuffle(activity):
    out = factors.engagement_factors(
        activity.withColumns({c: F.col("missing") for c in ("participations", "on_time", "late")}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    # The medians were selected before, from counts (see the tests of ranks).
    assert "percentile" not in plan


def test_absence_is_taken_from_the_graded_course_only(spark):
    grades = spark.createDataFrame([(1, "s1", "FYSFYS01a", "A"), (2, "s2", "FYSFYS01A ", "F")],
                                   "id long, student_id string, course string, grade string")
    absence = spark.createDataFrame(
        [("s1", "FYSFYS01b", 2018, 1.0), ("s1", "fysfys01a", 2019, 2.0), ("s2", "FYSFYS01a", 2020, 3.0)],
        "student_id string, course string, year int, absence double")
    diag = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "student_id string, math double")
    out = joins.cohort_features(grades, absence, diag, "FYSFYS01", ["year"])
    assert rows(out.select("student_id", "absence")) == [("s1", 2.0), ("s2", 3.0)]


def test_prior_grades_match_any_spelling(spark):
    grades = spark.createDataFrame([(1, "s1", "m2 ", "A"), (2, "s2", "M2", "E")],
                                   "id long, student_id string, course string, grade string")
    assert rows(joins.prior_grades(grades, {"M2": "p"})) == [("s1", 5), ("s2", 1)]
    assert rows(joins.prior_grades(grades, {"M2": "p"}, exact=True)) == [("s2", 1)]


def test_factors_are_finite(spark):
    df = spark.createDataFrame([("c", 1e308), ("c", 1e-10), ("c", 1e-10), ("d", float("inf"))], "course string, x double")
    out = factors.relative_factors(df, ["course"], {"f": "x"})
    assert sorted(r.f for r in out.collect() if r.f is not None) == [1.0, 1.0]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_absence_is_one_row_per_student_and_course_before_it_meets_the_grades(spark):
    grades = spark.createDataFrame(
        [(1, "s1", "M1", "A"), (2, "s2", "M1b", "E"), (3, None, "M1", "B"), (4, "s1", "M1", "F")],
        "id long, student_id string, course string, grade string")
    absence = spark.createDataFrame(
        [("s1", "M1", 2020, 5.0), ("s1", "M1", 2019, 7.0), ("s1", "M1", 2019, 7.0), ("s1", "M1b", 2000, 1.0), ("s1", "M1", None, 2.0),
         ("s2", "M1", 2001, 3.0), ("s2", "M1b", 2002, None), ("s2", "M1b", None, 4.0), (None, "M1", 1999, 6.0)],
        "student_id string, course string, year int, absence double")
    diag = spark.createDataFrame([("s1", 1.0), ("s2", 2.0), (None, 3.0)], "student_id string, math double")
    for exact in (True, False):
        out = joins.cohort_features(grades, absence, diag, "M1", ["year"], exact=exact)
        # The first lower-case code is the same course as ``M1``; a year that is missing comes last.
        got = sorted(((r.student_id, r.grade, r.absence) for r in out.collect()), key=str)
        assert got == [("s1", "A", 7.0), ("s2", "E", None)]
        plan = optimized(out)
        assert "_code" in plan[plan.index("LeftSemi"):].split("Window [", 2)[1].split("\n")[0]


def test_all_variables_leaves_out_students_without_activity_before_the_joins_fan_out(spark):
    from types import SimpleNamespace

    from cohortwarn.plans import tables

    t = SimpleNamespace(
        grades=spark.createDataFrame(
            [(1, "s1", "M1", "A"), (2, "s1", "M1", "F"), (3, "s2", "M1", "E"), (4, None, "M1", "B")],
            "id long, student_id string, course string, grade string"),
        absence=spark.createDataFrame(
            [(1, "s1", "M1", 2020, 5.0), (2, "s1", "M1", 2020, None), (3, "s2", "M1", 2020, 1.0), (4, None, "M1", 2020, 2.0),
             (5, "s1", "M2", 2020, 9.0)],
            "id long, student_id string, course string, school_year int, absence_time double"),
        diagnostics=spark.createDataFrame(
            [("s1", 1.0, "10%"), ("s2", 2.0, "20%"), (None, 3.0, "30%")],
            "student_id string, math_score double, english_total string"),
        activity=spark.createDataFrame(
            [(1, "s1", "M1-A", "2024-01-15", 4, 2, 1, 1, 1), (2, "s1", "M1-A", "2024-01-15", 2, 2, 1, 1, 1),
             (3, "s2", "M1-A", "2024-01-16", 2, 2, 1, 1, 1), (4, None, "M1-A", "2024-01-15", 3, 2, 1, 1, 1)],
            "id long, student_id string, course string, snapshot_date string, page_views int, participations int, missing int, "
            "on_time int, late int"))
    out = tables.all_variables(t, tables.Cohort("M1", "M1", "01-15", exact=True))
    # Every grade with every absence record and every activity row of the one student who has all of them.
    assert sorted(r.row_id for r in out.collect()) == sorted(
        f"{g}-2020-{a}-{e}" for g in (1, 2) for a in (1, 2) for e in (1, 2))
    assert optimized(out).count("LeftSemi") == 1
