"""Cleaning rules on hand-made rows: null, case, cast and order behaviour."""

import math

import pytest
from pyspark.sql import functions as F

from cohortwarn import functions as fn
from cohortwarn.operators import clean, dedup, summary
from cohortwarn.sources import describe_columns, on_month_day, read_cohort, read_snapshot, to_canonical
from cohortwarn.sources.tables import jdbc_options


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def grades(spark):
    data = [(1, "s1", "MATMAT01c", "A"), (2, "s1", "MATMAT01C", "F"), (3, "s2", "matmat01c ", None),
            (4, "s3", "KEMKEM01", "-"), (5, "s4", "MATMAT01c", "E")]
    return spark.createDataFrame(data, "id long, student_id string, course string, grade string")


def test_course_match_ignores_case_and_trailing_blanks(grades):
    assert {r.id for r in read_cohort(grades, "MATMAT01c ").collect()} == {1, 2, 3, 5}
    assert {r.id for r in read_cohort(grades, "MATMAT01c", exact=True).collect()} == {1, 5}


def test_exclusion_keeps_nulls_until_rows_are_completed(grades):
    kept = clean.exclude_values(grades, "grade", ["A", "-"])
    assert {r.id for r in kept.collect()} == {2, 3, 5}
    assert {r.id for r in clean.build_task(grades, ["A", "-"]).collect()} == {2, 5}


def test_task_recodes_after_exclusion(grades):
    ef = clean.build_task(grades, clean.TASK_EXCLUDES["EF"])
    assert {(r.id, r.grade) for r in ef.collect()} == {(2, "F"), (5, "P")}
    pf = clean.build_task(grades, clean.TASK_EXCLUDES["PF"])
    assert {(r.id, r.grade) for r in pf.collect()} == {(1, "P"), (2, "F"), (5, "P")}


def test_first_per_key_follows_the_order_given(grades):
    firsts = dedup.first_per_key(grades, ["student_id"], [F.desc("id")])
    assert {r.id for r in firsts.collect()} == {2, 3, 4, 5}
    years = grades.withColumn("year", F.when(F.col("id") == 2, 2018).otherwise(2019))
    assert {r.id for r in dedup.first_per_key(years, ["student_id"], ["year", "id"]).collect()} == {2, 3, 4, 5}


def test_first_per_key_treats_null_keys_as_one_key(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, k string")
    assert {r.id for r in dedup.first_per_key(df, ["k"], ["id"]).collect()} == {1, 3}


def test_dropping_unknown_columns_is_an_error_keeping_is_not(grades):
    with pytest.raises(ValueError, match="nope"):
        clean.drop_strict(grades, ["grade", "nope"])
    assert clean.keep(grades, ["grade", "nope", "id"]).columns == ["id", "grade"]
    with pytest.raises(ValueError):
        clean.keep(grades, ["nope"], strict=True)


def test_drop_missing_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, math.nan)], "id long, x double")
    assert rows(clean.drop_missing(df).select("id")) == [(1,)]
    assert rows(df.filter(clean.complete(df)).select("id")) == [(1,)]


def test_percent_text(spark):
    df = spark.createDataFrame([(1, "29%", 1.0), (2, "NULL", 1.0), (3, None, 1.0), (4, "7%", None)],
                               "id long, p string, x double")
    assert rows(clean.parse_percent(df, "p").select("id", "p")) == [(1, 29)]
    assert sorted(rows(clean.parse_percent(df, "p", complete_rows=False).select("id", "p"))) == [(1, 29), (4, 7)]


def test_strict_casts_fail_and_coercion_does_not(spark):
    df = spark.createDataFrame([("x",)], "p string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(fn.strict_int(F.col("p"))).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.parse_percent(df, "p").collect()
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        df.select(fn.parse_day(F.col("p"))).collect()
    assert rows(df.select(fn.coerce_number(F.col("p")))) == [(None,)]


def test_grade_scales(spark):
    df = spark.createDataFrame([(g,) for g in ("A", "E", "F", "-", None)], "g string")
    assert rows(df.select(fn.grade_points(F.col("g")))) == [(5,), (1,), (0,), (None,), (None,)]
    assert rows(clean.grades_to_points(df, "g", "drop")) == [(5,), (1,), (0,)]
    assert rows(df.select(fn.encode_label(F.col("g")))) == [(1.0,), (1.0,), (0.0,), (1.0,), (None,)]
    with pytest.raises(ValueError):
        clean.grades_to_points(df, "g", "other")


def test_labels_do_not_depend_on_row_order(spark):
    for data in (["P", "F"], ["F", "P"], ["P", "P"]):
        df = spark.createDataFrame([(g,) for g in data], "g string")
        got = rows(df.select(fn.encode_label(F.col("g"))))
        assert got == [(0.0 if g == "F" else 1.0,) for g in data]


def test_division_by_zero_and_infinity_become_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert rows(df.select(fn.ratio(F.col("a"), F.col("b")))) == [(None,), (None,), (1.5,)]
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (2.0,)], "a double")
    assert rows(df.select(fn.finite_or_null(F.col("a")))) == [(None,), (None,), (None,), (2.0,)]


def test_snapshot_day_matches_every_year_for_text_and_dates(spark):
    data = [(1, "KEMKEM01-A", "2020-02-15"), (2, "KEMKEM01-B", "2021-02-15"), (3, "KEMKEM01-A", "2021-12-15"),
            (4, "FYSFYS01", "2020-02-15")]
    df = spark.createDataFrame(data, "id long, course string, day string")
    for table in (df, df.withColumn("day", F.to_date("day"))):
        assert {r.id for r in read_snapshot(table, "KEMKEM01", "02-15", day="day").collect()} == {1, 2}
        assert {r.id for r in table.filter(on_month_day(table, "day", "12-15")).collect()} == {3}


def test_relabel_tag_rename_and_split(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(clean.relabel(df, "v", {"a": "Alpha"})) == [("Alpha",), ("b",), (None,)]
    assert clean.tag(df, "t", "x").columns == ["v", "t"]
    assert clean.rename(df, {"v": "w"}).columns == ["w"]
    parts = clean.split_by_class(df, "v", ["a", "b"])
    assert [p.count() for p in parts.values()] == [1, 1]


def test_any_of_is_or_over_and_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "x long, c string")
    got = df.filter(clean.any_of([{"x": 1, "c": "a"}, {"x": 1, "c": "b"}]))
    assert rows(got) == [(1, "a"), (1, "b")]


def test_source_names_map_to_plan_names(spark):
    df = spark.createDataFrame([("s", "k", 1.0)], "slumpkod string, kurs string, extra double")
    assert to_canonical(df).columns == ["student_id", "course", "extra"]


def test_describe_columns(grades):
    assert rows(describe_columns(grades))[0] == (0, "id", "bigint", True)


def test_jdbc_options_need_all_of_a_parallel_read():
    base = {"url": "jdbc:x", "user": "u"}
    assert jdbc_options(base, "t")["dbtable"] == "t"
    full = jdbc_options(base, "t", "id", (0, 100), 8)
    assert (full["lowerBound"], full["upperBound"], full["numPartitions"]) == ("0", "100", "8")
    with pytest.raises(ValueError):
        jdbc_options(base, "t", "id")
    with pytest.raises(ValueError):
        jdbc_options(base, "t", partitions=3)


def test_sorts_and_sets(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (2,)], "x long")
    other = spark.createDataFrame([(3,)], "x long")
    assert rows(summary.except_distinct(df, other)) == [(1,), (2,)]
    assert rows(summary.top_k(df, "x", 2)) == [(3,), (2,)]
    assert summary.append_tables([df, other]).count() == 5


def test_importing_starts_nothing():
    import subprocess
    import sys

    code = ("import cohortwarn.catalog, pyspark; from pyspark.sql import SparkSession; "
            "assert SparkSession.getActiveSession() is None; "
            "assert pyspark.SparkContext._active_spark_context is None")
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_a_missing_year_is_not_the_earliest(spark):
    df = spark.createDataFrame([("s1", None, 1), ("s1", "2019", 2), ("s2", None, 3)], "s string, year string, id long")
    assert sorted(rows(dedup.first_per_key(df, ["s"], ["year", "id"]).select("s", "id"))) == [("s1", 2), ("s2", 3)]
