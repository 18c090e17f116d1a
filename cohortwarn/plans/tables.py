"""Modelling tables: the joins and clean-up in front of every study.

Each takes a namespace with the frames ``grades``, ``absence``, ``diagnostics``
and ``activity`` under the column names of this package, and leaves a lazy plan.
``row_id`` is unique per row: the activity row where activity is joined without
de-duplication, else the student.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwarn.functions import canonical_code, encode_label, grade_binary
from cohortwarn.operators.clean import (
    TASK_EXCLUDES,
    any_of,
    build_task,
    drop_missing,
    drop_sentinel,
    exclude_values,
    grades_to_points,
    include_values,
    keep,
    parse_percent,
)
from cohortwarn.operators.dedup import distinct_rows, first_per_key
from cohortwarn.operators.factors import (
    TARDINESS_FACTORS,
    VIEW_FACTORS,
    engagement_factors,
    relative_factors,
)
from cohortwarn.operators.joins import build_student_table, cohort_features, prior_grades
from cohortwarn.sources.tables import read_cohort, read_snapshot

STUDENT = "student_id"
FACTORS = (*VIEW_FACTORS, *TARDINESS_FACTORS)
# Variables of the modelling tables; a source without one goes without.
SCORES = ("math_score", "word_chains", "letter_chains", "sentence_chains", "english_total")
ALL_SCORES = (*SCORES, "spelling")
# Diagnostic columns left out of the correlation study.
NOT_CORRELATED = ("id", "english_total", "english_vocabulary", "english_grammar", "english_reading", "dictation")


@dataclass(frozen=True)
class Cohort:
    """What one study looks at.  ``exact``: codes have one spelling, so filters reach the scan."""

    course: str
    prefix: str
    month_day: str
    absence_order: Sequence[str | Column] = ("school_year", "id")
    diagnostics_order: Sequence[str | Column] | None = None
    exact: bool = False


def snapshot_factors(
    t, c: Cohort, stat: str = "median", tardiness_stat: str | None = None, dedupe: bool = False
) -> DataFrame:
    """Factors of the cohort's snapshot; every activity row, or one per student with ``dedupe``."""
    rows = read_snapshot(t.activity, c.prefix, c.month_day, exact=c.exact)
    if dedupe:
        rows = first_per_key(rows, [STUDENT], ["id"])
    return engagement_factors(rows, stat=stat, tardiness_stat=tardiness_stat)


def single_activity(t, c: Cohort, stat: str = "mean") -> DataFrame:
    """One activity row per student, then view factors among those rows."""
    rows = first_per_key(read_snapshot(t.activity, c.prefix, c.month_day, exact=c.exact), [STUDENT], ["id"])
    return relative_factors(rows, ["course"], VIEW_FACTORS, stat)


def _features(t, c: Cohort, scope: str) -> DataFrame:
    return cohort_features(
        t.grades, t.absence, t.diagnostics, c.course, c.absence_order, scope=scope,
        diagnostics_order=c.diagnostics_order, exact=c.exact)


def _scores(t, c: Cohort) -> DataFrame:
    """Diagnostics, one row per student where the cohort names an order."""
    if c.diagnostics_order is None:
        return t.diagnostics
    return first_per_key(t.diagnostics, [STUDENT], c.diagnostics_order)


def early_warning(
    t,
    c: Cohort,
    scope: str = "course",
    activity: bool = True,
    factors: Sequence[str] = FACTORS,
    variables: Sequence[str] = ("absence_time", *SCORES),
    dedupe: bool = False,
) -> DataFrame:
    """Grade, absence, scores and, if wanted, relative activity; complete rows with parsed percentages."""
    base = _features(t, c, scope).withColumnRenamed("id", "grade_id")
    if activity:
        act = snapshot_factors(t, c, dedupe=dedupe).select(F.col("id").alias("row_id"), STUDENT, *factors)
        base = base.join(act, STUDENT)
    else:
        base = base.withColumn("row_id", F.col(STUDENT))
        factors = ()
    kept = keep(base, ["row_id", STUDENT, "grade", *variables, *factors])
    return parse_percent(kept, "english_total") if "english_total" in kept.columns else drop_missing(kept)


def early_warning_with_history(t, c: Cohort, courses: dict[str, str], activity: bool = True) -> DataFrame:
    """The early-warning table with the points of earlier courses."""
    return early_warning(t, c, activity=activity, factors=("page_view_factor",)).join(
        prior_grades(t.grades, courses, exact=c.exact), STUDENT)


def all_variables(t, c: Cohort) -> DataFrame:
    """Every variable, joined without de-duplication: median view factors, mean tardiness factors.

    ``row_id`` names the grade, the absence record (by the columns of its order) and the activity row.

    A row needs activity on one day, which few students have, so absence, the longest table, is cut down to these
    students before the joins multiply it.
    """
    order = [x for x in c.absence_order if isinstance(x, str)]
    grades = read_cohort(t.grades, c.course, exact=c.exact).select(STUDENT, "grade", F.col("id").alias("_grade_id"))
    seen = read_snapshot(t.activity, c.prefix, c.month_day, exact=c.exact).select(STUDENT)
    absence = read_cohort(t.absence, c.course, exact=c.exact).join(seen, STUDENT, "left_semi").select(
        "absence_time", STUDENT, F.concat_ws("-", *[F.col(x).cast("string") for x in order]).alias("_absence_id"))
    scores = parse_percent(drop_sentinel(t.diagnostics, "english_total"), "english_total", complete_rows=False)
    act = snapshot_factors(t, c, tardiness_stat="mean").select(STUDENT, *FACTORS, F.col("id").alias("_activity_id"))
    joined = grades.join(absence, STUDENT).join(scores, STUDENT).join(act, STUDENT)
    row_id = F.concat_ws("-", F.col("_grade_id").cast("string"), "_absence_id", F.col("_activity_id").cast("string"))
    return keep(joined.withColumn("row_id", row_id), ["row_id", STUDENT, "grade", "absence_time", *ALL_SCORES, *FACTORS])


def coverage_parts(t, c: Cohort) -> dict[str, DataFrame]:
    """The frames whose columns a coverage report counts, by table name."""
    grades = first_per_key(read_cohort(t.grades, c.course, exact=c.exact), [STUDENT], ["id"])
    absence = read_cohort(t.absence, c.course, exact=c.exact).select("absence_time", STUDENT)
    with_absence = distinct_rows(grades.join(absence, STUDENT))
    scores = distinct_rows(t.diagnostics).drop("id")
    activity = snapshot_factors(t, c).select(STUDENT, *FACTORS)
    merged = distinct_rows(with_absence.join(scores, STUDENT)).join(activity, STUDENT)
    return {
        "grades": grades.drop("course"),
        "absence": with_absence.drop("course", "grade"),
        "diagnosis": grades.select(STUDENT).join(scores, STUDENT),
        "activity": activity,
        "merged": merged.drop("id", "course"),
    }


def correlation_table(t, c: Cohort) -> DataFrame:
    """Two-grade students with scores, absence and activity as numbers."""
    grades = first_per_key(read_cohort(t.grades, c.course, exact=c.exact), [STUDENT], ["id"])
    absence = first_per_key(read_cohort(t.absence, c.course, exact=c.exact), [STUDENT], c.absence_order)
    joined = build_student_table(
        [
            grades.select(STUDENT, "grade"),
            single_activity(t, c).select(STUDENT, "page_views", "participations", *VIEW_FACTORS),
            absence.select(STUDENT, "absence_time"),
            _scores(t, c).drop(*NOT_CORRELATED),
        ],
        [STUDENT],
    )
    rows = exclude_values(joined, "grade", TASK_EXCLUDES["EF"])
    return rows.select(grade_binary(F.col("grade")).alias("grade"), *[x for x in joined.columns if x not in (STUDENT, "grade")])


def class_correlation_table(t, c: Cohort, classes: Sequence[str], day: Column) -> DataFrame:
    """All grades as points with absence and one day's activity of the listed classes, not de-duplicated."""
    grades = read_cohort(t.grades, c.course, exact=c.exact).select(STUDENT, "grade")
    absence = read_cohort(t.absence, c.course, exact=c.exact).select(STUDENT, "absence_time")
    codes = [x if c.exact else x.rstrip().lower() for x in classes]
    rows = t.activity if c.exact else t.activity.withColumn("course", canonical_code(F.col("course")))
    wanted = any_of([{"course": x, "snapshot_date": day} for x in codes])
    counters = ["page_views", "page_views_level", "participations", "participations_level", "missing", "on_time", "late"]
    act = keep(rows.filter(wanted), [STUDENT, *counters])
    joined = grades_to_points(grades, "grade", "null").join(absence, STUDENT).join(act, STUDENT)
    return joined.drop(STUDENT)


def absence_score(t, c: Cohort) -> DataFrame:
    """First E/F tree study: grade, first absence record of the course, maths score."""
    grades = read_cohort(t.grades, c.course, exact=c.exact).select(F.col("id").alias("row_id"), STUDENT, "grade")
    absence = first_per_key(read_cohort(t.absence, c.course, exact=c.exact), [STUDENT], c.absence_order)
    joined = grades.join(absence.select(STUDENT, "absence_time", "lesson_time"), STUDENT).join(
        _scores(t, c).select(STUDENT, "math_score"), STUDENT)
    return joined


def absence_activity(t, c: Cohort) -> DataFrame:
    """Second tree study: grade, first absence record, relative page views."""
    grades = read_cohort(t.grades, c.course, exact=c.exact).select(F.col("id").alias("row_id"), STUDENT, "grade")
    absence = first_per_key(read_cohort(t.absence, c.course, exact=c.exact), [STUDENT], c.absence_order)
    return grades.join(absence.select(STUDENT, "absence_time"), STUDENT).join(
        single_activity(t, c).select(STUDENT, "page_view_factor"), STUDENT)


def activity_only(t, c: Cohort) -> DataFrame:
    """Third tree study: grade, hand-ins on time, relative views and participation."""
    grades = read_cohort(t.grades, c.course, exact=c.exact).select(F.col("id").alias("row_id"), STUDENT, "grade")
    return grades.join(single_activity(t, c).select(STUDENT, "on_time", *VIEW_FACTORS), STUDENT)


def pair_table(t, c: Cohort) -> DataFrame:
    """Activity and absence of the two-grade students, for joint distributions."""
    absence = read_cohort(t.absence, c.course, exact=c.exact).select(STUDENT, "absence_time")
    joined = activity_only(t, c).join(absence, STUDENT)
    return drop_missing(exclude_values(joined, "grade", TASK_EXCLUDES["EF"]))


def baseline(t, c: Cohort) -> DataFrame:
    """Two-grade students with absence from any course and a maths score."""
    rows = _features(t, c, "student").select(
        F.col(STUDENT).alias("row_id"), "grade", "absence_time", "math_score")
    return drop_missing(include_values(rows, "grade", ["E", "F"]))


def activity_baseline(t, c: Cohort) -> DataFrame:
    """Two-grade students with absence, score, missing hand-ins and relative activity."""
    grades = first_per_key(read_cohort(t.grades, c.course, exact=c.exact), [STUDENT], ["id"])
    absence = first_per_key(read_cohort(t.absence, c.course, exact=c.exact), [STUDENT], c.absence_order)
    joined = build_student_table(
        [
            grades.select(STUDENT, "grade"),
            _scores(t, c).select(STUDENT, "math_score"),
            absence.select(STUDENT, "absence_time"),
            single_activity(t, c).select(STUDENT, "missing", *VIEW_FACTORS),
        ],
        [STUDENT],
    )
    rows = exclude_values(joined, "grade", TASK_EXCLUDES["EF"])
    return drop_missing(rows).withColumnRenamed(STUDENT, "row_id")


def task(df: DataFrame, name: str) -> DataFrame:
    """Rows of the ``EF`` or ``PF`` task with the 0/1 label (risk class 0)."""
    return build_task(df, TASK_EXCLUDES[name]).withColumn("label", encode_label(F.col("grade")))

