"""Joins on the student key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwarn.functions import canonical_code, course_is, course_startswith, grade_points
from cohortwarn.operators.clean import drop_missing, keep
from cohortwarn.operators.dedup import first_per_key


def join_suffixed(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    how: str = "inner",
) -> DataFrame:
    """Join; same-named columns other than the keys get a suffix on each side."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, list(on), how)


def merge_keep(left: DataFrame, right: DataFrame, on: Sequence[str], cols: Iterable[str]) -> DataFrame:
    return keep(join_suffixed(left, right, on), cols)


def build_student_table(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner join of several tables on one key; one exchange per table on the same key."""
    return reduce(lambda a, b: join_suffixed(a, b, on), tables)


def attach_predictions(rows: DataFrame, scored: DataFrame, key: str, cols: Sequence[str] = ("prediction",)):
    """Bring predictions back to the full rows by key."""
    return rows.join(scored.select(key, *cols), key)


def cohort_features(
    grades: DataFrame,
    absence: DataFrame,
    diagnostics: DataFrame,
    prefix: str,
    absence_order: Sequence[str | Column],
    scope: str = "course",
    student: str = "student_id",
    course: str = "course",
    grade_order: Sequence[str | Column] = ("id",),
    diagnostics_order: Sequence[str | Column] | None = None,
    exact: bool = False,
) -> DataFrame:
    """Grade, absence and diagnostics, one row per student.

    Every side is reduced to one row per student before the joins, so nothing
    fans out.  ``scope='course'`` takes absence from the graded course only (not from another with the same prefix);
    ``scope='student'`` takes the student's first absence record of any course.
    Where tables share other column names, the grade row's value is kept.
    """
    cohort = grades.filter(course_startswith(F.col(course), prefix, exact))
    g = first_per_key(cohort, [student], grade_order)
    if scope == "course":
        code = F.col(course) if exact else canonical_code(F.col(course))
        graded = g.select(F.col(student).alias("_student"), code.alias("_graded"))
        # The first record of each student and course: what is shuffled for the join is a row per map task, not all records.
        a = first_per_key(absence.filter(course_startswith(F.col(course), prefix, exact)).withColumn("_code", code),
                          [student, "_code"], absence_order)
        a = a.join(graded, (F.col(student) == F.col("_student")) & (F.col("_code") == F.col("_graded")), "left_semi")
        a = a.drop("_code")
    elif scope == "student":
        a = absence
    else:
        raise ValueError(f"scope must be course or student, not {scope!r}")
    a = first_per_key(a, [student], absence_order)
    a = a.select(student, *[c for c in a.columns if c not in g.columns])
    d = diagnostics if diagnostics_order is None else first_per_key(diagnostics, [student], diagnostics_order)
    d = d.select(student, *[c for c in d.columns if c not in {*g.columns, *a.columns}])
    return g.join(a, student).join(d, student)


def prior_grades(
    grades: DataFrame,
    courses: dict[str, str],
    student: str = "student_id",
    course: str = "course",
    grade: str = "grade",
    order: str = "id",
    exact: bool = False,
) -> DataFrame:
    """Points of earlier courses side by side, for students graded in all of them.

    One scan and one aggregation: per course the first valid grade in ``order``.
    ``courses`` maps course code to output column; codes match in any spelling unless ``exact``.
    """
    is_code = {code: course_is(F.col(course), code, exact) for code in courses}
    points = (
        grades.filter(reduce(lambda a, b: a | b, is_code.values()))
        .select(student, course, order, grade_points(F.col(grade)).alias("_points"))
        .filter(F.col("_points").isNotNull())
    )
    wide = points.groupBy(student).agg(*[
        F.min_by(F.when(is_code[code], F.col("_points")), F.when(is_code[code], F.col(order)))
        .alias(out)
        for code, out in courses.items()
    ])
    return drop_missing(wide, list(courses.values()))
