"""Joins on the student key."""

from pyspark.sql import functions as F

from cohortwarn.catalog.registry import COHORT, PICKS_SQL, register
from cohortwarn.operators import joins as op
from cohortwarn.operators.dedup import first_per_key
from cohortwarn.operators.models import hash_unit
from cohortwarn.sources import cohort_tables, read_cohort, read_snapshot
from cohortwarn.sources.bindings import PRIOR_COURSES

_PRIOR = {code: f"points_{i}" for i, code in enumerate(PRIOR_COURSES, 1)}


def _first(t):
    g = first_per_key(read_cohort(t.grades, COHORT.course, exact=True), ["student_id"], ["id"])
    a = first_per_key(read_cohort(t.absence, COHORT.course, exact=True), ["student_id"], COHORT.absence_order)
    return g, a


@register(PICKS_SQL + """select g1.student_id, g1.id, g1.grade, a1.school_year, a1.absence_time
          from g1 join a1 using (student_id)""", cohort=True)
def join_inner(spark, path):
    g, a = _first(cohort_tables(spark, path))
    return g.join(a.drop("course"), "student_id").select("student_id", "id", "grade", "school_year", "absence_time")


@register(PICKS_SQL + """select g1.student_id, g1.id as id_x, g1.course as course_x, g1.grade, snap.id as id_y,
          snap.course as course_y, snap.page_views from g1 join snap using (student_id)""", cohort=True)
def join_suffixed(spark, path):
    t = cohort_tables(spark, path)
    g, _ = _first(t)
    s = read_snapshot(t.activity, COHORT.prefix, COHORT.month_day)
    out = op.join_suffixed(g, s, ["student_id"])
    return out.select("student_id", "id_x", "course_x", "grade", "id_y", "course_y", "page_views")


@register(PICKS_SQL + """select g1.student_id, g1.grade, d.math_score, d.english_total, a1.absence_time, s.page_views
          from g1 join diagnostics d using (student_id) join a1 using (student_id) join snap1 s using (student_id)""",
          cohort=True)
def student_table(spark, path):
    t = cohort_tables(spark, path)
    g, a = _first(t)
    s = first_per_key(read_snapshot(t.activity, COHORT.prefix, COHORT.month_day), ["student_id"], ["id"])
    out = op.build_student_table([g, t.diagnostics, a.drop("course"), s.select("student_id", "page_views")], ["student_id"])
    return out.select("student_id", "grade", "math_score", "english_total", "absence_time", "page_views")


@register("""select grade, absence_time from grades join (select student_id, course, absence_time from absence) a
          on a.student_id = grades.student_id and a.course = grades.course""", cohort=True)
def merge_keep(spark, path):
    t = cohort_tables(spark, path)
    a = t.absence.select("student_id", "course", "absence_time")
    return op.merge_keep(t.grades, a, ["student_id", "course"], ["grade", "absence_time", "not_there"])


_FEATURES = """select g1.student_id, g1.grade, a.absence_time, a.school_year, d.math_score, d.english_total
    from g1 join {} a using (student_id) join diagnostics d using (student_id)"""


def _features(spark, path, scope):
    t = cohort_tables(spark, path)
    out = op.cohort_features(
        t.grades, t.absence, t.diagnostics, COHORT.course, COHORT.absence_order, scope=scope, exact=True)
    return out.select("student_id", "grade", "absence_time", "school_year", "math_score", "english_total")


@register(PICKS_SQL + _FEATURES.format("a1"), cohort=True)
def cohort_features_same_course(spark, path):
    return _features(spark, path, "course")


@register(PICKS_SQL + _FEATURES.format("a1any"), cohort=True)
def cohort_features_any_course(spark, path):
    return _features(spark, path, "student")


def prior_sql() -> str:
    parts = []
    for code, out in _PRIOR.items():
        parts.append(f""", {out}_t as (select student_id, {out} from (select student_id, id,
            case grade when 'A' then 5 when 'B' then 4 when 'C' then 3 when 'D' then 2 when 'E' then 1
                       when 'F' then 0 end as {out} from grades where course = '{code}')
            where {out} is not null qualify row_number() over (partition by student_id order by id) = 1)""")
    return "".join(parts)


@register(prior_sql() + """select student_id, points_1, points_2, points_3 from points_1_t
          join points_2_t using (student_id) join points_3_t using (student_id)""", cohort=True)
def prior_grades(spark, path):
    return op.prior_grades(cohort_tables(spark, path).grades, _PRIOR)


@register("""select id, student_id, course, grade, case when
          cast('0x' || substr(md5('7|' || id), 1, 8) as bigint) / 4294967296.0 < 0.3 then 0.0 else 1.0 end::double
          as prediction from grades""", cohort=True)
def attach_predictions(spark, path):
    """Predictions made elsewhere come back to the full rows by key."""
    rows = cohort_tables(spark, path).grades
    scored = rows.select("id", (hash_unit(7, F.col("id")) >= 0.3).cast("double").alias("prediction"))
    return op.attach_predictions(rows, scored, "id")


@register("""select g.id, g.student_id, g.grade, a.absence_time from (select * from grades where course = '1-URGENT') g
          left join (select student_id, absence_time from absence where course = '1-URGENT') a
          on a.student_id = g.student_id""", cohort=True)
def join_left(spark, path):
    t = cohort_tables(spark, path)
    a = read_cohort(t.absence, COHORT.course, exact=True).select("student_id", "absence_time")
    g = read_cohort(t.grades, COHORT.course, exact=True)
    return g.join(a, "student_id", "left").select("id", "student_id", "grade", "absence_time")
