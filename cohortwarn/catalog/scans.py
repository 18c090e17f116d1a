"""Scans, projections and filters."""

from pyspark.sql import functions as F

from cohortwarn.catalog.registry import COHORT, register, rounded
from cohortwarn.functions import course_is, course_prefix, course_startswith
from cohortwarn.operators import clean
from cohortwarn.sources import cohort_tables, load, read_cohort, read_snapshot
from cohortwarn.sources.tables import describe_columns


@register("select student_id from students", cohort=True)
def scan_students(spark, path):
    return cohort_tables(spark, path).students


@register(
    """select cast(row_number() over (order by column_index) - 1 as integer) as position, column_name as name,
      case data_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(data_type) end as type, is_nullable as nullable
    from duckdb_columns() where table_name = 'customer'""")
def list_columns(spark, path):
    return describe_columns(load(spark, path, "customer"))


@register("select c_custkey as student_id, c_acctbal as math_diagnosis from customer")
def scan_aliased(spark, path):
    return load(spark, path, "customer").select(
        F.col("c_custkey").alias("student_id"), F.col("c_acctbal").alias("math_diagnosis"))


@register("select id, student_id, course, grade from grades where course = '1-URGENT'", cohort=True)
def cohort_read(spark, path):
    return read_cohort(cohort_tables(spark, path).grades, COHORT.course, exact=True)


@register("select id, student_id, course, grade from grades where lower(rtrim(course)) = '1-urgent'", cohort=True)
def cohort_read_any_spelling(spark, path):
    return cohort_tables(spark, path).grades.filter(course_is(F.col("course"), "1-Urgent "))


@register(
    "select * from activity where course like 'view%' and strftime(snapshot_date, '%m-%d') = '01-15'", cohort=True)
def snapshot_read(spark, path):
    return read_snapshot(cohort_tables(spark, path).activity, COHORT.prefix, COHORT.month_day)


@register("select event_id, user_id, value from events where event_type like 'view%'")
def prefix_filter(spark, path):
    rows = load(spark, path, "events")
    return rows.filter(course_startswith(F.col("event_type"), "view", exact=True)).select("event_id", "user_id", "value")


@register("select id, substr(course, 1, 8) as course_prefix from grades", cohort=True)
def course_prefixes(spark, path):
    return cohort_tables(spark, path).grades.select("id", course_prefix(F.col("course")).alias("course_prefix"))


@register("select id, course, grade from grades", cohort=True)
def keep_columns(spark, path):
    return clean.keep(cohort_tables(spark, path).grades, ["id", "grade", "course", "not_there"])


@register("select id, student_id, grade from grades", cohort=True)
def drop_columns(spark, path):
    return clean.drop_strict(cohort_tables(spark, path).grades, ["course"])


@register('select id, student_id, course as "Course", grade as "Grade" from grades', cohort=True)
def rename_columns(spark, path):
    return clean.rename(cohort_tables(spark, path).grades, {"course": "Course", "grade": "Grade"})


@register("select student_id, 'students' as table_name from students", cohort=True)
def tag_table(spark, path):
    return clean.tag(cohort_tables(spark, path).students, "table_name", "students")


@register(
    """select id, student_id, course, page_views from activity
    where (course = 'view-A' and snapshot_date = date '2024-01-15')
       or (course = 'view-B' and snapshot_date = date '2024-01-15')
       or (course = 'click-A' and snapshot_date = date '2024-01-15')
       or (course = 'click-B' and snapshot_date = date '2024-01-15')""", cohort=True)
def class_day_filter(spark, path):
    day = F.to_date(F.lit("2024-01-15"))
    wanted = clean.any_of([{"course": c, "snapshot_date": day} for c in ("view-A", "view-B", "click-A", "click-B")])
    return cohort_tables(spark, path).activity.filter(wanted).select("id", "student_id", "course", "page_views")


@register(
    """select order_id, line_no, part_id, supplier_id, student_id, absence_time from absence
    where absence_time is null or absence_time not in (1.0, 2.0, 3.0)""", cohort=True)
def exclude_keep_null(spark, path):
    rows = clean.exclude_values(cohort_tables(spark, path).absence, "absence_time", [1.0, 2.0, 3.0])
    return rows.select("order_id", "line_no", "part_id", "supplier_id", "student_id", "absence_time")


@register("select id, student_id, grade from grades where grade in ('E', 'F')", cohort=True)
def include_grades(spark, path):
    return clean.include_values(cohort_tables(spark, path).grades, "grade", ["E", "F"]).select("id", "student_id", "grade")


@register("select student_id, english_total from diagnostics where english_total <> 'NULL'", cohort=True)
def drop_sentinel_text(spark, path):
    rows = clean.drop_sentinel(cohort_tables(spark, path).diagnostics, "english_total")
    return rows.select("student_id", "english_total")


@register("select * from diagnostics where math_score is not null", cohort=True)
def complete_rows(spark, path):
    return clean.drop_missing(cohort_tables(spark, path).diagnostics)


@register(
    """select grade, count(*) as n, round(avg(id), 6) as mean_id from grades where grade = 'F' group by grade
    union all select grade, count(*), round(avg(id), 6) from grades where grade = 'E' group by grade""", cohort=True)
def rows_by_class(spark, path):
    parts = clean.split_by_class(cohort_tables(spark, path).grades, "grade", ["F", "E"])
    sums = [p.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.avg("id").alias("mean_id")) for p in parts.values()]
    return rounded(sums[0].unionByName(sums[1]), "mean_id")
