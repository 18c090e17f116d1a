"""De-duplication, scalar functions, sorting and set operations."""

from pyspark.sql import functions as F

from cohortwarn import functions as fn
from cohortwarn.catalog.registry import COHORT, PICKS_SQL, register, rounded
from cohortwarn.operators import clean, dedup, summary
from cohortwarn.sources import VARIABLE_LABELS, cohort_tables, load, read_cohort


@register("select distinct course from grades", cohort=True)
def distinct_courses(spark, path):
    return dedup.distinct_keys(cohort_tables(spark, path).grades, "course")


@register("select distinct student_id, course, school_year from absence", cohort=True)
def distinct_absence_rows(spark, path):
    rows = cohort_tables(spark, path).absence.select("student_id", "course", "school_year")
    return dedup.distinct_rows(rows)


@register(
    """select * from grades qualify row_number() over (partition by student_id, course order by id) = 1""", cohort=True)
def first_grade(spark, path):
    return dedup.first_per_key(cohort_tables(spark, path).grades, ["student_id", "course"], ["id"])


@register(PICKS_SQL + "select * from a1", cohort=True)
def first_absence_year(spark, path):
    rows = read_cohort(cohort_tables(spark, path).absence, COHORT.course, exact=True)
    return dedup.first_per_key(rows, ["student_id"], COHORT.absence_order)


@register(
    """select event_id, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::date as day from events""")
def parse_days(spark, path):
    text = F.date_format("ts", "yyyy-MM-dd")
    return load(spark, path, "events").select("event_id", fn.parse_day(text).cast("date").alias("day"))


@register(
    """select student_id, math_score, cast(replace(english_total, '%', '') as integer) as english_total
    from diagnostics where math_score is not null and english_total <> 'NULL'""", cohort=True)
def parse_percent_text(spark, path):
    return clean.parse_percent(cohort_tables(spark, path).diagnostics, "english_total")


@register("select student_id, try_cast(replace(english_total, '%', '') as double) as english_total from diagnostics",
          cohort=True)
def coerce_numbers(spark, path):
    text = F.replace(F.col("english_total"), F.lit("%"), F.lit(""))
    return cohort_tables(spark, path).diagnostics.select("student_id", fn.coerce_number(text).alias("english_total"))


@register("select o_orderkey, cast(substr(o_orderpriority, 1, 1) as integer) as priority from orders")
def strict_integers(spark, path):
    return load(spark, path, "orders").select(
        "o_orderkey", fn.strict_int(F.substring("o_orderpriority", 1, 1)).alias("priority"))


@register("select id, case when grade in ('A','B','C','D','E') then 'P' else grade end as grade from grades",
          cohort=True)
def pass_fail_grades(spark, path):
    return cohort_tables(spark, path).grades.select("id", fn.pass_fail(F.col("grade")).alias("grade"))


_POINTS = "case grade when 'A' then 5 when 'B' then 4 when 'C' then 3 when 'D' then 2 when 'E' then 1 when 'F' then 0 end"


@register(f"select id, {_POINTS} as grade from grades where grade <> '-'", cohort=True)
def grade_points_dropped(spark, path):
    return clean.grades_to_points(cohort_tables(spark, path).grades.select("id", "grade"), "grade", "drop")


@register(f"select id, {_POINTS} as grade from grades", cohort=True)
def grade_points_null(spark, path):
    return clean.grades_to_points(cohort_tables(spark, path).grades.select("id", "grade"), "grade", "null")


@register("select id, case grade when 'F' then 0 else 1 end as grade from grades where grade in ('E', 'F')", cohort=True)
def grade_codes(spark, path):
    rows = clean.include_values(cohort_tables(spark, path).grades, "grade", ["E", "F"])
    return rows.select("id", fn.grade_binary(F.col("grade")).alias("grade"))


@register("select id, case when grade = 'F' then 0.0::double else 1.0::double end as label from grades", cohort=True)
def label_codes(spark, path):
    return cohort_tables(spark, path).grades.select("id", fn.encode_label(F.col("grade")).alias("label"))


@register(
    """select event_id, case when event_id % 5 = 0 or event_id % 7 = 1 or event_id % 11 = 2 then null
      else round(value / (event_id % 5), 6) end as ratio from events""")
def finite_ratios(spark, path):
    """Divisors that are zero, not a number, and so small that the ratio overflows."""
    i = F.col("event_id")
    num = F.when(i % 11 == 2, F.lit(1e308)).otherwise(F.col("value"))
    den = F.when(i % 5 == 0, F.lit(0.0)).when(i % 7 == 1, F.lit(float("nan"))).when(i % 11 == 2, F.lit(1e-10)).otherwise(i % 5)
    return rounded(load(spark, path, "events").select("event_id", fn.ratio(num, den).alias("ratio")), "ratio")


_TASK_SQL = "select id, student_id, course, case when grade = 'F' then 'F' else 'P' end as grade from grades where grade {}"


@register(_TASK_SQL.format("in ('E', 'F')"), cohort=True)
def task_e_f(spark, path):
    return clean.build_task(cohort_tables(spark, path).grades, clean.TASK_EXCLUDES["EF"])


@register(_TASK_SQL.format("<> '-'"), cohort=True)
def task_p_f(spark, path):
    return clean.build_task(cohort_tables(spark, path).grades, clean.TASK_EXCLUDES["PF"])


@register(
    """, long as (select student_id, unnest(['math_score', 'english_total', 'course_code']) as variable from diagnostics)
    select student_id, case variable when 'math_score' then 'Math diagnosis' when 'english_total' then 'English total'
           else variable end as variable from long""", cohort=True)
def relabel_variables(spark, path):
    names = F.array(*map(F.lit, ("math_score", "english_total", "course_code")))
    rows = cohort_tables(spark, path).diagnostics.select("student_id", F.explode(names).alias("variable"))
    return clean.relabel(rows, "variable", VARIABLE_LABELS)


@register("select id, student_id, grade from grades order by student_id, id", cohort=True)
def sorted_rows(spark, path):
    return cohort_tables(spark, path).grades.select("id", "student_id", "grade").orderBy("student_id", "id")


@register("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 3")
def top_three(spark, path):
    rows = load(spark, path, "orders").select("o_orderkey", "o_totalprice")
    return summary.top_k(rows, "o_totalprice", 3, ["o_orderkey"])


@register("""select student_id, course, 'grades' as table_name from grades
          union all select student_id, course, 'absence' from absence
          union all select student_id, course, 'activity' from activity""", cohort=True)
def append_sources(spark, path):
    t = cohort_tables(spark, path)
    return summary.append_tables([
        clean.tag(getattr(t, n).select("student_id", "course"), "table_name", n)
        for n in ("grades", "absence", "activity")
    ])


@register("select distinct student_id from students except select student_id from grades where grade = 'F'", cohort=True)
def never_failed(spark, path):
    t = cohort_tables(spark, path)
    failed = t.grades.filter(F.col("grade") == "F").select("student_id")
    return summary.except_distinct(t.students, failed)
