"""Counts, coverage, attrition, distributions and test statistics."""

from itertools import combinations

from pyspark.sql import functions as F

from cohortwarn.catalog.registry import COHORT, PICKS_SQL, factor_sql, r6, register, rounded
from cohortwarn.operators import hypotheses, summary
from cohortwarn.operators.clean import drop_missing
from cohortwarn.operators.dedup import first_per_key
from cohortwarn.operators.joins import cohort_features
from cohortwarn.plans.tables import FACTORS, pair_table, snapshot_factors
from cohortwarn.sources import cohort_tables, load, read_cohort

_FAILS = "select course, count(student_id) as n_students from grades where grade = 'F' group by course"


@register(_FAILS + " order by n_students desc, course", cohort=True)
def fail_counts(spark, path):
    return summary.fail_counts(cohort_tables(spark, path).grades)


@register(PICKS_SQL + """, m as (select g1.grade, a1.lesson_time, a1.absence_time, d.math_score
          from g1 join a1 using (student_id) join diagnostics d using (student_id))
          select grade, round(avg(lesson_time), 6) as lesson_time, round(avg(absence_time), 6) as absence_time,
          round(avg(math_score), 6) as math_score from m group by grade""", cohort=True)
def group_means(spark, path):
    t = cohort_tables(spark, path)
    g = first_per_key(read_cohort(t.grades, COHORT.course, exact=True), ["student_id"], ["id"])
    a = first_per_key(read_cohort(t.absence, COHORT.course, exact=True), ["student_id"], COHORT.absence_order)
    rows = g.select("student_id", "grade").join(a.select("student_id", "lesson_time", "absence_time"), "student_id").join(
        t.diagnostics.select("student_id", "math_score"), "student_id")
    out = summary.group_means(rows, ["grade"], exclude=["student_id"])
    return rounded(out, "lesson_time", "absence_time", "math_score")


@register(
    "".join(
        f"{'union all ' if i else ''}select '{c}' as variable, count({c}) as n, 'absence' as table_name from absence "
        for i, c in enumerate(["course", "school_year", "lesson_time", "absence_time"])), cohort=True)
def column_coverage(spark, path):
    keys = ("student_id", "order_id", "line_no", "part_id", "supplier_id")
    return summary.column_coverage(cohort_tables(spark, path).absence, "absence", exclude=keys)


@register("select grade, count(*) as n from grades group by grade", cohort=True)
def label_counts(spark, path):
    return summary.label_counts(cohort_tables(spark, path).grades, "grade")


_GRADES = ("A", "B", "C", "D", "E", "F")
_POINTED = "select course, " + ", ".join(
    f"""cast(count(*) filter (grade = '{g}') as bigint) as "{g}" """ for g in _GRADES) + """,
    cast(count(*) filter (grade not in ('A', 'B', 'C', 'D', 'E', 'F') or grade is null) as bigint) as other
    from grades group by course"""


@register(_POINTED, cohort=True)
def crosstab(spark, path):
    return summary.crosstab(cohort_tables(spark, path).grades, "course", "grade", _GRADES, other="other")


@register("select count(*) as n from absence", cohort=True)
def stage_count(spark, path):
    return cohort_tables(spark, path).absence.agg(F.count(F.lit(1)).alias("n"))


FUNNEL_SQL = PICKS_SQL + f"""
, dg as (select * from diagnostics where math_score is not null and english_total is not null)
, act as (select * from {factor_sql('snap')} where {' and '.join(f'{f} is not null' for f in FACTORS)})
, ga as (select g1.student_id, g1.grade, a1.absence_time from g1 join a1 using (student_id))
, gad as (select ga.* from ga join dg using (student_id))
, gadc as (select gad.* from gad join act using (student_id))
, funnel as (
  select 1 as stage_no, 'Grades' as stage, (select count(*) from g1) as n
  union all select 2, 'Absence', (select count(*) from ga where absence_time is not null)
  union all select 3, 'Diagnostics', (select count(*) from gad)
  union all select 4, 'Diagnostics P-F', (select count(*) from gad where absence_time is not null and grade <> '-')
  union all select 5, 'Diagnostics E-F', (select count(*) from gad where absence_time is not null and grade in ('E','F'))
  union all select 6, 'Activity', (select count(*) from gadc)
  union all select 7, 'Activity P-F', (select count(*) from gadc where absence_time is not null and grade <> '-')
  union all select 8, 'Activity E-F', (select count(*) from gadc where absence_time is not null and grade in ('E','F')))
"""


def funnel(spark, path):
    return summary.attrition_funnel(
        cohort_tables(spark, path), COHORT.course, COHORT.prefix, COHORT.month_day, COHORT.absence_order, exact=True)


@register(FUNNEL_SQL + "select stage_no, stage, n from funnel", cohort=True)
def attrition_funnel(spark, path):
    return funnel(spark, path)


@register(FUNNEL_SQL + """select stage_no, stage, n, round(n / (select n from funnel where stage_no = 1) * 0.2, 6)
          as retention from funnel""", cohort=True)
def retention(spark, path):
    return rounded(summary.retention(funnel(spark, path)), "retention")


def corr_sql(source: str, cols: list[str]) -> str:
    """One row per ordered pair; a pair with a constant side has no correlation."""
    parts = []
    for a, b in [*combinations(cols, 2), *[(b, a) for a, b in combinations(cols, 2)], *[(c, c) for c in cols]]:
        both = f"{a} is not null and {b} is not null"
        parts.append(
            f"select '{a}' as a, '{b}' as b, case when min({a}) < max({a}) and min({b}) < max({b}) "
            f"then round(corr({a}, {b}), 6) end as r, count(*) as n from {source} where {both}")
    return " union all ".join(parts)


_LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(corr_sql("lineitem", _LINE_COLS))
def correlation_matrix(spark, path):
    return rounded(summary.corr_matrix(load(spark, path, "lineitem"), _LINE_COLS), "r")


_DESCRIBED = ("mean", "std", "q25", "q50", "q75")


@register(
    PICKS_SQL + f"""select grade, n, {r6('mean', 'std')}, "min", {r6('q25', 'q50', 'q75')}, "max" from (
    select grade, count(v) as n, avg(v) as mean, stddev_samp(v) as std, min(v) as "min", max(v) as "max",
      quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.75) as q75
    from (select grade, math_score as v from g1 join a1 using (student_id) join diagnostics using (student_id))
      group by grade)""", cohort=True)
def describe_by_class(spark, path):
    """One row per student: the baseline rows with every grade."""
    t = cohort_tables(spark, path)
    rows = cohort_features(t.grades, t.absence, t.diagnostics, COHORT.course, COHORT.absence_order, exact=True)
    return rounded(summary.describe_by(rows, "grade", "math_score"), *_DESCRIBED)


def histogram_sql(source: str, by: str, cols: list[str], bins: int, shared: bool) -> str:
    """Bin numbers by arithmetic on the range of the group, the top edge in the last bin."""
    long = " union all ".join(f"select {by}, '{c}' as variable, {c}::double as v from {source} where {c} is not null"
                              for c in cols)
    part = "variable" if shared else f"variable, {by}"
    return f""", long as ({long})
    , ranged as (select *, min(v) over (partition by {part}) as mn, max(v) over (partition by {part}) as mx from long)
    , edged as (select *, case when mn = mx then mn - 0.5 else mn end as lo,
                case when mn = mx then mx + 0.5 else mx end as hi from ranged)
    , binned as (select *, cast(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) as integer) as bin from edged)
    select variable, {by}, bin, round(lo + (hi - lo) / {bins} * bin, 6) as bin_start,
           round(lo + (hi - lo) / {bins} * (bin + 1), 6) as bin_end, count(*) as n
    from binned group by variable, {by}, bin, lo, hi"""


_HIST = ["l_extendedprice", "l_quantity"]
_LINES = ", lines as (select l_returnflag, l_extendedprice, l_quantity from lineitem)"


@register("with x as (select 1)" + _LINES + histogram_sql("lines", "l_returnflag", _HIST, 50, False))
def histogram_by_class(spark, path):
    out = summary.histogram_by(load(spark, path, "lineitem"), "l_returnflag", _HIST, 50)
    return rounded(out, "bin_start", "bin_end")


@register("with x as (select 1)" + _LINES + histogram_sql("lines", "l_returnflag", _HIST, 50, True))
def histogram_shared_range(spark, path):
    out = summary.histogram_by(load(spark, path, "lineitem"), "l_returnflag", _HIST, 50, shared=True)
    return rounded(out, "bin_start", "bin_end")


def pair_sql(source: str, by: str, cols: list[str], bins: int) -> str:
    cells = ", ".join(
        f"cast(least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {bins}), {bins - 1}) as integer) as {c}" for c in cols)
    edges = ", ".join(
        f"case when min({c}) = max({c}) then min({c}) - 0.5 else min({c}) end as lo_{c}, "
        f"case when min({c}) = max({c}) then max({c}) + 0.5 else max({c}) end as hi_{c}" for c in cols)
    pairs = " union all ".join(
        f"select '{a}' as a, '{b}' as b, {by}, {a} as bin_a, {b} as bin_b, count(*) as n from cells "
        f"where {a} is not null and {b} is not null group by {by}, {a}, {b}" for a, b in combinations(cols, 2))
    return f", edges as (select {edges} from {source}), cells as (select {by}, {cells} from {source}, edges) {pairs}"


_PAIR_COLS = ["on_time", "page_view_factor", "participation_factor", "absence_time"]


@register(
    PICKS_SQL + f""", fac as {factor_sql('snap1', 'mean')}
    , source as (select grade, on_time, page_view_factor, participation_factor, absence_time
      from (select * from grades where course = '1-URGENT' and grade in ('E', 'F')) g join fac using (student_id)
      join (select student_id, absence_time from absence where course = '1-URGENT') using (student_id)
      where page_view_factor is not null and participation_factor is not null and absence_time is not null)"""
    + pair_sql("source", "grade", _PAIR_COLS, 10), cohort=True)
def pair_distribution(spark, path):
    rows = pair_table(cohort_tables(spark, path), COHORT)
    return summary.pair_bins(rows, "grade", _PAIR_COLS, 10)


_CHI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "with s as (select l_linestatus, count(*) as nc, " + ", ".join(f"sum({c}) as {c}" for c in _CHI)
    + " from lineitem group by 1), cells as (" + " union all ".join(
        f"select '{c}' as feature, nc, {c} as o, sum({c}) over () * nc / sum(nc) over () as e from s" for c in _CHI)
    + """) select feature, round(sum((o - e) * (o - e) / e), 4) as score, cast(count(*) - 1 as integer) as dof from cells
    group by feature order by score desc limit 3""")
def chi_squared_scores(spark, path):
    out = hypotheses.chi2_scores(load(spark, path, "lineitem"), _CHI, "l_linestatus", 3)
    return rounded(out.select("feature", "score", "dof"), "score", digits=4)


@register(
    """with z as (select l_returnflag as g, abs(l_extendedprice - median(l_extendedprice) over (partition by l_returnflag))
      as z from lineitem), m as (select g, count(*) as n, avg(z) as m, var_pop(z) * count(*) as ss from z group by g),
      t as (select avg(z) as overall from z)
    select round((sum(n) - count(*)) * sum(n * (m - overall) * (m - overall)) / ((count(*) - 1) * sum(ss)), 6) as w,
      cast(count(*) - 1 as bigint) as dof_between, cast(sum(n) - count(*) as bigint) as dof_within,
      -- The tail of the F law has this form where three classes are compared.
      round(pow((sum(n) - count(*)) / ((sum(n) - count(*)) + 2 * (sum(n) - count(*)) * sum(n * (m - overall) * (m - overall))
        / ((count(*) - 1) * sum(ss))), (sum(n) - count(*)) / 2.0), 6) as p_value from m, t""")
def levene_statistic(spark, path):
    return rounded(hypotheses.levene(load(spark, path, "lineitem"), "l_extendedprice", "l_returnflag"), "w", "p_value")


@register(
    PICKS_SQL + f", fac as {factor_sql('snap')} select id, student_id, course, {r6(*FACTORS)} from fac "
    f"where {' and '.join(f'{f} is not null' for f in FACTORS)}", cohort=True)
def complete_snapshot(spark, path):
    rows = snapshot_factors(cohort_tables(spark, path), COHORT).select("id", "student_id", "course", *FACTORS)
    return rounded(drop_missing(rows), *FACTORS)
