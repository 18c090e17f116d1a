"""Whole studies: modelling tables with SQL, model results without."""

from pyspark.sql import functions as F

from cohortwarn.catalog.joining import _PRIOR, prior_sql
from cohortwarn.catalog.learning import FEATURES, SCORES_SQL, stump_predicts, stump_sql
from cohortwarn.catalog.registry import COHORT, PICKS_SQL, factor_sql, r6, register, rounded
from cohortwarn.catalog.summaries import corr_sql, histogram_sql
from cohortwarn.operators import evaluate, models, summary
from cohortwarn.plans import studies, tables
from cohortwarn.plans.tables import FACTORS, VIEW_FACTORS
from cohortwarn.session import stable
from cohortwarn.sources import cohort_tables

_COMPLETE = " and ".join(f"{f} is not null" for f in FACTORS)
_BASE = ["absence_time", "math_score", "english_total"]


def _early_sql(factors) -> str:
    known = " and ".join(f"{f} is not null" for f in factors)
    return PICKS_SQL + f""", fac as {factor_sql('snap')}
    , early as (select fac.id as row_id, g1.student_id, g1.grade, a1.absence_time, d.math_score,
        cast(replace(d.english_total, '%', '') as integer) as english_total, {', '.join(factors)}
      from g1 join a1 using (student_id) join diagnostics d using (student_id) join fac using (student_id)
      where a1.absence_time is not null and d.math_score is not null and d.english_total <> 'NULL' and {known})"""


@register(_early_sql(FACTORS) + f"""select row_id, student_id, grade, absence_time, math_score, english_total,
          {r6(*FACTORS)} from early""", cohort=True)
def early_warning_table(spark, path):
    return rounded(tables.early_warning(cohort_tables(spark, path), COHORT), *FACTORS)


@register(
    _early_sql(FACTORS) + """
    , pf as (select *, case when grade = 'F' then 0.0 else 1.0 end::double as label from early where grade <> '-')"""
    + stump_sql("s", "pf", "english_total") + f""", scored as (select grade, {stump_predicts('s', 'english_total')} as p
      from early, s_best where grade in ('A', 'B', 'C', 'D'))
    select grade, count(*) filter (p = 0) as "F", count(*) filter (p = 1) as "P" from scored group by grade""", cohort=True)
def higher_grades_with_activity(spark, path):
    """Students above the limit whom a one-cut tree on the table with activity would have flagged."""
    every = stable(tables.early_warning(cohort_tables(spark, path), COHORT), "scores")
    model = models.fit_tree(tables.task(every, "PF"), ["english_total"], "label", max_depth=1)
    return evaluate.higher_grade_check(model, every)


@register()
def all_variables_study(spark, path):
    """The study of every variable for one way to cut the grades, with activity and tests."""
    rows = tables.all_variables(cohort_tables(spark, path), COHORT)
    rows = rows.select("row_id", "grade", *_BASE, *FACTORS)
    return studies.task_studies(rows, [*_BASE, *FACTORS], ["PF"], balance="plain", k=2, trees=5)


@register()
def early_warning_models(spark, path):
    rows = tables.task(tables.early_warning(cohort_tables(spark, path), COHORT), "PF")
    return studies.warning_reports(rows, [*FEATURES, *FACTORS], dropped=["english_total"], trees=50)


@register(_early_sql(["page_view_factor"]) + prior_sql() + f"""select row_id, student_id, grade, absence_time, math_score,
          english_total, {r6('page_view_factor')}, points_1, points_2, points_3 from early
          join points_1_t using (student_id) join points_2_t using (student_id) join points_3_t using (student_id)""",
          cohort=True)
def history_table(spark, path):
    rows = tables.early_warning_with_history(cohort_tables(spark, path), COHORT, _PRIOR)
    return rounded(rows, "page_view_factor")


@register()
def history_models(spark, path):
    rows = tables.early_warning_with_history(cohort_tables(spark, path), COHORT, _PRIOR)
    grid = models.param_grid(trees=[10, 20], max_depth=[2, 5], max_features=["sqrt", None])
    features = [*FEATURES, "page_view_factor", *_PRIOR.values()]
    return studies.tuned_forest(tables.task(rows, "PF"), features, grid)[2]


_ALL_SQL = PICKS_SQL + f""", fac as {factor_sql('snap', 'median', 'mean')}
, everything as (select g.student_id, g.grade, a.absence_time, d.math_score,
    cast(replace(d.english_total, '%', '') as integer) as english_total, {', '.join(FACTORS)},
    concat_ws('-', g.id, a.school_year, a.order_id, a.line_no, a.part_id, a.supplier_id, fac.id) as row_id
  from (select * from grades where course = '1-URGENT') g
  join (select * from absence where course = '1-URGENT') a using (student_id)
  join (select * from diagnostics where english_total <> 'NULL') d using (student_id)
  join fac using (student_id))
"""


@register(_ALL_SQL + f"""select row_id, student_id, grade, absence_time, math_score, english_total, {r6(*FACTORS)}
          from everything""", cohort=True)
def all_variables_table(spark, path):
    return rounded(tables.all_variables(cohort_tables(spark, path), COHORT), *FACTORS)


_HIST = ["absence_time", "participation_factor", "page_view_factor", "on_time_factor", "late_factor", "missing_factor"]


@register(
    _ALL_SQL + f""", split as (select case when grade = 'F' then 'F' else 'P' end as grade, {', '.join(_HIST)}
    from everything where grade <> '-' and absence_time is not null and math_score is not null and {_COMPLETE})"""
    + histogram_sql("split", "grade", _HIST, 50, False), cohort=True)
def all_variables_histograms(spark, path):
    rows = tables.task(tables.all_variables(cohort_tables(spark, path), COHORT), "PF")
    return rounded(summary.histogram_by(rows, "grade", _HIST, 50), "bin_start", "bin_end")


@register(
    _ALL_SQL + f""", split as (select case when grade = 'F' then 'F' else 'P' end as grade, {', '.join(_HIST)}
    from everything where grade in ('E', 'F') and absence_time is not null and math_score is not null and {_COMPLETE})"""
    + histogram_sql("split", "grade", _HIST, 50, False), cohort=True)
def all_variables_histograms_ef(spark, path):
    rows = tables.task(tables.all_variables(cohort_tables(spark, path), COHORT), "EF")
    return rounded(summary.histogram_by(rows, "grade", _HIST, 50), "bin_start", "bin_end")


@register()
def all_variables_models(spark, path):
    """All, fewer, balanced and tuned variables of the table with everything."""
    rows = tables.task(tables.all_variables(cohort_tables(spark, path), COHORT), "PF")
    return studies.warning_reports(rows, [*FEATURES, *FACTORS], dropped=["english_total"], trees=20)


def _report_sql(rows: str, x: str, seed: int, train: str) -> str:
    """Rows and test accuracy of a one-cut tree on a whole-number feature of ``rows`` (row_id, label)."""
    return f""", tt as (select *, row_number() over (order by md5('{seed}|' || row_id), row_id) <= {train} as is_train
      from {rows}), tr as (select * from tt where is_train), te as (select * from tt where not is_train)
    {stump_sql('s', 'tr', x)}"""


@register(
    _ALL_SQL + f""", pf as (select *, case when grade = 'F' then 0.0 else 1.0 end::double as label from everything
      where grade <> '-' and absence_time is not null and math_score is not null and {_COMPLETE})"""
    + _report_sql("pf", "english_total", 10, "(select count(*) - ceil(count(*) * 0.2) from pf)")
    + f"""select count(*) as n, round(avg(case when {stump_predicts('s', 'english_total')} = label then 1.0 else 0.0 end), 6)
      as accuracy from te, s_best""", cohort=True)
def all_variables_by_stump(spark, path):
    rows = tables.task(tables.all_variables(cohort_tables(spark, path), COHORT), "PF")
    return rounded(studies.tree_report(rows, ["english_total"], test=0.2, max_depth=1)[1], "accuracy")


_COVERAGE = PICKS_SQL + f"""
, fac as {factor_sql('snap')}
, ab as (select distinct g1.id, g1.student_id, g1.course, g1.grade, a.absence_time from g1
    join (select student_id, absence_time from absence where course = '1-URGENT') a using (student_id))
, di as (select d.* from g1 join (select distinct * from diagnostics) d using (student_id))
, me as (select ab.grade, ab.absence_time, d.math_score, d.english_total, {', '.join('fac.' + f for f in FACTORS)}
    from ab join (select distinct * from diagnostics) d using (student_id) join fac using (student_id))
"""
# Display names of the variables.
_LABELS = {
    "grade": "Grade", "absence_time": "Absence", "math_score": "Math diagnosis", "english_total": "English total",
    "page_view_factor": "Page view factor", "participation_factor": "Participation factor",
    "missing_factor": "Missing factor", "on_time_factor": "On time factor", "late_factor": "Late factor",
}
_PARTS = {
    "grades": ("g1", ["grade"]), "absence": ("ab", ["absence_time"]), "diagnosis": ("di", ["math_score", "english_total"]),
    "activity": ("fac", list(FACTORS)), "merged": ("me", ["grade", *_BASE[:1], "math_score", "english_total", *FACTORS]),
}


@register(
    _COVERAGE + " union all ".join(
        f"select '{_LABELS[c]}' as variable, count({c}) as n, '{name}' as table_name from {source}"
        for name, (source, cols) in _PARTS.items() for c in cols), cohort=True)
def variable_coverage(spark, path):
    return studies.coverage(cohort_tables(spark, path), COHORT)


_CORR = ["grade", "page_views", "participations", "page_view_factor", "participation_factor", "absence_time", "math_score"]


@register(
    PICKS_SQL + f""", fac as {factor_sql('snap1', 'mean')}
    , m as (select case grade when 'F' then 0 else 1 end as grade, page_views, participations, page_view_factor,
        participation_factor, absence_time, math_score from g1 join fac using (student_id) join a1 using (student_id)
        join diagnostics using (student_id) where grade in ('E', 'F')) """ + corr_sql("m", _CORR), cohort=True)
def correlation_study(spark, path):
    rows = tables.correlation_table(cohort_tables(spark, path), COHORT)
    return rounded(summary.corr_matrix(rows, _CORR), "r")


_CLASSES = ("view-A", "view-B", "click-A", "click-B")
_CLASS_CORR = ["grade", "absence_time", "page_views", "participations", "missing", "on_time", "late"]


@register(
    f""", m as (select case g.grade when 'A' then 5 when 'B' then 4 when 'C' then 3 when 'D' then 2 when 'E' then 1
        when 'F' then 0 end as grade, a.absence_time, page_views, participations, missing, on_time, late
      from (select * from grades where course = '1-URGENT') g
      join (select * from absence where course = '1-URGENT') a using (student_id)
      join (select * from activity where course in {_CLASSES} and snapshot_date = date '2024-01-15') s using (student_id)) """
    + corr_sql("m", _CLASS_CORR), cohort=True)
def class_correlation(spark, path):
    day = F.to_date(F.lit("2024-01-15"))
    rows = tables.class_correlation_table(cohort_tables(spark, path), COHORT, _CLASSES, day)
    return rounded(summary.corr_matrix(rows, _CLASS_CORR), "r")


@register(PICKS_SQL + """select g.id as row_id, g.student_id, g.grade, a1.absence_time, a1.lesson_time, d.math_score
          from (select * from grades where course = '1-URGENT') g join a1 using (student_id)
          join diagnostics d using (student_id)""", cohort=True)
def absence_score_table(spark, path):
    return tables.absence_score(cohort_tables(spark, path), COHORT)


@register()
def absence_score_tree(spark, path):
    rows = tables.absence_score(cohort_tables(spark, path), COHORT).drop("lesson_time")
    return studies.tree_report(tables.task(rows, "EF"), ["absence_time", "math_score"], max_depth=5)[0]


@register(PICKS_SQL + f""", fac as {factor_sql('snap1', 'mean')}
          select g.id as row_id, g.student_id, g.grade, a1.absence_time, {r6('page_view_factor')}
          from (select * from grades where course = '1-URGENT') g join a1 using (student_id) join fac using (student_id)""",
          cohort=True)
def absence_activity_table(spark, path):
    return rounded(tables.absence_activity(cohort_tables(spark, path), COHORT), "page_view_factor")


@register()
def absence_activity_tree(spark, path):
    rows = tables.task(tables.absence_activity(cohort_tables(spark, path), COHORT), "PF")
    return studies.tree_report(rows, ["absence_time", "page_view_factor"], max_depth=5, min_leaf=2)[1]


@register(PICKS_SQL + f""", fac as {factor_sql('snap1', 'mean')}
          select g.id as row_id, g.student_id, g.grade, on_time, {r6('page_view_factor', 'participation_factor')}
          from (select * from grades where course = '1-URGENT') g join fac using (student_id)""", cohort=True)
def activity_only_table(spark, path):
    rows = tables.activity_only(cohort_tables(spark, path), COHORT)
    return rounded(rows, "page_view_factor", "participation_factor")


@register()
def activity_only_tree(spark, path):
    rows = tables.task(tables.activity_only(cohort_tables(spark, path), COHORT), "EF")
    features = ["on_time", "page_view_factor", "participation_factor"]
    return studies.tree_report(rows, features, test=0.3, max_depth=5)[1]


@register()
def activity_pass_tree(spark, path):
    """The pass/fail tree on hand-ins, views and participation."""
    rows = tables.task(tables.activity_only(cohort_tables(spark, path), COHORT), "PF")
    features = ["on_time", "page_view_factor", "participation_factor"]
    return studies.tree_report(rows, features, test=0.2, max_depth=5, min_leaf=2)[1]


@register(
    PICKS_SQL + f""", fac as {factor_sql('snap1', 'mean')}
    , pf as (select g.id as row_id, on_time, case when g.grade = 'F' then 0.0 else 1.0 end::double as label
      from (select * from grades where course = '1-URGENT') g join fac using (student_id) where g.grade <> '-'
        and on_time is not null and page_view_factor is not null and participation_factor is not null)"""
    + _report_sql("pf", "on_time", 10, "(select count(*) - ceil(count(*) * 0.2) from pf)")
    + f"""select count(*) as n, round(avg(case when {stump_predicts('s', 'on_time')} = label then 1.0 else 0.0 end), 6)
      as accuracy from te, s_best""", cohort=True)
def activity_tree_by_stump(spark, path):
    rows = tables.task(tables.activity_only(cohort_tables(spark, path), COHORT), "PF")
    return rounded(studies.tree_report(rows, ["on_time"], test=0.2, max_depth=1)[1], "accuracy")


@register(PICKS_SQL + """select g1.student_id as row_id, g1.grade, a1any.absence_time, d.math_score
          from g1 join a1any using (student_id) join diagnostics d using (student_id)
          where g1.grade in ('E', 'F') and a1any.absence_time is not null and d.math_score is not null""", cohort=True)
def baseline_table(spark, path):
    return tables.baseline(cohort_tables(spark, path), COHORT)


@register()
def baseline_forest(spark, path):
    rows = tables.task(tables.baseline(cohort_tables(spark, path), COHORT), "EF")
    return studies.forest_scores(rows, ["absence_time", "math_score"], trees=50)


@register(PICKS_SQL + f""", fac as {factor_sql('snap1', 'mean')}
          select g1.student_id as row_id, g1.grade, d.math_score, a1.absence_time, missing,
            {r6('page_view_factor', 'participation_factor')}
          from g1 join diagnostics d using (student_id) join a1 using (student_id) join fac using (student_id)
          where g1.grade in ('E', 'F') and d.math_score is not null and a1.absence_time is not null
            and page_view_factor is not null and participation_factor is not null""", cohort=True)
def activity_baseline_table(spark, path):
    rows = tables.activity_baseline(cohort_tables(spark, path), COHORT)
    return rounded(rows, "page_view_factor", "participation_factor")


@register()
def before_after_balance(spark, path):
    rows = tables.task(tables.activity_baseline(cohort_tables(spark, path), COHORT), "EF")
    return studies.before_after_smote(rows, ["absence_time", "math_score", "missing", *VIEW_FACTORS], trees=50)


@register(
    """select student_id, count(student_id) as n_students from grades where grade = 'F' group by student_id
    having count(student_id) >= 2""", cohort=True)
def repeated_failures(spark, path):
    """Groups with two fails or more; at every scale some groups have fewer."""
    return summary.fail_counts(cohort_tables(spark, path).grades, course="student_id", student="id", min_n=2)


@register(
    """select course, count(student_id) as "Number of students" from grades where grade = 'F' group by course
    having count(student_id) >= 5""", cohort=True)
def failing_courses(spark, path):
    rows = summary.fail_counts(cohort_tables(spark, path).grades, min_n=5)
    return rows.withColumnsRenamed({"n_students": "Number of students"})


@register(
    PICKS_SQL + """, m as (select g.grade, a1.lesson_time, a1.absence_time, d.math_score
      from (select * from grades where course = '1-URGENT') g join a1 using (student_id) join diagnostics d using (student_id))
    select grade, round(avg(absence_time), 6) as absence_time, round(avg(lesson_time), 6) as lesson_time,
      round(avg(math_score), 6) as math_score from m group by grade""", cohort=True)
def grade_means(spark, path):
    rows = tables.absence_score(cohort_tables(spark, path), COHORT)
    out = summary.group_means(rows, ["grade"], exclude=["row_id", "student_id"])
    return rounded(out, "absence_time", "lesson_time", "math_score")


@register(
    SCORES_SQL + "select 'PF' as task, label, count(*) as n from pf group by label union all "
    "select 'EF', label, count(*) from ef group by label", cohort=True)
def task_sizes(spark, path):
    rows = tables.early_warning(cohort_tables(spark, path), COHORT, activity=False)
    parts = [summary.label_counts(tables.task(rows, t), "label").select(F.lit(t).alias("task"), "label", "n")
             for t in ("PF", "EF")]
    return summary.append_tables(parts)
