"""Run one study over a folder of school tables and write the result.

    spark-submit ... cohortwarn/jobs.py --tables DIR --study attrition \
        --course FYSFYS01a --prefix FYSFYS01 --month-day 11-15 --out DIR
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwarn.operators import summary
from cohortwarn.operators.clean import keep
from cohortwarn.operators.evaluate import higher_grade_check
from cohortwarn.operators.hypotheses import chi2_scores
from cohortwarn.operators.models import fit_forest, param_grid
from cohortwarn.plans import studies, tables
from cohortwarn.plans.tables import FACTORS, Cohort
from cohortwarn.session import clear_shared, stable
from cohortwarn.sources.folder import SchoolTables

Study = Callable[[object, Cohort, argparse.Namespace], DataFrame]


def _features(df: DataFrame) -> list[str]:
    return summary.numeric_columns(df, ["row_id", "student_id", "label"])


def _warning_rows(t, c: Cohort, a) -> DataFrame:
    if a.prior:
        courses = {code: f"points_{code}" for code in a.prior}
        return tables.task(tables.early_warning_with_history(t, c, courses, activity=not a.no_activity), a.task)
    return tables.task(tables.early_warning(t, c, scope=a.scope, activity=not a.no_activity), a.task)


def _models(t, c, a):
    rows = _warning_rows(t, c, a)
    return studies.warning_reports(rows, _features(rows), a.drop, trees=a.trees, k=a.neighbours)


def _course_study(t, c, a):
    """All four forests of a course with everything that is measured of each."""
    rows = _warning_rows(t, c, a)
    return studies.forest_study(rows, _features(rows), a.drop, a.balance, studies.TUNED, a.repeats, k=a.neighbours,
                                m=a.border, trees=a.trees)


def _all_variables_study(t, c, a):
    rows = tables.all_variables(t, c)
    features = [x for x in _features(rows) if x not in a.drop]
    return studies.task_studies(rows, features, balance=a.balance, tuned=studies.TUNED, k=a.neighbours, m=a.border,
                                trees=a.trees)


def _before_after(part: int):
    def run(t, c, a):
        rows = tables.task(tables.activity_baseline(t, c), a.task)
        return studies.before_after_study(rows, _features(rows), trees=a.trees, k=a.neighbours, whole=a.whole)[part]

    return run


def _ablation(t, c, a):
    rows = _warning_rows(t, c, a)
    return studies.ablation(rows, _features(rows), a.drop_sets, trees=a.trees)


def _search(t, c, a):
    rows = _warning_rows(t, c, a)
    return studies.tuned_forest(rows, _features(rows), param_grid(**a.grid))[1]


def _feature_scores(t, c, a):
    rows = _warning_rows(t, c, a)
    return chi2_scores(rows, _features(rows), "label")


def _higher_grades(t, c, a):
    every = stable(tables.early_warning(t, c, scope=a.scope, activity=not a.no_activity), "scores")
    rows = tables.task(every, "EF")
    model = fit_forest(rows, _features(rows), "label", trees=a.trees)
    return higher_grade_check(model, every)


def _forest(table):
    def run(t, c, a):
        rows = tables.task(table(t, c), a.task)
        return studies.forest_scores(rows, _features(rows), trees=a.trees)

    return run


def _tree(table, test):
    def run(t, c, a):
        rows = tables.task(table(t, c), a.task)
        rows = keep(rows, [x for x in rows.columns if x != "lesson_time"])
        return studies.tree_report(rows, _features(rows), test=test, max_depth=a.depth, min_leaf=a.leaf)[0]

    return run


#: Settings that a search tries when none are given.
GRID = {"trees": [10, 20, 50], "max_depth": [None, 4], "max_features": [None, "sqrt"], "min_leaf": [1, 2]}

STUDIES: dict[str, Study] = {
    "attrition": lambda t, c, a: summary.retention(summary.attrition_funnel(
        t, c.course, c.prefix, c.month_day, c.absence_order, diagnostics_drop=a.drop,
        diagnostics_order=c.diagnostics_order, exact=c.exact)),
    "fails": lambda t, c, a: summary.fail_counts(t.grades, min_n=5),
    "coverage": lambda t, c, a: studies.coverage(t, c),
    "correlation": lambda t, c, a: summary.corr_matrix(tables.correlation_table(t, c)),
    "grade_means": lambda t, c, a: summary.group_means(
        tables.absence_score(t, c), ["grade"], ["row_id", "student_id"]),
    "warning_table": _warning_rows,
    "warning_models": _models,
    "warning_search": _search,
    "course_study": _course_study,
    "all_variables_study": _all_variables_study,
    "before_after_study": _before_after(0),
    "before_after_predictions": _before_after(1),
    "ablation": _ablation,
    "all_variables": lambda t, c, a: tables.all_variables(t, c),
    "histograms": lambda t, c, a: summary.histogram_by(
        tables.task(tables.all_variables(t, c), a.task), "grade", ["absence_time", *FACTORS]),
    "pairs": lambda t, c, a: summary.pair_bins(
        tables.pair_table(t, c), "grade", ["on_time", "page_view_factor", "participation_factor", "absence_time"]),
    "tree_absence_score": _tree(tables.absence_score, 0.2),
    "tree_absence_activity": _tree(tables.absence_activity, 0.2),
    "tree_activity": _tree(tables.activity_only, 0.3),
    "forest_baseline": _forest(tables.baseline),
    "before_after": lambda t, c, a: studies.before_after_smote(
        rows := tables.task(tables.activity_baseline(t, c), a.task), _features(rows), trees=a.trees, k=a.neighbours),
    "class_correlation": lambda t, c, a: summary.corr_matrix(tables.class_correlation_table(
        t, c, a.classes, F.to_date(F.lit(a.day)))),
    "feature_scores": _feature_scores,
    "higher_grades": _higher_grades,
    "forest_activity": _forest(tables.activity_baseline),
}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--tables", required=True)
    p.add_argument("--study", required=True, choices=sorted(STUDIES))
    p.add_argument("--out", required=True)
    p.add_argument("--course", required=True)
    p.add_argument("--prefix", help="class codes of the activity table start with this; default: 8 letters of the course")
    p.add_argument("--month-day", default="02-15")
    p.add_argument("--task", choices=["EF", "PF"], default="EF")
    p.add_argument("--scope", choices=["course", "student"], default="course")
    p.add_argument("--prior", nargs="*", default=[], help="earlier courses whose grades become variables")
    p.add_argument("--drop", nargs="*", default=[], help="variables to leave out")
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--neighbours", type=int, default=5)
    p.add_argument("--border", type=int, default=10, help="neighbours that tell whether a row is at the border")
    p.add_argument("--balance", choices=["borderline", "plain"], default="borderline")
    p.add_argument("--repeats", type=int, default=0, help="shuffles of each variable for permutation importances")
    p.add_argument("--whole", action="store_true", help="balance all rows before they are split")
    p.add_argument("--depth", type=int, default=5, help="of a tree")
    p.add_argument("--leaf", type=int, default=1, help="least rows in a leaf of a tree")
    p.add_argument("--drop-sets", type=json.loads, default={}, help="JSON: name of a variant to the variables it leaves out")
    p.add_argument("--classes", nargs="*", default=[], help="class codes, for class_correlation")
    p.add_argument("--day", help="snapshot day, for class_correlation")
    p.add_argument("--grid", type=json.loads, default=GRID, help="JSON: values to try for each forest parameter")
    p.add_argument("--no-activity", action="store_true")
    p.add_argument("--exact", action="store_true", help="codes have one spelling: push the filters down")
    p.add_argument("--plan-names", action="store_true", help="tables carry the names of this package")
    return p.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    t = SchoolTables(spark, a.tables, source_names=not a.plan_names)
    cohort = Cohort(
        a.course, a.prefix or a.course[:8], a.month_day, ("school_year", "id"), ("id",), exact=a.exact)
    try:
        STUDIES[a.study](t, cohort, a).write.mode("errorifexists").parquet(a.out)
    finally:
        clear_shared(spark)


if __name__ == "__main__":
    run(SparkSession.builder.appName("cohortwarn").getOrCreate(), arguments())
