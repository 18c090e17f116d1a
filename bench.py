"""Time the headline queries and print one JSON line.

Each query is planned and run to the end without collecting its rows.  One
small query runs first, so session start is not part of the first figure.
"""

from __future__ import annotations

import json
import os
import time

from cohortwarn.catalog import QUERIES
from cohortwarn.session import local_session

HEADLINE = [
    "fail_counts", "failing_courses", "first_grade", "first_absence_year", "engagement_factors", "class_median",
    "cohort_features_same_course", "student_table", "prior_grades", "merge_keep", "attrition_funnel", "retention",
    "variable_coverage", "correlation_matrix", "correlation_study", "histogram_by_class", "describe_by_class",
    "pair_distribution", "chi_squared_scores", "levene_statistic", "train_test_split", "stratified_folds",
    "classification_report", "smote_rows", "danger_rows", "borderline_smote_rows", "decision_tree", "out_of_bag",
    "permutation_importance", "grid_search", "early_warning_table", "all_variables_histograms",
    "early_warning_models", "before_after_balance",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("cohortwarn-bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["scan_students"](spark, path))
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, path))
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
