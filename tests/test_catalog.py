"""All registered queries: same answer as their SQL, and plans that hold at scale."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from cohortwarn.catalog import QUERIES, SQL

CHECKED = [n for n in QUERIES if n in SQL]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_same_answer_as_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python
    assert differences(df, con, SQL[name]) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and entry.queries().keys() >= entry.oracle_sql().keys()


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["prefix_filter"](spark, small))
    assert "StringStartsWith(event_type,view)" in text
    assert "props" not in text and "ts:" not in text
    text = plan(QUERIES["cohort_read"](spark, small))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text
    assert "o_totalprice" not in text
    text = plan(QUERIES["scan_students"](spark, small))
    assert "ReadSchema: struct<c_custkey:bigint>" in text


def test_first_row_per_key_is_limited_before_the_shuffle(spark, small):
    text = plan(QUERIES["first_absence_year"](spark, small))
    assert text.count("WindowGroupLimit") == 2 and "row_number(), 1, Partial" in text


def test_funnel_is_one_pass_per_table(spark, small):
    text = plan(QUERIES["attrition_funnel"](spark, small))
    # Activity is read for the class medians and for the rows; the view of
    # absence joins two tables; the rest is read once.
    assert text.count("FileScan parquet") == 6
    assert "Union" not in text


def test_counts_are_combined_before_the_shuffle(spark, small):
    for name in ("fail_counts", "histogram_by_class", "crosstab", "label_counts"):
        assert "partial_count" in plan(QUERIES[name](spark, small))


def test_modelling_rows_are_joined_once(spark, small):
    """The jobs of a fit, and what is made of the model, read the kept table, not the sources again."""
    for name in ("tree_of_depth_one", "forest_of_stumps", "permutation_by_stump", "higher_grades_by_stump", "higher_grade_check",
                 "higher_grades_with_activity", "leaf_rules", "leaf_rules_by_stump"):
        read = QUERIES[name](spark, small).inputFiles()
        assert not [f for f in read if f.startswith(f"file://{small}")], name
