"""Cohort views over the star-schema test tables.

Orders stand for grades, order lines for absence records, customers for
students and their diagnostic tests, events for activity snapshots.  The SQL
text below is the same data model for an independent engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwarn.sources.tables import load

# Grade by remainder of the order key.
_GRADES = ("A", "B", "C", "D", "E", "F", "-")
# Class letter by remainder of the user id.
_CLASSES = ("A", "B", "C")

COURSE = "1-URGENT"
PRIOR_COURSES = ("2-HIGH", "3-MEDIUM", "5-LOW")
CLASS_PREFIX = "view"
MONTH_DAY = "01-15"
ABSENCE_ORDER = ("school_year", "order_id", "line_no", "part_id", "supplier_id")

COHORT_SQL = """
with grades as (
  select o_orderkey id, o_custkey student_id, o_orderpriority course,
    case o_orderkey % 7 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D'
                        when 4 then 'E' when 5 then 'F' else '-' end grade
  from orders),
absence as (
  select o_custkey student_id, o_orderpriority course, cast(year(l_shipdate) as integer) school_year,
    l_extendedprice lesson_time, case when l_linenumber = 7 then null else l_quantity end absence_time,
    l_orderkey order_id, l_linenumber line_no, l_partkey part_id, l_suppkey supplier_id
  from lineitem join orders on l_orderkey = o_orderkey),
diagnostics as (
  select c_custkey student_id, case when c_custkey % 10 = 0 then null else c_acctbal end math_score,
    case when c_custkey % 13 = 0 then 'NULL'
         else concat(cast(c_custkey % 101 as varchar), '%') end english_total
  from customer),
activity as (
  select event_id id, user_id student_id,
    concat(event_type, '-', case user_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end) course,
    cast(ts as date) snapshot_date,
    cast(floor(value) as integer) page_views, cast(event_id % 5 as integer) participations,
    cast(event_id % 4 as integer) missing, cast(event_id % 7 as integer) on_time,
    cast(event_id % 3 as integer) late
  from events),
students as (select c_custkey student_id from customer)
"""


def _pick(remainder, values):
    expr = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        expr = F.when(remainder == i, F.lit(v)).otherwise(expr)
    return expr


class CohortTables:
    """The cohort views; a table is opened when its view is first asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self._open = lambda name: load(spark, path, name)

    @cached_property
    def grades(self) -> DataFrame:
        c = F.col
        return self._open("orders").select(
            c("o_orderkey").alias("id"),
            c("o_custkey").alias("student_id"),
            c("o_orderpriority").alias("course"),
            _pick(c("o_orderkey") % 7, _GRADES).alias("grade"),
        )

    @cached_property
    def absence(self) -> DataFrame:
        c = F.col
        lines, orders = self._open("lineitem"), self._open("orders")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            c("o_custkey").alias("student_id"),
            c("o_orderpriority").alias("course"),
            F.year("l_shipdate").alias("school_year"),
            c("l_extendedprice").alias("lesson_time"),
            F.when(c("l_linenumber") != 7, c("l_quantity")).alias("absence_time"),
            c("l_orderkey").alias("order_id"),
            c("l_linenumber").alias("line_no"),
            c("l_partkey").alias("part_id"),
            c("l_suppkey").alias("supplier_id"),
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        key = F.col("c_custkey")
        share = F.concat((key % 101).cast("string"), F.lit("%"))
        return self._open("customer").select(
            key.alias("student_id"),
            F.when(key % 10 != 0, F.col("c_acctbal")).alias("math_score"),
            F.when(key % 13 == 0, F.lit("NULL")).otherwise(share).alias("english_total"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        c = F.col
        return self._open("events").select(
            c("event_id").alias("id"),
            c("user_id").alias("student_id"),
            F.concat(c("event_type"), F.lit("-"), _pick(c("user_id") % 3, _CLASSES)).alias("course"),
            c("ts").cast("date").alias("snapshot_date"),
            F.floor("value").cast("int").alias("page_views"),
            (c("event_id") % 5).cast("int").alias("participations"),
            (c("event_id") % 4).cast("int").alias("missing"),
            (c("event_id") % 7).cast("int").alias("on_time"),
            (c("event_id") % 3).cast("int").alias("late"),
        )

    @cached_property
    def students(self) -> DataFrame:
        return self._open("customer").select(F.col("c_custkey").alias("student_id"))


def cohort_tables(spark: SparkSession, path: str) -> CohortTables:
    return CohortTables(spark, path)
