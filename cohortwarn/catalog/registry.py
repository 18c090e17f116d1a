"""Query registry and the SQL pieces that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwarn.plans.tables import Cohort
from cohortwarn.sources.bindings import ABSENCE_ORDER, CLASS_PREFIX, COHORT_SQL, COURSE, MONTH_DAY

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

COHORT = Cohort(COURSE, CLASS_PREFIX, MONTH_DAY, ABSENCE_ORDER, exact=True)

# One grade and one absence record per student of the course, and the snapshot.
PICKS_SQL = f"""
, g1 as (select * from grades where course = '{COURSE}'
         qualify row_number() over (partition by student_id order by id) = 1)
, a1 as (select * from absence where course = '{COURSE}'
         qualify row_number() over (partition by student_id order by {", ".join(ABSENCE_ORDER)}) = 1)
, a1any as (select * from absence
         qualify row_number() over (partition by student_id order by {", ".join(ABSENCE_ORDER)}) = 1)
, snap as (select * from activity where course like '{CLASS_PREFIX}%'
         and strftime(snapshot_date, '%m-%d') = '{MONTH_DAY}')
, snap1 as (select * from snap qualify row_number() over (partition by student_id order by id) = 1)
"""


def factor_sql(source: str, view_stat: str = "median", tardiness_stat: str | None = None) -> str:
    """Select list of the five class-relative factors over ``source``."""
    late = tardiness_stat or view_stat
    cols = [
        ("page_views", "page_view_factor", view_stat), ("participations", "participation_factor", view_stat),
        ("missing", "missing_factor", late), ("on_time", "on_time_factor", late), ("late", "late_factor", late),
    ]
    parts = [f"{c} / nullif({s}({c}) over (partition by course), 0) as {f}" for c, f, s in cols]
    return f"(select *, {', '.join(parts)} from {source})"


def register(sql: str | None = None, cohort: bool = False, name: str | None = None):
    """Add a query; ``cohort`` puts the cohort views in front of its SQL."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = COHORT_SQL + sql if cohort else sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def r6(*cols: str) -> str:
    """The same rounding in SQL."""
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)
