"""Named queries over the test tables, each with SQL for an independent engine where SQL can say it."""

from cohortwarn.catalog import cleaning, factors, joining, learning, scans, studies, summaries
from cohortwarn.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "factors", "joining", "learning", "scans", "studies", "summaries"]
