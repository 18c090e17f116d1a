from cohortwarn.sources.bindings import COHORT_SQL, cohort_tables
from cohortwarn.sources.dictionary import SOURCE_COLUMNS, VARIABLE_LABELS, to_canonical
from cohortwarn.sources.tables import (
    describe_columns,
    load,
    load_jdbc,
    load_table,
    on_month_day,
    read_cohort,
    read_snapshot,
)

__all__ = [
    "COHORT_SQL", "SOURCE_COLUMNS", "VARIABLE_LABELS", "cohort_tables", "describe_columns", "load",
    "load_jdbc", "load_table", "on_month_day", "read_cohort", "read_snapshot", "to_canonical",
]
