"""A folder (or catalog schema) of school tables under their source or plan names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortwarn.sources.dictionary import SOURCE_TABLES, to_canonical
from cohortwarn.sources.tables import load, load_table


class SchoolTables:
    """Tables open when first asked for, with the column names of this package.

    ``location`` is a folder of Parquet tables, or a schema of the catalog with
    ``catalog=True``.  ``source_names`` says that tables carry their source names.
    """

    def __init__(self, spark: SparkSession, location: str, source_names: bool = True, catalog: bool = False):
        self._spark, self._location, self._catalog = spark, location, catalog
        self._names = {plan: (src if source_names else plan) for src, plan in SOURCE_TABLES.items()}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        source = self._names[name]
        if self._catalog:
            df = load_table(self._spark, f"{self._location}.{source}")
        else:
            df = load(self._spark, self._location, source)
        df = to_canonical(df)
        setattr(self, name, df)
        return df
