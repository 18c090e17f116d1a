"""Session defaults and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "cohortwarn", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and every executor reach.

    It is the one named in ``spark.checkpoint.dir``; where that is unset (tests, notebooks), a folder in the
    session's warehouse.  Each application has its own subfolder.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_shared(spark: SparkSession) -> None:
    """Remove the intermediate data of this application, when all results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame, name: str = "table", *partition_by: str) -> DataFrame:
    """Compute ``df`` once, write it as Parquet to the shared folder and read it from there.

    Used where several jobs run over one expensive table (a model fit is many jobs): the stored copy survives
    lost executors, cuts the lineage, and later reads still prune columns and partitions.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)
