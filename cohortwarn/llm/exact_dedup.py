"""Exact deduplication as a stateful stream, in DataFrame operations only.

Arrivals (digest, doc_id, place of the content) are read as a stream into keyed state on disk, without expiry: for
each digest how many rows had it, and the stable identifier and content locator of the row that stays.  More
arrivals may be added to the same state later; it is kept in the folder given.  The state is then read as a table.

Rows whose digest the state knows from another row are hits.  Their full text is compared, byte by byte, with the
text that the locator of the staying row points to.  Should different texts share a digest, the rows of that digest
are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwarn.llm.common import lower_ascii, text_of
from cohortwarn.session import new_folder, stable

#: State on local disk, saved to the shared folder after each batch, with memory bounded for each executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Many small stores: no space is set aside in advance, and a batch saves what it changed.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
KEEPER = "named_struct('doc_id', doc_id, 'file', file, 'row', row)"
ARRIVALS = "digest binary, doc_id long, file long, row long"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` as files in which every row has a place of its own.

    Only a frame that is nothing but a file scan is taken as it is.  Above a join or an ``explode`` the same place
    stands for many rows, so anything else is written first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return stable(docs, "documents")
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return stable(docs, "documents")


def located(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, doc_id, place and normalised text of each row of a file scan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"), lower_ascii(text_of()).alias("norm"))
    return rows.select(digest(F.col("norm")).alias("digest"), "doc_id", "file", "row", "norm")


def add_arrivals(spark: SparkSession, arrivals: str, state: str) -> DataFrame:
    """Read what is new in the folder ``arrivals`` into the state kept in ``state``; the whole state as a table.

    digest, doc_id, file and row of the staying row, n.  A failed run goes on where its last batch ended.
    """
    stream = spark.readStream.schema(ARRIVALS).parquet(arrivals)
    kept = stream.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.expr(KEEPER)).alias("keeper"))
    with settings(spark, STATE_SETTINGS):
        run = (kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        table = spark.read.format("statestore").load(state)
        count, keeper = table.schema["value"].dataType.names
        return table.select("key.digest", f"value.{keeper}.doc_id", f"value.{keeper}.file", f"value.{keeper}.row",
                            F.col(f"value.{count}").alias("n"))


def mark_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its place (file, row).

    Texts are equal when they are identical after lower-casing A to Z; a null text counts as empty.  Of equal texts
    the row with the largest doc_id stays; a null doc_id is smaller than any other, and of rows that repeat the
    largest doc_id one stays.  An empty table gives no rows.  Only doc_id and text are read, so other columns may
    have any name.
    """
    spark = docs.sparkSession
    docs = scanned(docs)
    folder = new_folder(spark, "exact-dedup")
    rows = located(docs, digest).withColumn("text_sha256", F.sha2("norm", 256))
    rows.select("digest", "doc_id", "file", "row", "text_sha256").write.parquet(f"{folder}/arrivals")
    arrived = spark.read.parquet(f"{folder}/arrivals")
    state = add_arrivals(spark, f"{folder}/arrivals", f"{folder}/state")
    state = stable(state.select("digest", F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"),
                                F.col("row").alias("keep_row"), "n"), "state")
    is_keeper = F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))

    # Full texts of hits only, beside the text that the locator names.
    shared = state.filter("n > 1").select("digest", "keep_file", "keep_row")
    hits = stable(located(docs, digest).join(shared, "digest").select(
        "digest", "doc_id", "file", "row", is_keeper.alias("keeper"), "norm"), "hits")
    own = hits.filter("keeper").select(F.col("digest").alias("own_digest"), F.col("norm").alias("own_norm"))
    differ = hits.join(own, (F.col("digest") == F.col("own_digest")) & (F.col("norm") != F.col("own_norm")))
    # Written before it is made distinct, so that nothing above the join keeps a hot digest from being split.
    differ = stable(differ.select("digest"), "shared-digests").distinct()

    marked = arrived.join(state, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), is_keeper.alias("kept"), "text_sha256", "file", "row",
        "digest")
    if differ.isEmpty():
        return marked.drop("digest")
    again = hits.join(differ, "digest", "left_semi")
    groups = again.groupBy("norm").agg(F.count("*").alias("group_size"), F.max(F.expr(KEEPER)).alias("keeper"))
    again = again.select("norm", "doc_id", "file", "row").join(groups, "norm").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"), "file", "row")
    return marked.join(differ, "digest", "left_anti").drop("digest").unionByName(again)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row with the same text stands for; all columns stay."""
    docs = scanned(docs)
    dropped = mark_copies(docs).filter("not kept").select(F.col("file").alias("_drop_file"), F.col("row").alias("_drop_row"))
    here = docs.select("*", F.xxhash64("_metadata.file_path").alias("_at_file"),
                       F.col("_metadata.row_index").alias("_at_row"))
    same = (F.col("_at_file") == F.col("_drop_file")) & (F.col("_at_row") == F.col("_drop_row"))
    return here.join(stable(dropped, "dropped"), same, "left_anti").drop("_at_file", "_at_row")
