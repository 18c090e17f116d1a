"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 64-bit hash.  A source takes all its documents a whole number of times, and once more those
whose hash is below the source's threshold.  The threshold is found without sorting: sizes are summed by source and
by the first 16 bits of the hash, the running sums say in which bucket the budget ends, and only the rows of that
boundary bucket are summed again by the next 16 bits, four times in all.  Thresholds of a smaller budget are never
above those of a larger one, so mixes for growing budgets contain each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwarn.llm.common import NOT_SPACE, text_of
from cohortwarn.session import stable

BITS, ROUNDS = 16, 4
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
LIMIT = 3


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size -> target: the total shared by weight, none above ``limit`` times its source.

    What a source cannot take is shared again by weight.  In order of limit per weight the first sources stop at
    their limits; the rest share what is left, so one running sum finds them all.  One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(limit))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # What one unit of weight gets if this source and all after it are below their limits.
    w = w.withColumn("level", F.greatest(left, F.lit(0.0)) / weight_left)
    w = w.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stopped = ~F.max("free").over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(stopped, F.col("cap")).otherwise(level * F.col("weight"))
    return w.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, whole, threshold: rows (source, size, hash) below the threshold add up to what ``whole`` copies of
    the source leave of its target, to within half of the document at the boundary.

    ``hash`` is split into unsigned 16-bit digits; the threshold is written as that prefix of digits, padded.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    at = budgets.select("source", whole.cast("long").alias("whole"),
                        (F.col("target") - whole * F.col("source_size")).alias("rest"))
    at = stable(at.withColumn("prefix", F.lit("")), "budgets")
    for k in range(ROUNDS):
        digit = F.substring("key", 4 * k + 1, 4)
        inside = rows if k == 0 else rows.join(
            at.select(F.col("source").alias("_source"), F.col("prefix")),
            F.col("source").eqNullSafe(F.col("_source")) & (F.substring("key", 1, 4 * k) == F.col("prefix")))
        bins = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("size"))
        below = F.sum("size").over(Window.partitionBy("source").orderBy("digit").rowsBetween(
            Window.unboundedPreceding, -1))
        bins = bins.select("source", "digit", "size", F.coalesce(below, F.lit(0)).alias("below"))
        joined = bins.withColumnRenamed("source", "_source").join(
            at, F.col("_source").eqNullSafe(F.col("source")))
        # The last bucket that starts at or below the budget holds the boundary.
        edge = joined.filter(F.col("below") <= F.col("rest")).groupBy("source", "whole", "prefix").agg(
            F.max(F.struct("digit", "below", "size", "rest")).alias("m"))
        at = stable(edge.select("source", "whole", F.concat("prefix", "m.digit").alias("prefix"),
                                (F.col("m.rest") - F.col("m.below")).alias("rest"), F.col("m.size").alias("last")),
                    "thresholds")
    # The boundary is now one hash value; its documents are taken if that comes nearer to the budget.
    takes = (F.col("rest") > 0) & (F.col("rest") * 2 >= F.col("last"))
    return at.select("source", "whole", F.col("prefix").alias("threshold"), takes.alias("takes"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, key, source_size, target, copies, taken.

    ``size`` counts words (runs of other than white space), 0 for a null text; ``copies`` says how often the mix
    takes the document, ``taken`` is size times copies.  A null source is a source of its own, last in order.
    Repeated rows have equal hashes, so they are taken or left together.  A source without words has target 0 and
    takes nothing; an empty table gives no rows.  Sources, not documents, are what must fit one task.
    """
    key = F.lower(F.lpad(F.hex(F.xxhash64("doc_id", "text")), 16, "0"))
    rows = stable(docs.select("doc_id", "source", size_of(text_of()).alias("size"), key.alias("key")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = stable(targets(sizes, weights, limit), "targets")
    cut = thresholds(rows.select("source", "size", "key"), budgets)
    cut = cut.withColumnRenamed("source", "_cut_source")
    per_source = stable(budgets.join(cut, F.col("source").eqNullSafe(F.col("_cut_source")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"),
        F.coalesce("threshold", F.lit("")).alias("threshold"), F.coalesce("takes", F.lit(False)).alias("takes")),
        "per-source")
    more = (F.col("key") < F.col("threshold")) | ((F.col("key") == F.col("threshold")) & F.col("takes"))
    copies = F.least(F.col("whole") + more.cast("long"), F.lit(limit).cast("long"))
    return rows.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "key", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``docs`` as the mix takes them: rows that it leaves go, rows that it takes more than once are repeated."""
    taken = mix(docs, weights, limit).filter("copies > 0").select(
        F.col("key").alias("_key"), F.col("source").alias("_source"), F.col("copies").alias("_copies"))
    taken = stable(taken.distinct(), "taken")  # equal keys of one source have equal copies
    key = F.lower(F.lpad(F.hex(F.xxhash64("doc_id", "text")), 16, "0"))
    joined = docs.join(taken, (key == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
