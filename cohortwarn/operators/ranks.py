"""Exact ranks, cuts and quantiles without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwarn.functions import hash_hex, hash_unit
from cohortwarn.session import stable

# Hex digits of the hash that name a bucket: 16**4 = 65,536 buckets, so bucket
# tables stay small and a bucket of a 10-billion-row table has ~150,000 rows.
_BUCKET_DIGITS = 4


def _hashed(df: DataFrame, key: Sequence[str], seed: int | str) -> DataFrame:
    h = hash_hex(seed, *[F.col(k) for k in key])
    return df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, _BUCKET_DIGITS))


def hash_rank(
    df: DataFrame, key: Sequence[str], seed: int | str, by: Sequence[str] = (), name: str = "hash_rank"
) -> DataFrame:
    """0-based rank of each row in hash order, overall or within ``by``.

    Equal to ``row_number() over (partition by <by> order by md5, key) - 1``, but
    no task sees more than one hash bucket: ranks inside a bucket are shifted by
    the number of rows in earlier buckets.
    """
    by = list(by)
    rows = _hashed(df, key, seed)
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in by],
        F.col("_b").alias("_o_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *key)
    ranked = rows.withColumn("_rn", F.row_number().over(inside))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by], F.col("_b") == F.col("_o_b"))
    if not by:
        offsets = F.broadcast(offsets)  # at most 16 ** _BUCKET_DIGITS rows
    return ranked.join(offsets, on).select(
        *df.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name)
    )


def mark_split(
    df: DataFrame,
    key: Sequence[str],
    train: float | None = None,
    test: float | None = None,
    seed: int | str = 42,
    name: str = "is_train",
) -> DataFrame:
    """Exact-fraction split as a 0/1 column, by hash order of the key.

    Sizes follow the usual rule: floor(n * train) training rows, or
    ceil(n * test) test rows.  The cut is one hash value found from bucket
    counts; rows are then compared with it in place, so the table is not
    shuffled.  Rows sharing a key stay on one side.
    """
    if (train is None) == (test is None):
        raise ValueError("give either train or test")
    rows = _hashed(df, key, seed)
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    size = F.floor(total * F.lit(train)) if train is not None else total - F.ceil(total * F.lit(test))
    buckets = counts.select("_b", "_n", F.sum("_n").over(upto).alias("_upto"), size.alias("_size"))
    holds_cut = (F.col("_upto") >= F.col("_size")) & (F.col("_upto") - F.col("_n") < F.col("_size"))
    need = F.col("_size") - F.col("_upto") + F.col("_n")
    edge = buckets.filter(holds_cut).select(F.struct("_b", need.alias("need"))).scalar()
    point = F.struct("_h", *key)
    # One bucket of rows, repeated keys already counted together.
    in_edge = rows.filter(F.col("_b") == edge["_b"]).groupBy("_b", "_h", *key).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("_b").orderBy("_h", *key).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        in_edge.withColumn("_run", F.sum("_n").over(running))
        .filter(F.col("_run") <= edge["need"])
        .agg(F.max(point))
        .scalar()
    )
    # If the first key of the bucket already overshoots (repeated keys) there is
    # no cut point, and the training part ends before the bucket.
    is_train = F.coalesce(point <= cut, F.col("_b") < edge["_b"], F.lit(False))
    return rows.withColumn(name, is_train.cast("int")).drop("_h", "_b")


def split(
    df: DataFrame,
    key: Sequence[str],
    train: float | None = None,
    test: float | None = None,
    seed: int | str = 42,
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, see :func:`mark_split`."""
    marked = mark_split(df, key, train, test, seed, "_train")
    return tuple(marked.filter(F.col("_train") == v).drop("_train") for v in (1, 0))


def threshold_split(df: DataFrame, key: Sequence[str], train: float, seed: int | str = 42):
    """One-pass split: each row decides by its own hash, sizes hold on average."""
    u = hash_unit(seed, *[F.col(k) for k in key])
    return df.filter(u < F.lit(train)), df.filter(u >= F.lit(train))


def assign_folds(
    df: DataFrame, key: Sequence[str], label: str, folds: int, seed: int | str = 42, name: str = "fold"
) -> DataFrame:
    """Stratified fold number: rank within the label in hash order, modulo ``folds``."""
    ranked = hash_rank(df, key, seed, [label], "_rank")
    return ranked.withColumn(name, (F.col("_rank") % folds).cast("int")).drop("_rank")


def _ordered_bits(v: Column) -> Column:
    """A double as a whole number of 64 bits in the same order; adding 0.0 makes both zeros one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def quantiles_of(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per group and column: ``by``, ``variable``, ``prob``, ``value``.

    Nulls and NaN do not count; rows with a null group key are left out.

    The values are selected by radix: their order-preserving 64-bit forms are counted by the highest 16 bits, which
    tells the bucket that holds each wanted position; only values of these buckets are counted by the next bits, and so on.  A
    bucket whose smallest and largest value are the same is an answer, so small whole numbers take one or two passes
    and any values four.  Every pass is a count that combines before the shuffle; a group has at most 65,536 counts,
    whatever its rows and values, and no rows of a group ever meet in one task.  The passes run when this is called.
    """
    by = list(by)
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
    rows = df.na.drop("any", subset=by) if by else df
    rows = rows.select(*by, F.inline(values)).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_k", _ordered_bits(F.col("_v")))
    group, found, pending = [*by, "_c"], [], None
    for shift in (48, 32, 16, 0):
        counted = rows.withColumn("_d", F.shiftright("_k", shift))
        if pending is not None:
            counted = counted.withColumn("_p", F.shiftright("_k", shift + 16)).join(pending.drop("_want"), [*group, "_p"])
        place = group if pending is None else [*group, "_p"]
        counts = counted.groupBy(*place, "_d").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*place).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
        if pending is None:
            at = [F.lit(float(p)) * (F.sum("_n").over(Window.partitionBy(*place)) - 1) for p in probs]
            wanted = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), x.alias("_at"), f(x).alias("_r"))
                               for i, x in enumerate(at) for j, f in enumerate((F.floor, F.ceil))])
            counts = counts.withColumn("_want", wanted)
        else:
            counts = counts.join(pending, place)
        here = F.filter("_want", lambda w: (w["_r"] >= F.col("_before")) & (w["_r"] < F.col("_upto")))
        hits = stable(counts.select(*group, "_d", "_before", "_lo", "_hi", F.inline(here)), "quantiles")
        found.append(hits.filter(F.col("_lo") == F.col("_hi")))
        open_ = hits.filter(F.col("_lo") < F.col("_hi"))
        if open_.isEmpty():
            break
        rest = F.struct("_i", "_j", "_at", (F.col("_r") - F.col("_before")).alias("_r"))
        # Two positions of each probability at most.
        pending = open_.groupBy(*group, F.col("_d").alias("_p")).agg(F.collect_list(rest).alias("_want"))
    every = reduce(DataFrame.unionByName, found)
    ends = every.groupBy(*group, "_i", "_at").agg(*[
        F.max(F.when(F.col("_j") == j, F.col("_lo"))).alias(name) for j, name in enumerate(("_a", "_b"))])
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    names, shares = (F.array(*map(F.lit, x)) for x in (cols, map(float, probs)))
    out = ends.select(*by, F.element_at(names, F.col("_c") + 1).alias("variable"),
                      F.element_at(shares, F.col("_i") + 1).alias("prob"), value.alias("value"))
    return out if len(found) == 1 else stable(out, "quantiles")


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of one column per group: columns ``by``, ``prob``, ``value``."""
    return quantiles_of(df, by, [col], probs).drop("variable")
