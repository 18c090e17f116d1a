"""Synthetic minority rows between nearest neighbours.

The random choices are hashes of (seed, key, copy number), and the number of
copies per row follows from its hash rank, so the same input gives the same rows
under any partitioning.  Give training rows only: neighbours of test rows leak.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwarn.functions import hash_unit
from cohortwarn.operators.neighbours import Placement, nearest_neighbours
from cohortwarn.operators.ranks import hash_rank
from cohortwarn.session import stable


def _class_sizes(df: DataFrame, label: str, minority: float) -> tuple[int, int]:
    """Minority size and the number of rows missing to a balance."""
    small, large = df.agg(F.count_if(F.col(label) == minority), F.count_if(F.col(label) != minority)).first()
    return small, max(0, large - small)


def _copies(df: DataFrame, need: int, base: int) -> DataFrame:
    """``need`` copies in all, spread evenly over ``base`` rows by rank; numbered from 1."""
    numbers = df.sparkSession.range(need).select(
        (F.col("id") % base).alias("_rank"), (F.floor(F.col("id") / base) + 1).cast("int").alias("syn_no"))
    return df.withColumn("_rank", F.col("_rank").cast("long")).join(numbers, "_rank")


def _between(name: str, at: int, towards: Column, u: Column) -> Column:
    x = F.col(name).cast("double")
    return (x + u * (towards["vec"][at] - x)).alias(name)


def _pick(near: str, seed: int, key: str) -> Column:
    """One of the listed neighbours."""
    at = F.floor(hash_unit(f"{seed}n", F.col(key), F.col("syn_no")) * F.size(near)).cast("int")
    return F.col(near)[at]


def _with_originals(df, synthetic, key, features, label):
    kept = df.select(key, F.lit(0).alias("syn_no"), *[F.col(c).cast("double").alias(c) for c in features],
                     F.col(label).cast("double").alias(label))
    return kept.unionByName(synthetic)


def smote(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    minority: float = 0.0,
    k: int = 5,
    seed: int = 42,
    **search,
) -> DataFrame:
    """Balance two classes with points on segments between minority neighbours.

    Returns ``key, syn_no, features, label``: originals have ``syn_no`` 0 and a
    synthetic row carries the key of its base row, so (key, syn_no) is unique.
    ``search`` goes to the neighbour search.
    """
    rows = stable(df.select(key, *features, label))
    size, need = _class_sizes(rows, label, minority)
    if size <= k:
        raise ValueError(f"{size} minority rows are too few for {k} neighbours")
    base = stable(hash_rank(rows.filter(F.col(label) == minority), [key], seed, name="_rank"))
    near = nearest_neighbours(base, base, key, features, k, **search)
    copies = _copies(near, need, size)
    u = hash_unit(f"{seed}u", F.col(key), F.col("syn_no"))
    synthetic = copies.withColumn("_to", _pick("neighbours", seed, key)).select(
        key, "syn_no", *[_between(c, i, F.col("_to"), u) for i, c in enumerate(features)],
        F.lit(float(minority)).alias(label))
    return _with_originals(rows, synthetic, key, features, label)


def danger_points(
    df: DataFrame, key: str, features: Sequence[str], label: str, minority: float = 0.0, m: int = 10, **search
) -> DataFrame:
    """Minority rows with the number of other-class rows among their ``m`` nearest of all rows.

    ``danger`` is 1 where at least half but not all of them are of the other class.
    """
    rows = stable(df.select(key, *features, label))
    near = nearest_neighbours(rows.filter(F.col(label) == minority), rows, key, features, m, tag=label, **search)
    return _danger(near, minority, m).drop("neighbours")


def _danger(near: DataFrame, minority: float, m: int) -> DataFrame:
    foreign = F.size(F.filter("neighbours", lambda e: e["tag"] != F.lit(float(minority))))
    return near.withColumn("n_majority", foreign).withColumn(
        "danger", ((F.col("n_majority") * 2 >= m) & (F.col("n_majority") < m)).cast("int"))


def borderline_smote2(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    minority: float = 0.0,
    k: int = 5,
    m: int = 10,
    seed: int = 42,
    **search,
) -> DataFrame:
    """Balance two classes from the minority rows near the class border.

    Odd copies move from a danger point towards a minority neighbour by a share
    in [0, 1), even copies towards a majority neighbour by a share in [0, 0.5).
    Without danger points nothing is added.  Output as in :func:`smote`.
    """
    rows = stable(df.select(key, *features, label))
    size, need = _class_sizes(rows, label, minority)
    if size <= k:
        raise ValueError(f"{size} minority rows are too few for {k} neighbours")
    # One placement and one search: the m nearest of all, and the k nearest of each class.
    sides = rows.withColumn("_other", (F.col(label) != minority).cast("double"))
    placement = Placement(sides, key, features, max(k, m), "_other", **search)
    near = placement.search(rows.filter(F.col(label) == minority), {
        "neighbours": (None, m), "near_small": (0.0, k), "near_large": (1.0, k)})
    marked = _danger(near, 0.0, m).filter(F.col("danger") == 1).drop("neighbours", "n_majority", "danger")
    border = stable(hash_rank(stable(marked), [key], seed, name="_rank"))
    n_border = border.count()
    if not n_border or not need:
        return _with_originals(rows, rows.limit(0).select(
            key, F.lit(0).alias("syn_no"), *[F.col(c).cast("double").alias(c) for c in features],
            F.col(label).cast("double").alias(label)), key, features, label)
    copies = _copies(border, need, n_border)
    own = F.col("syn_no") % 2 == 1
    target = F.when(own, _pick("near_small", seed, key)).otherwise(_pick("near_large", seed, key))
    u = hash_unit(f"{seed}u", F.col(key), F.col("syn_no")) * F.when(own, 1.0).otherwise(0.5)
    synthetic = copies.withColumn("_to", target).select(
        key, "syn_no", *[_between(c, i, F.col("_to"), u) for i, c in enumerate(features)],
        F.lit(float(minority)).alias(label))
    return _with_originals(rows, synthetic, key, features, label)
