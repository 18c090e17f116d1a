"""Counts, coverage, attrition and distributions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortwarn.functions import ratio
from cohortwarn.operators.clean import TASK_EXCLUDES, complete, drop_missing, drop_strict, is_missing, not_in, relabel
from cohortwarn.operators.dedup import first_per_key
from cohortwarn.operators.factors import engagement_factors
from cohortwarn.operators.ranks import quantiles
from cohortwarn.sources.dictionary import VARIABLE_LABELS
from cohortwarn.session import stable
from cohortwarn.sources.tables import read_cohort, read_snapshot

#: Pairs of columns whose moments are summed in one row of a correlation.
PAIRS_PER_BLOCK = 8


def fail_counts(
    grades: DataFrame,
    course: str = "course",
    grade: str = "grade",
    student: str = "student_id",
    fail: str = "F",
    min_n: int | None = None,
    name: str = "n_students",
) -> DataFrame:
    """Failing students per course, most first; ``min_n`` keeps larger groups only."""
    out = grades.filter(F.col(grade) == fail).groupBy(course).agg(F.count(student).alias(name))
    if min_n is not None:
        out = out.filter(F.col(name) >= min_n)
    return out.orderBy(F.desc(name), course)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def group_means(df: DataFrame, by: Sequence[str], exclude: Iterable[str] = ()) -> DataFrame:
    cols = numeric_columns(df, [*by, *exclude])
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def column_coverage(df: DataFrame, table: str, exclude: Iterable[str] = ("id", "student_id")) -> DataFrame:
    """Non-missing values per column, one row per column, from one aggregation."""
    cols = [c for c in df.columns if c not in set(exclude)]
    counts = df.agg(*[F.count(F.when(~is_missing(df, c), 1)).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("n")) for c in cols])
    return counts.select(F.inline(pairs), F.lit(table).alias("table_name"))


def relabel_coverage(report: DataFrame) -> DataFrame:
    return relabel(report, "variable", VARIABLE_LABELS)


def append_tables(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` does not have, sorted."""
    return a.subtract(b).orderBy(*a.columns)


def label_counts(df: DataFrame, label: str, name: str = "n") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias(name))


def crosstab(
    df: DataFrame,
    rows: str,
    cols: str,
    values: Sequence[object],
    names: Sequence[str] | None = None,
    other: str | None = None,
) -> DataFrame:
    """Counts of ``rows`` against the listed ``cols`` values, zero filled, in one aggregation.

    Values that are not listed (missing ones too) are counted in the column ``other``; without one they are an error.
    """
    names = list(names or [str(v) for v in values])
    unlisted = ~F.coalesce(F.col(cols).isin(*values), F.lit(False))
    counts = df.groupBy(rows).agg(
        *[F.count_if(F.col(cols) == v).alias(n) for v, n in zip(values, names, strict=True)],
        F.count_if(unlisted).alias(other or "_other"))
    if other:
        return counts
    error = F.raise_error(F.lit(f"{cols} has values other than {list(values)}")).cast("long")
    return counts.select(rows, *[F.when(F.col("_other") > 0, error).otherwise(F.col(f"`{n}`")).alias(n) for n in names])


def attrition_counts(
    grades: DataFrame,
    absence: DataFrame,
    diagnostics: DataFrame,
    activity: DataFrame,
    student: str = "student_id",
    grade: str = "grade",
) -> DataFrame:
    """Rows left after each added source, one row per stage.

    ``grades`` and ``absence`` hold one row per student and ``diagnostics`` and
    ``activity`` complete rows only.  The second stage counts complete rows but
    later stages continue from the incomplete ones too.  All eight counts come
    from one pass: activity is counted per student first, so several snapshots
    of one student multiply a count, never rows.
    """
    g = grades.select(student, grade, complete(grades).alias("_g_ok"))
    a = absence.select(student, F.struct(complete(absence).alias("ok")).alias("_a"))
    d = diagnostics.groupBy(student).agg(F.count(F.lit(1)).alias("_nd"))
    c = activity.groupBy(student).agg(F.count(F.lit(1)).alias("_nc"))
    wide = g.join(a, student, "left").join(d, student, "left").join(c, student, "left")
    base = F.col("_a").isNotNull()
    full = base & F.col("_g_ok") & F.col("_a.ok")
    n_diag = F.when(base, F.coalesce("_nd", F.lit(0))).otherwise(0)
    n_act = n_diag * F.coalesce("_nc", F.lit(0))
    tasks = [(" P-F", TASK_EXCLUDES["PF"]), (" E-F", TASK_EXCLUDES["EF"])]
    stages = [("Grades", F.lit(1)), ("Absence", full.cast("int"))]
    for name, n in (("Diagnostics", n_diag), ("Activity", n_act)):
        stages.append((name, n))
        stages += [
            (name + label, F.when(full & not_in(F.col(grade), drop), n).otherwise(0)) for label, drop in tasks
        ]
    sums = wide.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"s{i}") for i, (_, n) in enumerate(stages)])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("n"))
        for i, (name, _) in enumerate(stages)
    ])
    return sums.select(F.inline(rows))


def retention(funnel: DataFrame, scale: float = 0.2) -> DataFrame:
    """Share of the first stage, times a display scale; the funnel has a handful of rows."""
    first = F.first("n").over(Window.orderBy("stage_no"))
    return funnel.withColumn("retention", ratio(F.col("n"), first) * F.lit(scale))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations, each pair over the rows complete for that pair.

    Rows ``a, b, r, n`` for every ordered pair.  Each row is stacked into blocks
    of ``PAIRS_PER_BLOCK`` pairs of columns, whose moments are summed up map-side
    side by side, so a row is copied once for each block and only one line per
    block and task is shuffled.  (All pairs in one aggregate outgrow code
    generation.)  A constant column has no correlation (null), also with itself.
    """
    cols = list(cols or numeric_columns(df))
    values = [F.when(~is_missing(df, c), F.col(f"`{c}`").cast("double")) for c in cols]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    width = min(PAIRS_PER_BLOCK, len(pairs))
    none = F.lit(None).cast("double")
    cells = []
    for start in range(0, len(pairs), width):
        block = pairs[start : start + width]
        complete = [(F.when(values[j].isNotNull(), values[i]), F.when(values[i].isNotNull(), values[j])) for i, j in block]
        complete += [(none, none)] * (width - len(block))
        cells += [F.lit(start // width), *[v for pair in complete for v in pair]]
    slots = [(f"_x{s}", f"_y{s}") for s in range(width)]
    stacked = df.select(F.stack(F.lit(-(-len(pairs) // width)), *cells).alias("_block", *[n for pair in slots for n in pair]))
    sums = stacked.groupBy("_block").agg(*[a for s, (x, y) in enumerate(slots) for a in (
        F.covar_pop(x, y).alias(f"_c{s}"), F.var_pop(x).alias(f"_vx{s}"), F.var_pop(y).alias(f"_vy{s}"),
        F.count(x).alias(f"_n{s}"))])
    moments = sums.select("_block", F.inline(F.array(*[
        F.struct(F.lit(s).alias("_slot"), F.col(f"_c{s}").alias("_c"), F.col(f"_vx{s}").alias("_vx"),
                 F.col(f"_vy{s}").alias("_vy"), F.col(f"_n{s}").alias("n")) for s in range(width)])))
    # Every ordered pair of names, so that a pair without complete rows is listed too.
    place = {pair: divmod(at, width) for at, pair in enumerate(pairs)}
    wanted = [(a, b, *place[min(i, j), max(i, j)]) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    names = df.sparkSession.createDataFrame(wanted, "a string, b string, _block int, _slot int")
    r = ratio(F.col("_c"), F.sqrt("_vx") * F.sqrt("_vy"))
    return names.join(moments, ["_block", "_slot"], "left").select(
        "a", "b", r.alias("r"), F.coalesce("n", F.lit(0)).alias("n"))


def describe_by(df: DataFrame, by: str, col: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles per class.

    The two columns are kept as a table, since every pass of the quartiles reads them.
    """
    rows = df.select(by, F.when(~is_missing(df, col), F.col(col)).alias(col)).filter(F.col(by).isNotNull())
    rows = stable(rows, "described")
    v = F.col(col)
    base = rows.groupBy(by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    q = quantiles(rows, [by], col, [0.25, 0.5, 0.75])
    wide = q.groupBy(by).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
        for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    ])
    return base.join(wide, by, "left").select(by, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin."""
    at = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return F.when(v.isNotNull(), at)  # least() alone would skip the null


def _edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A constant column is put in a range one wide around it."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def _long(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    values = F.array(*[
        F.struct(F.lit(c).alias("variable"),
                 F.when(~is_missing(df, c), F.col(f"`{c}`").cast("double")).alias("v"))
        for c in cols
    ])
    return df.select(by, F.inline(values)).filter(F.col("v").isNotNull())


def histogram_by(df: DataFrame, by: str, cols: Sequence[str], bins: int = 50, shared: bool = False) -> DataFrame:
    """Equal-width histograms per variable and class.

    Each class has its own range, or all classes of a variable share one with
    ``shared``.  Only bins with rows are listed.  The ranges are found when this is
    called and kept as a table: Spark then knows its size and sends it to the rows,
    which else would meet by variable and class, in a few tasks.
    """
    long = _long(df, by, cols).filter(F.col(by).isNotNull())
    group = ["variable"] if shared else ["variable", by]
    lo, hi = _edges(F.min("v"), F.max("v"))
    ranges = stable(long.groupBy(*group).agg(lo.alias("lo"), hi.alias("hi")), "ranges")
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        long.join(ranges, group)
        .groupBy("variable", by, _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("variable", by, "bin", (F.col("lo") + width * F.col("bin")).alias("bin_start"),
                (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"), "n")
    )


def pair_bins(df: DataFrame, by: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Joint distribution of every pair of columns by class, as 2-D bin counts.

    Ranges come from one aggregation and reach the rows as a one-row subquery.
    """
    ok = {c: F.when(~is_missing(df, c), F.col(f"`{c}`").cast("double")) for c in cols}
    edges = []
    for c in cols:
        edges += [e.alias(f"{k}_{c}") for k, e in zip(("lo", "hi"), _edges(F.min(ok[c]), F.max(ok[c])), strict=True)]
    ranges = df.agg(*edges).select(F.struct("*").alias("r")).scalar()
    binned = df.select(by, ranges.alias("_r"), *[ok[c].alias(c) for c in cols]).select(
        by, *[_bin(F.col(f"`{c}`"), F.col(f"_r.`lo_{c}`"), F.col(f"_r.`hi_{c}`"), bins).alias(c) for c in cols]
    )
    pairs = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("bin_a"), F.col(f"`{b}`").alias("bin_b"))
        for a, b in combinations(cols, 2)
    ])
    return (
        binned.select(by, F.inline(pairs))
        .filter(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
        .groupBy("a", "b", by, "bin_a", "bin_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_k(df: DataFrame, score: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)


def attrition_funnel(
    tables,
    course: str,
    prefix: str,
    month_day: str,
    absence_order: Sequence[str | Column],
    stat: str = "median",
    diagnostics_drop: Sequence[str] = (),
    diagnostics_order: Sequence[str | Column] | None = None,
    exact: bool = False,
) -> DataFrame:
    """The cohort funnel of one course and snapshot day over ``tables``.

    Give ``diagnostics_order`` where a student can have several diagnostic rows.
    """
    key = ["student_id"]
    grades = first_per_key(read_cohort(tables.grades, course, exact=exact), key, ["id"])
    absence = first_per_key(read_cohort(tables.absence, course, exact=exact), key, absence_order)
    diagnostics = tables.diagnostics
    if diagnostics_order is not None:
        diagnostics = first_per_key(diagnostics, key, diagnostics_order)
    diagnostics = drop_missing(drop_strict(diagnostics, diagnostics_drop))
    activity = engagement_factors(read_snapshot(tables.activity, prefix, month_day, exact=exact), stat=stat)
    return attrition_counts(grades, absence, diagnostics, drop_missing(activity))


__all__ = [
    "append_tables", "attrition_counts", "attrition_funnel", "column_coverage", "corr_matrix",
    "crosstab", "describe_by", "except_distinct", "fail_counts", "group_means", "histogram_by",
    "label_counts", "numeric_columns", "pair_bins", "relabel_coverage", "retention", "top_k",
]
