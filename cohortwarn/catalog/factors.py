"""Class statistics and class-relative factors."""

from pyspark.sql import functions as F

from cohortwarn.catalog.registry import factor_sql, r6, register, rounded
from cohortwarn.operators import factors as op
from cohortwarn.operators.ranks import quantiles
from cohortwarn.plans.tables import FACTORS
from cohortwarn.sources import cohort_tables, load


@register("select id, round(avg(page_views) over (partition by course), 6) as class_mean from activity", cohort=True)
def class_mean(spark, path):
    rows = op.group_stat(cohort_tables(spark, path).activity, ["course"], {"class_mean": "page_views"}, "mean")
    return rounded(rows.select("id", "class_mean"), "class_mean")


@register("select id, round(median(page_views) over (partition by course), 6) as class_median from activity", cohort=True)
def class_median(spark, path):
    rows = op.group_stat(cohort_tables(spark, path).activity, ["course"], {"class_median": "page_views"}, "median")
    return rounded(rows.select("id", "class_median"), "class_median")


@register("""select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) as median_price
          from lineitem group by l_returnflag""")
def exact_median_of_doubles(spark, path):
    out = quantiles(load(spark, path, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5])
    return rounded(out.select("l_returnflag", F.col("value").alias("median_price")), "median_price")


@register(f"select id, {r6('page_view_factor')} from {factor_sql('activity', 'mean')}", cohort=True)
def relative_factor(spark, path):
    rows = op.relative_factors(
        cohort_tables(spark, path).activity, ["course"], {"page_view_factor": "page_views"}, "mean")
    return rounded(rows.select("id", "page_view_factor"), "page_view_factor")


@register(f"select id, {r6(*FACTORS)} from {factor_sql('activity')}", cohort=True)
def engagement_factors(spark, path):
    rows = op.engagement_factors(cohort_tables(spark, path).activity)
    return rounded(rows.select("id", *FACTORS), *FACTORS)


@register(f"select id, {r6(*op.TARDINESS_FACTORS)} from {factor_sql('activity', 'mean')}", cohort=True)
def tardiness_factors_mean(spark, path):
    rows = op.tardiness_factors(cohort_tables(spark, path).activity, stat="mean")
    return rounded(rows.select("id", *op.TARDINESS_FACTORS), *op.TARDINESS_FACTORS)


@register(f"select id, {r6(*op.TARDINESS_FACTORS)} from {factor_sql('activity')}", cohort=True)
def tardiness_factors_median(spark, path):
    rows = op.tardiness_factors(cohort_tables(spark, path).activity)
    return rounded(rows.select("id", *op.TARDINESS_FACTORS), *op.TARDINESS_FACTORS)
