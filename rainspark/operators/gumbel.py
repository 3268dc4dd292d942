"""Cell statistics over years, Gumbel goodness of fit and design quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rainspark.functions.idf import gumbel_quantile
from rainspark.functions.series import gumbel_ks_distance, ks_p_value
from rainspark.grid import RETURN_PERIODS

MIN_YEARS = 5


def grid_annual_max(
    product_daily: DataFrame, keys: Sequence[str] = ("product",), value: str = "pr_p"
) -> DataFrame:
    """(keys, row, col, year, mm) from daily cells, tagged with the statistic they hold."""
    return (
        product_daily.groupBy(*keys, "row", "col", F.year("date").alias("year"))
        .agg(F.max(value).alias("mm"))
        .withColumn("stat", F.lit("annual_max"))
    )


def mean_annual_total(
    product_daily: DataFrame, keys: Sequence[str] = ("product",), value: str = "pr_p"
) -> DataFrame:
    """Yearly sums per cell, averaged over the years."""
    return (
        product_daily.groupBy(*keys, "row", "col", F.year("date").alias("year"))
        .agg(F.sum(value).alias("total"))
        .groupBy(*keys, "row", "col").agg(F.avg("total").alias("mean_ann"), F.count("*").alias("n_years"))
    )


def cell_stats(amax: DataFrame, keys: Sequence[str], min_years: int = MIN_YEARS) -> DataFrame:
    """(keys, AMD_mean, AMD_std, Nyears); mean and std are NULL with fewer years than needed."""
    enough = F.col("Nyears") >= min_years
    return (
        amax.groupBy(*keys)
        .agg(
            F.avg("mm").alias("AMD_mean"), F.stddev_samp("mm").alias("AMD_std"),
            F.count("mm").alias("Nyears"),
        )
        .withColumn("AMD_mean", F.when(enough, F.col("AMD_mean")))
        .withColumn("AMD_std", F.when(enough, F.col("AMD_std")))
    )


def gumbel_ks(
    amax: DataFrame, keys: Sequence[str], min_years: int = MIN_YEARS, alpha: float = 0.05
) -> DataFrame:
    """`cell_stats` with KS_D, KS_p and the 0/1 flag KS_reject (0 when there is no p).

    One shuffle: the years of a cell (some tens) are gathered with its moments and the distance is
    taken on the sorted array. The Gumbel parameters come from the same sample, so p is lenient.
    """
    gathered = amax.filter(F.col("mm").isNotNull()).groupBy(*keys).agg(
        F.avg("mm").alias("AMD_mean"), F.stddev_samp("mm").alias("AMD_std"),
        F.count("mm").alias("Nyears"), F.sort_array(F.collect_list("mm")).alias("_x"),
    )
    distance = gumbel_ks_distance(F.col("_x"), F.col("AMD_mean"), F.col("AMD_std"), F.col("Nyears"))
    enough = F.col("Nyears") >= min_years
    return (
        gathered.withColumn("KS_D", F.when(enough, distance))
        .withColumn("KS_p", ks_p_value(F.col("KS_D"), F.col("Nyears")))
        .withColumn("KS_reject", F.when(F.col("KS_p") < alpha, 1).otherwise(0))
        .withColumn("AMD_mean", F.when(enough, F.col("AMD_mean")))
        .withColumn("AMD_std", F.when(enough, F.col("AMD_std")))
        .drop("_x")
    )


def gumbel_quantiles(
    stats: DataFrame, keys: Sequence[str], periods: Sequence[float] = RETURN_PERIODS
) -> DataFrame:
    """(keys, T, Q): one row per cell and return period."""
    items = F.array(*[
        F.struct(
            F.lit(float(t)).alias("T"),
            gumbel_quantile(F.col("AMD_mean"), F.col("AMD_std"), t).alias("Q"),
        )
        for t in periods
    ])
    return (
        stats.select(*keys, F.explode(items).alias("i"))
        .select(*keys, "i.T", "i.Q").filter(F.col("Q").isNotNull())
    )
