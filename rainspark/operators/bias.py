"""Station bias factors and their joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rainspark.sources.inventory import first_row_per

RATIO_RANGE = (0.25, 5.0)
RAIN_RANGE = (1.0, 350.0)
PLOT_RATIO_RANGE = (0.1, 10.0)


def pair_qc(
    pairs: DataFrame, rain: tuple[float, float] = RAIN_RANGE,
    ratio: tuple[float, float] = RATIO_RANGE,
) -> DataFrame:
    """Inclusive bounds on both rains and on their ratio."""
    return pairs.filter(
        F.col("pr_g").between(*rain) & F.col("pr_p").between(*rain) & F.col("ratio").between(*ratio)
    )


def plot_qc(
    pairs: DataFrame, min_mm: float = 1.0, ratio: tuple[float, float] = PLOT_RATIO_RANGE
) -> DataFrame:
    """The looser filter shared by all diagnostics."""
    return pairs.filter(
        (F.col("pr_g") >= min_mm) & (F.col("pr_p") >= min_mm) & F.col("ratio").between(*ratio)
    )


def origin_slope(x: Column, y: Column) -> Column:
    """Least-squares slope through the origin as an aggregate; NULL without spread."""
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))


def zeta(
    pairs: DataFrame, method: str = "mean", min_samples: int = 10,
    rain: tuple[float, float] = RAIN_RANGE, ratio: tuple[float, float] = RATIO_RANGE,
) -> DataFrame:
    """Bias factor per product and station with the spread of its ratios.

    The exact percentiles act on the events of one station and product: declustered exceedances,
    at most eight a year, so each group is small by construction.
    """
    r = F.col("ratio")
    estimators = {
        "mean": F.avg(r),
        "median": F.percentile(r, F.lit(0.5)),
        "slope0": origin_slope(F.col("pr_p"), F.col("pr_g")),
    }
    if method not in estimators:
        raise ValueError(f"unknown zeta method {method!r}; one of {sorted(estimators)}")
    spread = F.percentile(r, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    return (
        pair_qc(pairs, rain, ratio)
        .groupBy("product", "station_id")
        .agg(
            estimators[method].alias("zeta"),
            F.count("*").alias("n_pairs"),
            F.avg(r).alias("ratio_mean"),
            spread.alias("q"),
        )
        .filter(F.col("n_pairs") >= min_samples)
        .select(
            "product", "station_id", "zeta", "n_pairs",
            F.col("q")[0].alias("ratio_median"), "ratio_mean",
            F.col("q")[1].alias("ratio_p10"), F.col("q")[2].alias("ratio_p90"),
        )
    )


def with_coordinates(
    zetas: DataFrame, stations: DataFrame, order: Sequence[str] = ("lat", "lon")
) -> DataFrame:
    """Adds lat/lon of a station's first row by `order`; stations without metadata keep NULL."""
    meta = first_row_per(
        stations.dropna(subset=["code", "lat", "lon"]), ["code"], order
    ).select(F.col("code").alias("station_id"), "lat", "lon")
    return zetas.join(meta, "station_id", "left")


def with_zeta(pairs: DataFrame, zetas: DataFrame) -> DataFrame:
    """Pairs of the stations that have a factor, with it and the corrected product rain."""
    factor = zetas.filter(F.col("zeta").isNotNull()).select("product", "station_id", "zeta")
    return pairs.join(factor, ["product", "station_id"]).withColumn(
        "pr_cor", F.col("pr_p") * F.col("zeta")
    )


def interpolation_points(
    zetas: DataFrame, min_pairs: int = 10, clip: tuple[float, float] = (0.05, 10.0)
) -> DataFrame:
    """Usable points for interpolation: enough pairs, finite, plausible."""
    good = F.col("zeta").between(*clip) & ~F.isnan("zeta")
    if "n_pairs" in zetas.columns:
        good = good & (F.coalesce("n_pairs", F.lit(0)) >= min_pairs)
    return zetas.dropna(subset=["zeta", "lat", "lon"]).filter(good)
