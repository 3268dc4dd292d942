"""Exceedance days, declustering and gauge/product event pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from rainspark.functions.numeric import clip_low, within_or_null
from rainspark.functions.series import decluster
from rainspark.grid import Grid
from rainspark.sources.inventory import first_row_per

QC_MAX_MM = 500.0


def gauge_qc(daily: DataFrame, max_mm: float | None = QC_MAX_MM, value: str = "pr_g") -> DataFrame:
    """Negative and implausibly large values become missing."""
    return daily.withColumn(value, within_or_null(F.col(value), 0.0, max_mm))


def non_negative(daily: DataFrame, value: str = "pr_g") -> DataFrame:
    return daily.withColumn(value, clip_low(F.col(value), 0.0))


def exceedances(
    daily: DataFrame, pct: float = 0.98, min_valid: int = 30, max_mm: float | None = QC_MAX_MM
) -> DataFrame:
    """Days strictly above their station-year percentile: (code, year, date, pr_g, threshold).

    A window holds the days of one station-year, at most 366, so the exact percentile is cheap
    whatever the number of stations or years.
    """
    w = W.partitionBy("code", "year")
    return (
        gauge_qc(daily, max_mm)
        .filter(F.col("pr_g").isNotNull())
        .withColumn("year", F.year("date"))
        .withColumn("n_valid", F.count("*").over(w))
        .withColumn("threshold", F.percentile("pr_g", F.lit(pct)).over(w))
        .filter((F.col("n_valid") >= min_valid) & (F.col("pr_g") > F.col("threshold")))
        .select("code", "year", "date", "pr_g", "threshold")
    )


def declustered(
    events: DataFrame, gap_days: int = 3, min_per_year: int = 1, min_mm: float = 1.0
) -> DataFrame:
    """Events `gap_days` or more after the last kept event of their station-year.

    Years with fewer than `min_per_year` kept events are dropped, then events of `min_mm` or less.
    """
    kept = events.groupBy("code", "year").agg(
        decluster(F.sort_array(F.collect_list(F.struct("date", "pr_g"))), gap_days).alias("kept")
    )
    return (
        kept.filter(F.size("kept") >= min_per_year)
        .select("code", "year", F.explode("kept").alias("e"))
        .select("code", "year", F.col("e.date").alias("date"), F.col("e.pr_g").alias("pr_g"))
        .filter(F.col("pr_g") > min_mm)
    )


def extremes(
    daily: DataFrame, pct: float = 0.98, min_valid: int = 30, gap_days: int = 3,
    min_per_year: int = 1, max_mm: float | None = QC_MAX_MM, min_mm: float = 1.0,
) -> DataFrame:
    """Threshold and declustering share one shuffle: both are keyed by (code, year)."""
    events = exceedances(daily, pct, min_valid, max_mm)
    return declustered(events, gap_days, min_per_year, min_mm)


def station_cells(stations: DataFrame, grid: Grid, order: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Stations with coordinates, one row per code, and the cell they lie in.

    `order` names the columns that say which of several rows of a code came first in the source.
    """
    located = stations.dropna(subset=["code", "lat", "lon"])
    unique = first_row_per(located, ["code"], order)
    row, col = grid.row_of(F.col("lat")), grid.col_of(F.col("lon"))
    return unique.withColumn("row", row).withColumn("col", col).filter(grid.inside(row, col))


def sample_product(
    events: DataFrame, product_daily: DataFrame, products: Sequence[str]
) -> DataFrame:
    """Rain of each of `products` at each event's cell and day; a missing image counts as 0.

    `events` carries (row, col, date); the product table is unique per (product, date, row, col).
    """
    spread = events.withColumn("product", F.explode(F.array(*[F.lit(p) for p in products])))
    keys = ["product", "date", "row", "col"]
    sampled = spread.join(product_daily.select(*keys, "pr_p"), keys, "left")
    return sampled.withColumn("pr_p", F.coalesce("pr_p", F.lit(0.0)))


def event_pairs(
    events: DataFrame, stations: DataFrame, product_daily: DataFrame, grid: Grid, min_mm: float = 1.0,
    order: Sequence[str] = ("lat", "lon"),
) -> DataFrame:
    """(product, station_id, lat, lon, date, pr_p, pr_g, ratio) with both rains above `min_mm`.

    A missing image would count as 0 mm and fail that bound, so an inner join says the same, and
    the bound reaches the scan of the product. Events are few, so they are reduced first; the
    product must be unique per (product, date, row, col).
    """
    cells = station_cells(stations, grid, order).select("code", "lat", "lon", "row", "col")
    wet = product_daily.filter(F.col("pr_p") > min_mm).select("product", "date", "row", "col", "pr_p")
    located = events.filter(F.col("pr_g") > min_mm).join(cells, "code")
    return located.join(wet, ["date", "row", "col"]).select(
        "product", F.col("code").alias("station_id"), "lat", "lon", "date", "pr_p", "pr_g",
        (F.col("pr_g") / F.col("pr_p")).alias("ratio"),
    )
