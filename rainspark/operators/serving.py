"""Batch answers for points of interest from fitted parameter tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rainspark.functions.idf import sherman_intensity
from rainspark.grid import CURVE_DURATIONS_MIN, CURVE_RETURN_PERIODS, DESIGN_POINTS, Grid
from rainspark.operators.polygons import first_polygon, place_label
from rainspark.operators.raster import sample_raster

COMBO = ("product", "bias", "disagg")
SAMPLED = ("K", "a", "b", "c", "MSE", "RMSE", "R2")


def in_countries(areas: DataFrame, names: Sequence[str], column: str = "adm0") -> DataFrame:
    return areas.filter(F.col(column).isin(*names))


def sample_points(
    points: DataFrame, params: DataFrame, grid: Grid, areas: DataFrame, elevation: DataFrame,
    tile: float = 1.0, bands: Sequence[str] = SAMPLED,
) -> DataFrame:
    """Points with place names, elevation, and the bands of each parameter combination.

    `areas`: polygons with adm2, adm1, adm0. `missing` is true when K, a, b or c is absent.
    """
    placed = first_polygon(points, areas, ["adm2", "adm1", "adm0"], tile=tile)
    short, full = place_label(F.col("adm2"), F.col("adm1"), F.col("adm0"))
    labelled = placed.select(*points.columns, short, full)
    high = sample_raster(labelled, elevation, grid, ["elev_m"]).drop("row", "col")
    sampled = sample_raster(high, params, grid, bands, COMBO).drop("row", "col")
    lacking = [F.col(c).isNull() for c in ("K", "a", "b", "c")]
    return sampled.withColumn("missing", lacking[0] | lacking[1] | lacking[2] | lacking[3])


def idf_rows(
    sampled: DataFrame, keys: Sequence[str],
    durations: Sequence[int] = CURVE_DURATIONS_MIN, periods: Sequence[int] = CURVE_RETURN_PERIODS,
) -> DataFrame:
    """(keys, duration_min, T, intensity) for rows that have parameters."""
    items = F.array(*[
        F.struct(F.lit(d).alias("duration_min"), F.lit(t).alias("T")) for d in durations for t in periods
    ])
    return (
        sampled.dropna(subset=["K", "a", "b", "c"])
        .withColumn("i", F.explode(items))
        .select(
            *keys, "i.duration_min", "i.T",
            sherman_intensity(
                F.col("K"), F.col("a"), F.col("b"), F.col("c"), F.col("i.duration_min"), F.col("i.T")
            ).alias("intensity"),
        )
    )


def idf_curve(
    sampled: DataFrame, keys: Sequence[str],
    durations: Sequence[int] = CURVE_DURATIONS_MIN, periods: Sequence[int] = CURVE_RETURN_PERIODS,
) -> DataFrame:
    """One row per key and duration, one column rp_<T> per return period (no shuffle)."""
    cell = {
        f"rp_{t}": sherman_intensity(
            F.col("K"), F.col("a"), F.col("b"), F.col("c"), F.col("duration_min"), F.lit(t)
        )
        for t in periods
    }
    return (
        sampled.dropna(subset=["K", "a", "b", "c"])
        .withColumn("duration_min", F.explode(F.array(*[F.lit(d) for d in durations])))
        .select(*keys, "duration_min", *[v.alias(k) for k, v in cell.items()])
    )


def compare_design(
    sampled: DataFrame, keys: Sequence[str], products: Sequence[str],
    design: Sequence[tuple[int, int]] = DESIGN_POINTS,
) -> DataFrame:
    """(keys, T, duration_min, bias, disagg, one column per product): intensities at design points."""
    items = F.array(*[
        F.struct(F.lit(t).alias("T"), F.lit(d).alias("duration_min")) for t, d in design
    ])
    rows = sampled.withColumn("i", F.explode(items)).select(
        *keys, "product", "bias", "disagg", "i.T", "i.duration_min",
        sherman_intensity(
            F.col("K"), F.col("a"), F.col("b"), F.col("c"), F.col("i.duration_min"), F.col("i.T")
        ).alias("intensity"),
    )
    return rows.groupBy(*keys, "T", "duration_min", "bias", "disagg").pivot(
        "product", list(products)
    ).agg(F.first("intensity"))
