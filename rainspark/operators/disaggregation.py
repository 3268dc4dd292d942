"""Sub-daily ratios depth(D)/depth(24 h) as one ordered array per cell, in three modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainspark.functions.series import cumulative_max, repair_monotone
from rainspark.grid import CETESB_FACTORS, DURATIONS_MIN
from rainspark.operators.neighbours import nearest_k
from rainspark.operators.quantiles import exact_quantiles
from rainspark.operators.raster import fill_nearest

STATION_COLUMNS = tuple(f"all_c{d}" for d in DURATIONS_MIN)


def cetesb_ratios(factors: Sequence[float] = CETESB_FACTORS, normalise: bool = True) -> list[float]:
    """The fixed factors over their last one, non-decreasing, at most 1 (twelve numbers)."""
    base = factors[-1] if normalise else 1.0
    out: list[float] = []
    for f in [*(f / base for f in factors[:-1]), 1.0]:
        out.append(min(1.0, max([f, *out[-1:]])))
    return out


def cetesb(spark: SparkSession) -> DataFrame:
    """One row, valid for every cell: (ratio).

    Made of literals, so that the optimizer knows how small it is.
    """
    return spark.range(1).select(F.array(*[F.lit(r) for r in cetesb_ratios()]).alias("ratio"))


def usable_stations(stations: DataFrame, columns: Sequence[str] = STATION_COLUMNS) -> DataFrame:
    """Stations with an 'ok' note and all ratios, as (..., ratio) made non-decreasing.

    Ratios of 0 or less become missing and leave their vector unrepaired; the last ratio is 1.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    complete = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))
    positive = F.array(
        *[F.when(F.col(c) > 0, F.col(c).cast("double")) for c in columns[:-1]], F.lit(1.0)
    )
    return (
        stations.filter(F.lower("note").contains("ok") & complete)
        .withColumn("ratio", cumulative_max(positive))
        .drop(*columns)
    )


def station_ratios(
    stations: DataFrame, cells: DataFrame, payload: Sequence[str] = ("ratio",), tie: str = "code"
) -> DataFrame:
    """(row, col, station, payload...) of the nearest usable station; `cells` has row, col, lat, lon."""
    near = nearest_k(cells, stations, 1, tie=[tie], payload=list(payload), x="lon", y="lat")
    best = F.get("neighbours", F.lit(0))
    return near.select(
        "row", "col", best[tie].alias("station"), *[best[c].alias(c) for c in payload]
    )


def ratio_vectors(ratio_cells: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """(keys, ratio) from long rows (keys, duration_min, ratio); absent durations are NULL, 24 h is 1."""
    picks = [
        F.max(F.when(F.col("duration_min") == d, F.col("ratio"))) for d in DURATIONS_MIN[:-1]
    ]
    return ratio_cells.groupBy(*keys).agg(F.array(*picks, F.lit(1.0)).alias("ratio"))


def repaired_ratios(
    vectors: DataFrame, keys: Sequence[str] = ("row", "col"), tol: float = 1e-6
) -> DataFrame:
    """(keys, ratio, violations, magnitude, problem): monotone repair and its verdict.

    A cell is a problem when any ratio is missing or any was lifted.
    """
    fixed = vectors.select(*keys, repair_monotone(F.col("ratio"), tol).alias("r"))
    return fixed.select(
        *keys, F.col("r.out").alias("ratio"), F.col("r.violations").alias("violations"),
        F.col("r.magnitude").alias("magnitude"),
        (F.exists("r.out", lambda x: x.isNull()) | (F.col("r.violations") > 0)).alias("problem"),
    )


def repair_summary(vectors: DataFrame, tol: float = 1e-6) -> DataFrame:
    """One row: cells, share of repaired cells, and number, sum and median (0 without any) of the lifts."""
    fixed = vectors.select(repair_monotone(F.col("ratio"), tol).alias("r"))
    middle = exact_quantiles(fixed.select(F.explode("r.lifts").alias("lift")), [], "lift", [0.5]).select("q").first()
    return fixed.agg(
        F.count("*").alias("n_cells"),
        F.avg(F.when(F.col("r.violations") > 0, 1.0).otherwise(0.0)).alias("repaired_share"),
        F.sum("r.violations").cast("long").alias("lifts"),
        F.sum("r.magnitude").alias("lift_sum"),
        F.lit(middle[0] if middle else 0.0).alias("lift_median"),
    )


def raster_ratios(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Repair, then problem cells copy the vector of the nearest clean cell.

    Adds violations, magnitude, problem, src_row, src_col and src_dist.
    """
    repaired = repaired_ratios(vectors, [*keys, "row", "col"]).withColumn("clean", ~F.col("problem"))
    return fill_nearest(repaired, "clean", ["ratio"], keys).drop("clean")


def intensity_scale(ratio: Column, durations: Sequence[int] = DURATIONS_MIN) -> Column:
    """S(D) = ratio / hours; missing and non-positive values are NULL."""
    hours = F.array(*[F.lit(d / 60.0) for d in durations])
    return F.zip_with(ratio, hours, lambda r, h: F.when(r > 0, r / h))
