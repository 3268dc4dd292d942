"""Grids, interpolation, regridding and bias application on cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rainspark.functions.numeric import cap
from rainspark.grid import Grid
from rainspark.operators.neighbours import nearest_k
from rainspark.session import materialise

REACH = 3  # steps within which a bad cell looks for a good one before the tree search


def point_bounds(points: DataFrame) -> DataFrame:
    """One row: the box around the points."""
    return points.agg(
        F.min("lon").alias("minx"), F.min("lat").alias("miny"),
        F.max("lon").alias("maxx"), F.max("lat").alias("maxy"),
    )


def polygon_bounds(polygons: DataFrame) -> DataFrame:
    corner = F.explode(F.flatten("rings")).alias("p")
    return point_bounds(polygons.select(corner).select(F.col("p.x").alias("lon"), F.col("p.y").alias("lat")))


def build_grid(bounds: DataFrame, res: float, pad: float = 0.5) -> DataFrame:
    """Nodes (iy, ix, lat, lon) from min-pad in steps of `res` up to and past max+pad.

    `bounds` has one row; the bands of latitude are spread over the cluster before each of them is
    opened into its nodes.
    """
    def count(lo: str, hi: str):
        return F.ceil((F.col(hi) + pad + res - (F.col(lo) - pad)) / res).cast("int")

    bands = bounds.select(
        (F.col("minx") - pad).alias("x0"), (F.col("miny") - pad).alias("y0"),
        count("minx", "maxx").alias("nx"),
        F.explode(F.sequence(F.lit(0), count("miny", "maxy") - 1)).alias("iy"),
    ).repartition("iy")
    return bands.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).select(
        "iy", "ix",
        (F.col("y0") + F.col("iy") * F.lit(res)).alias("lat"),
        (F.col("x0") + F.col("ix") * F.lit(res)).alias("lon"),
    )


def cell_centres(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumn("lat", grid.lat_of(F.col("row"))).withColumn("lon", grid.lon_of(F.col("col")))


def idw(
    points: DataFrame, cells: DataFrame, k: int = 8, power: float = 2.0,
    limits: tuple[float, float] | None = (0.25, 10.0), value: str = "zeta", tie: str = "station_id",
    group: Sequence[str] = (),
) -> DataFrame:
    """`cells` (lat, lon) with the inverse-distance mean of their k nearest points as `value`."""
    near = nearest_k(
        cells, points, k, tie=[tie], payload=[value], group=group, x="lon", y="lat"
    )
    def weight(n):
        return F.pow(F.greatest(F.sqrt(n["d2"]), F.lit(1e-12)), F.lit(-float(power)))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wz"))
    mean = F.aggregate(
        "neighbours", zero,
        lambda s, n: F.struct(
            (s["w"] + weight(n)).alias("w"), (s["wz"] + weight(n) * n[value]).alias("wz")
        ),
        lambda s: s["wz"] / F.nullif(s["w"], F.lit(0.0)),
    )
    out = near.withColumn(value, mean).drop("neighbours")
    return out if limits is None else out.withColumn(value, cap(F.col(value), *limits))


def regrid(
    src: DataFrame, src_grid: Grid, dst: DataFrame, dst_grid: Grid, value: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Bilinear value of `src` at the cell centres of `dst` (row, col): (keys, row, col, value).

    Equal grids are a plain join. Otherwise each target looks up the neighbours that carry weight,
    by cell number. Targets outside the source, or with a missing neighbour, have no value.
    """
    if src_grid.same_as(dst_grid):
        return dst.select("row", "col").join(src.select(*keys, "row", "col", value), ["row", "col"])
    fr = (F.lit(src_grid.y0) - F.col("lat")) / F.lit(src_grid.dy) - 0.5
    fc = (F.col("lon") - F.lit(src_grid.x0)) / F.lit(src_grid.dx) - 0.5
    placed = (
        cell_centres(dst.select("row", "col"), dst_grid)
        .withColumn("fr", F.round(fr, 9)).withColumn("fc", F.round(fc, 9))
        .withColumn("r0", F.floor("fr").cast("int")).withColumn("c0", F.floor("fc").cast("int"))
        .withColumn("wr", F.col("fr") - F.col("r0")).withColumn("wc", F.col("fc") - F.col("c0"))
    )
    one = F.lit(1.0)
    corners = [
        F.struct(
            (F.col("r0") + i).alias("r"), (F.col("c0") + j).alias("c"),
            ((F.col("wr") if i else one - F.col("wr")) * (F.col("wc") if j else one - F.col("wc"))).alias("w"),
        )
        for i in (0, 1) for j in (0, 1)
    ]
    # four places are opened and those without weight dropped afterwards: a filter on the list would be pushed down to
    # what the targets come from, and the list written out and computed again for each of those rows
    lookups = (
        placed.withColumn("needed", F.when(F.col("wr") > 0, 2).otherwise(1) * F.when(F.col("wc") > 0, 2).otherwise(1))
        .select("row", "col", "needed", F.explode(F.array(*corners)).alias("n"))
        .select("row", "col", "needed", F.col("n.r").alias("r"), F.col("n.c").alias("c"), F.col("n.w").alias("w"))
        .filter(F.col("w") > 0)
    )
    values = src.select(*keys, F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("_v"))
    return (
        lookups.join(values, ["r", "c"])
        .groupBy(*keys, "row", "col")
        .agg(
            F.sum(F.col("w") * F.col("_v")).alias(value),
            F.count("_v").alias("found"), F.first("needed").alias("needed"),
        )
        .filter(F.col("found") == F.col("needed"))
        .select(*keys, "row", "col", value)
    )


def apply_bias(
    amax: DataFrame, zetas: DataFrame, limits: tuple[float, float] | None = (0.25, 5.0),
    max_mm: float = 500.0, keys: Sequence[str] = ("product",),
) -> DataFrame:
    """Annual maxima times the cell's factor, at most `max_mm`; NULL where either is missing."""
    z = F.col("zeta") if limits is None else cap(F.col("zeta"), *limits)
    factor = zetas.select(*keys, "row", "col", z.alias("_z"))
    corrected = cap(F.col("mm") * F.col("_z"), None, max_mm)
    return amax.join(factor, [*keys, "row", "col"], "left").withColumn("mm", corrected).drop("_z")


def sample_raster(
    points: DataFrame, cells: DataFrame, grid: Grid, bands: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Points with the bands of the cell they lie in (NULL outside); one row per `keys` of the cell."""
    placed = points.withColumn("row", grid.row_of(F.col("lat"))).withColumn("col", grid.col_of(F.col("lon")))
    return placed.join(cells.select(*keys, "row", "col", *bands), ["row", "col"], "left")


def fill_nearest(
    cells: DataFrame, valid: str, bands: Sequence[str], keys: Sequence[str] = (),
    needed: str | None = None, reach: int = REACH,
) -> DataFrame:
    """Cells where the flag column `valid` is not true take all bands of the nearest valid cell.

    Nearest by row and column, ties by (row, col). Adds src_row, src_col (NULL for valid cells and
    where nothing can be borrowed) and src_dist (0 for valid cells). With the flag column `needed`
    only the cells it marks are filled. The cells are written once, since the good ones, the bad
    ones and the search all read them.

    Bad cells first look at the places within `reach` steps of row and column, by an equi join;
    what they find within that distance is final. The few that are farther from any good cell go
    to the tree search. Only places travel; bands are joined to the places found.
    """
    cells = materialise(cells, "cells")
    ok = F.coalesce(F.col(valid), F.lit(False))
    wanted = ~ok if needed is None else ~ok & F.coalesce(F.col(needed), F.lit(False))
    good, bad = cells.filter(ok), cells.filter(wanted)
    kept = cells.filter(~wanted).select(
        "*", F.lit(None).cast("int").alias("src_row"), F.lit(None).cast("int").alias("src_col"),
        F.when(ok, F.lit(0.0)).alias("src_dist"),
    )
    if bad.isEmpty():
        return kept
    place = [*keys, "row", "col"]
    steps = range(-reach, reach + 1)
    offsets = F.array(*[
        F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(r * r + c * c)).alias("d2"))
        for r in steps for c in steps if 0 < r * r + c * c <= reach * reach
    ])
    looked = bad.select(*place, F.explode(offsets).alias("o")).select(
        *place, (F.col("row") + F.col("o.r")).alias("src_row"), (F.col("col") + F.col("o.c")).alias("src_col"),
        F.col("o.d2").alias("d2"),
    )
    sources = good.select(*keys, F.col("row").alias("src_row"), F.col("col").alias("src_col"))
    close = looked.join(sources, [*keys, "src_row", "src_col"]).groupBy(*place).agg(
        F.min(F.struct("d2", "src_row", "src_col")).alias("s")
    )
    close = materialise(close.select(*place, "s.src_row", "s.src_col", "s.d2"), "close")
    far = bad.select(*place).join(close, place, "left_anti")
    if not far.isEmpty():
        near = nearest_k(
            far, good.select(*place), 1, tie=["row", "col"], payload=[], group=keys, x="col", y="row"
        ).withColumn("_s", F.get("neighbours", F.lit(0))).filter(F.col("_s").isNotNull())
        close = close.unionByName(near.select(
            *place, F.col("_s.row").alias("src_row"), F.col("_s.col").alias("src_col"), F.col("_s.d2").alias("d2")
        ))
    taken = good.select(
        *keys, F.col("row").alias("src_row"), F.col("col").alias("src_col"), F.struct(*bands).alias("_b")
    )
    found = close.join(taken, [*keys, "src_row", "src_col"])
    filled = bad.join(found, place, "left").select(
        *[
            F.when(F.col("_b").isNotNull(), F.col("_b")[c]).otherwise(F.col(c)).alias(c)
            if c in bands else F.col(c)
            for c in cells.columns
        ],
        "src_row", "src_col", F.sqrt("d2").alias("src_dist"),
    )
    return kept.unionByName(filled)
