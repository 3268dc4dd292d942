"""Point-in-polygon labels and boundary masks.

Polygons are rows (poly_id, rings, names...) with rings ARRAY<ARRAY<STRUCT<x, y>>>; holes and
several parts are just more rings, since inside means an odd number of crossings. Boundary points
follow the half-open rule: the lower and left edges belong to the polygon.

Polygons are stored as a parity index. A tile keeps the edges that run through its columns. All edges east
of it count by their heights alone, and where two of them meet their common height cancels, so a coast line of any
length beyond the tile leaves a few open ends, or one bit if it spans the tile's whole band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rainspark.functions.series import let
from rainspark.session import materialise


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rings of an axis-parallel rectangle."""
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))


def _edges(rings: Column) -> Column:
    def of_ring(ring: Column) -> Column:
        return F.transform(
            ring,
            lambda p, i: F.struct(
                p["x"].alias("ax"), p["y"].alias("ay"),
                F.get(ring, (i + 1) % F.size(ring))["x"].alias("bx"),
                F.get(ring, (i + 1) % F.size(ring))["y"].alias("by"),
            ),
        )

    return F.flatten(F.transform(rings, of_ring))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    spans = (e["ay"] > y) != (e["by"] > y)
    at = e["ax"] + (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
    return spans & (x < at)


def _open_ends(heights: Column) -> Column:
    """The heights that occur an odd number of times."""
    def step(kept: Column, y: Column) -> Column:
        again = (F.size(kept) > 0) & (F.element_at(kept, -1) == y)
        return F.when(again, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(y)))

    return F.aggregate(F.sort_array(heights), F.array().cast("array<double>"), step)


def polygon_tiles(polygons: DataFrame, tile: float, names: Sequence[str]) -> DataFrame:
    """(tx, ty, polys): what each tile needs of the polygons that reach into it, by poly_id.

    Of a polygon a tile has `edges`, those of its latitude band that run through its column, `ends`, the open ends
    inside the band of the edges further east, and `odd`, whether those have an odd number of ends above the band.
    Tiles that hold nothing of a polygon are left out.
    """
    def column(x: Column) -> Column:
        return F.floor(x / tile)

    edges = F.transform(
        _edges(F.col("rings")),
        lambda e: F.struct(
            *[e[c].cast("double").alias(c) for c in ("ax", "ay", "bx", "by")],
            column(F.least(e["ax"], e["bx"])).alias("west"), column(F.greatest(e["ax"], e["bx"])).alias("east"),
        ),
    )
    xs, ys = F.transform("edges", lambda e: e["ax"]), F.transform("edges", lambda e: e["ay"])
    boxed = polygons.select("poly_id", *names, edges.alias("edges")).select(
        "*", F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"),
        F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2"),
    )
    low, high = F.col("ty") * F.lit(tile), (F.col("ty") + 1) * F.lit(tile)
    bands = boxed.withColumn("ty", F.explode(F.sequence(column(F.col("y1")), column(F.col("y2"))))).withColumn(
        "edges",
        F.filter("edges", lambda e: (F.least(e["ay"], e["by"]) <= high) & (F.greatest(e["ay"], e["by"]) >= low)),
    )
    tiles = bands.withColumn("tx", F.explode(F.sequence(column(F.col("x1")), column(F.col("x2")))))
    beyond = F.filter("edges", lambda e: e["west"] > F.col("tx"))
    heights = F.flatten(F.transform(beyond, lambda e: F.array(e["ay"], e["by"])))
    own = F.filter("edges", lambda e: (e["west"] <= F.col("tx")) & (e["east"] >= F.col("tx")))
    kept = tiles.withColumn("ends", _open_ends(F.filter(heights, lambda y: y >= low))).select(
        "poly_id", *names, "x1", "x2", "y1", "y2", "tx", "ty",
        F.transform(own, lambda e: F.struct(*[e[c].alias(c) for c in ("ax", "ay", "bx", "by")])).alias("edges"),
        F.filter("ends", lambda y: y <= high).alias("ends"), (F.size(F.filter("ends", lambda y: y > high)) % 2 == 1).alias("odd"),
    ).filter("odd or size(ends) > 0 or size(edges) > 0")
    item = F.struct("poly_id", *names, "x1", "x2", "y1", "y2", "odd", "ends", "edges")
    return kept.groupBy("tx", "ty").agg(F.sort_array(F.collect_list(item)).alias("polys"))


def first_polygon(
    points: DataFrame, polygons: DataFrame, names: Sequence[str] = (), *, x: str = "lon",
    y: str = "lat", tile: float = 1.0,
) -> DataFrame:
    """Adds poly_id and `names` of the first polygon (lowest poly_id) holding the point, or NULL.

    Each point meets the one row of its tile. The tiles are written out, so that their size is measured and the points
    of a crowded tile can be split over tasks.
    """
    tiles = materialise(polygon_tiles(polygons, tile, names), "polygon-tiles")
    px, py = F.col(x), F.col(y)
    located = points.withColumn("tx", F.floor(px / tile)).withColumn("ty", F.floor(py / tile))

    def holds(p: Column) -> Column:
        boxed = px.between(p["x1"], p["x2"]) & py.between(p["y1"], p["y2"])
        crossed = F.size(F.filter(p["edges"], lambda e: _crosses(e, px, py))) + F.size(F.filter(p["ends"], lambda v: v > py))
        return boxed & ((crossed % 2 == 1) != p["odd"])

    hit = F.get(F.filter("polys", holds), F.lit(0))
    shape = ", ".join(
        f"{c}:{polygons.schema[c].dataType.simpleString()}" for c in ["poly_id", *names]
    )
    picked = let(hit, lambda h: F.struct(h["poly_id"].alias("poly_id"), *[h[n].alias(n) for n in names]))
    return (
        located.join(tiles, ["tx", "ty"], "left")
        .withColumn("_hit", picked.cast(f"struct<{shape.replace(', ', ',')}>"))
        .select(*points.columns, "_hit.poly_id", *[f"_hit.{n}" for n in names])
    )


def clip_to(points: DataFrame, polygons: DataFrame | None, **where) -> DataFrame:
    """Points inside any polygon; without polygons all points stay."""
    if polygons is None:
        return points
    return first_polygon(points, polygons, (), **where).filter("poly_id IS NOT NULL").drop("poly_id")


def place_label(adm2: Column, adm1: Column, adm0: Column) -> tuple[Column, Column]:
    """(short, full) place names with fallbacks for missing levels."""
    country = F.coalesce(adm0, F.lit("—"))
    short = F.coalesce(F.nullif(adm2, F.lit("")), F.nullif(adm1, F.lit("")), country)
    full = F.concat_ws(", ", F.nullif(adm2, F.lit("")), F.nullif(adm1, F.lit("")), country)
    return short.alias("place"), full.alias("place_full")
