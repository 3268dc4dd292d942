"""The parity index of polygons against plain ray casting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rainspark.operators.polygons import clip_to, first_polygon, polygon_tiles, rectangle

RINGS = "poly_id int, rings array<array<struct<x:double,y:double>>>, name string"


def coast(rng, n, cx, cy, r, rough=0.05):
    """A wiggly closed line of n corners around a place."""
    out = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, r * (1 + 0.3 * math.sin(9 * i / n * 6.28) + rng.uniform(-rough, rough))
        out.append((cx + d * math.cos(a), cy + d * math.sin(a)))
    return out


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


@pytest.mark.parametrize("tile", [0.7, 1.0, 5.0])
def test_equals_ray_casting(spark, tile):
    rng = random.Random(1)
    hole = coast(rng, 150, 0, 0, 2.0)
    shapes = [
        (1, [coast(rng, 600, 0, 0, 6.0), hole], "with a hole"),
        (2, [coast(rng, 200, 9, 4, 2.0), coast(rng, 90, 11, -3, 1.0)], "two parts"),
        (3, [[(-3.0, -2.0), (3.0, -2.0), (0.0, 5.0)]], "triangle over the hole"),
        (4, [[(-9.0, -9.0), (12.0, -9.0), (12.0, 9.0), (-9.0, 9.0)]], "box below all"),
    ]
    points = [(rng.uniform(-11, 14), rng.uniform(-11, 11)) for _ in range(3000)]
    points += [p for _, rings, _ in shapes for ring in rings for p in ring[::7]]  # corners
    points += [(float(i), float(j)) for i in range(-10, 13) for j in range(-10, 11)]  # corners of tiles
    rows = [(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0)]
    found = first_polygon(
        spark.createDataFrame(rows, "id int, lon double, lat double"), spark.createDataFrame(shapes, RINGS), ["name"], tile=tile
    )
    got = {r.id: (r.poly_id, r.name) for r in found.collect()}
    assert len(got) == len(rows) and got[-1] == (None, None)
    for i, (x, y) in enumerate(points):
        want = next(((k, name) for k, rings, name in shapes if inside(rings, x, y)), (None, None))
        assert got[i] == want, (x, y)


def test_edges_are_stored_about_once(spark):
    rng = random.Random(2)
    shape = spark.createDataFrame([(1, [coast(rng, 4000, 0, 0, 20.0, 0.002)], "a")], RINGS)
    tiles = polygon_tiles(shape, 1.0, []).select(F.explode("polys").alias("p"))
    kept, ends, n = tiles.agg(F.sum(F.size("p.edges")), F.sum(F.size("p.ends")), F.count("*")).first()
    assert 4000 <= kept <= 1.5 * 4000 and ends <= 4000 and n > 1000
    assert tiles.where("p.odd and size(p.edges) = 0 and size(p.ends) = 0").count() > 500  # whole tiles inside are one bit


def test_rectangles_of_tiles_and_crowded_tile(spark):
    boxes = spark.range(4).select(
        F.col("id").cast("int").alias("poly_id"), rectangle(F.col("id") * 2.0, F.lit(0.0), F.col("id") * 2.0 + 2.0, F.lit(2.0)).alias("rings")
    )
    points = spark.range(3000).select("id", (F.col("id") % 1000 * 0.0 + 3.0).alias("lon"), F.lit(1.0).alias("lat"))
    assert {r.poly_id for r in first_polygon(points, boxes, tile=2.0).collect()} == {1}
    edge = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (8.0, 1.0), (1.0, 2.0), (0.0, 1.9)], "lon double, lat double")
    assert {tuple(r) for r in clip_to(edge, boxes, tile=2.0).collect()} == {(0.0, 0.0), (2.0, 0.0), (0.0, 1.9)}
