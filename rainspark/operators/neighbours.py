"""Exact k nearest neighbours as joins on an adaptive tile tree.

Points are counted in square tiles, each level splitting a tile in 4 x 4. A tile with more than
`LEAF` points has children, so a dense place is split deeper and no tile stays hot. Query places
are taken together in blocks, which are tiles of the same size that go on beyond the box of the points.
A block walks down the tree: at every level its nearest tiles that hold k points are compared with every other
tile, and tiles that are farther from all places of the block are dropped. Axis by axis this compares
distances from the same place, so it also tells tiles apart that are far from the block. A block with
many queries and many candidates is split along with its tiles. What is left is a short list of small tiles per
block, whose points are compared once more in the same way and then ranked for every query row.

A query row learns its block and its share of that block from a table of keys, and then moves
once, to the candidates of its share; a block has as many shares as its counted queries ask for.
Tiles are split until they hold few places, however near those are. No pair of query and point is ever
shuffled, and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainspark.functions.series import let
from rainspark.session import materialise

LEAF = 32          # points a tile may hold before it is split
STEP = 4           # levels that are counted at a time where tiles are still crowded
MAX_LEVEL = 25     # 4^25 tiles per axis: a tile is as small as doubles of the frame's size can tell apart
FEW = 96           # candidates a block may keep without being split further, however many its queries
MANY = 8192        # candidates a block may keep at most
WORK = 2 ** 19     # queries times candidates that a block may keep
REACH = 2 ** 20    # sides of the box of the points that tiles of queries go on beyond it
SHARE = 2048       # queries of a block that are ranked together
SLACK = 1 + 1e-9   # keeps rounding from dropping a tile that touches the bound
TINY = 1e-12       # part of a squared distance that rounding cannot reach

TILE = "struct<level:int,tx:bigint,ty:bigint,n:bigint,x1:double,x2:double,y1:double,y2:double>"


def _tile(v: Column, origin: float, side: float, level: int) -> Column:
    """Tile index at `level`; values on the far edge belong to the last tile."""
    n = 4 ** level
    i = F.floor((v - F.lit(origin)) / F.lit(side) * F.lit(float(n))).cast("long")
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def _query_tile(v: Column, origin: float, side: float, level: int) -> Column:
    """Tile index at `level`, also outside the box of the points; as far as doubles tell tiles apart."""
    reach = float(min(REACH, 2 ** 52 // 4 ** level))
    beyond = F.least(F.greatest((v - F.lit(origin)) / F.lit(side), F.lit(-reach)), F.lit(reach))
    return F.floor(beyond * F.lit(float(4 ** level))).cast("long")


def _gap2(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    gap = F.greatest(b1 - a2, a1 - b2, F.lit(0.0))
    return gap * gap


def _span2(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    span = F.greatest(F.abs(b2 - a1), F.abs(a2 - b1))
    return span * span


def _excess(q1: Column, q2: Column, a1: Column, a2: Column, b1: Column, b2: Column, at: Sequence[Column]) -> Column:
    """Along one axis: the most by which farthest [a1, a2] can be farther than nearest [b1, b2], squared, from q1 to q2.

    Between the ends and the edges of b the difference is convex, so those places (`at`) are enough.
    """
    def over(q: Column) -> Column:
        near = F.greatest(b1 - q, q - b2, F.lit(0.0))
        far = F.greatest(q - a1, a2 - q)
        return far * far - near * near

    places = [q1, q2, *[F.least(F.greatest(e, q1), q2) for e in at]]
    return F.greatest(*[over(q) for q in places])


def _prune(tiles: Column, k: int, single: bool = False) -> Column:
    """Drop the tiles that cannot hold one of the k nearest points of the block.

    With `single` the tiles are points (_x, _y).
    """
    names = ("_x", "_x", "_y", "_y") if single else ("x1", "x2", "y1", "y2")
    bx1, bx2, by1, by2 = (F.col(c) for c in ("bx1", "bx2", "by1", "by2"))

    def box(t: Column) -> list[Column]:
        return [t[c] for c in names]

    def span(t: Column) -> Column:
        x1, x2, y1, y2 = box(t)
        return _span2(bx1, bx2, x1, x2) + _span2(by1, by2, y1, y2)

    def gap(t: Column) -> Column:
        x1, x2, y1, y2 = box(t)
        return _gap2(bx1, bx2, x1, x2) + _gap2(by1, by2, y1, y2)

    def beyond(s: Column, t: Column) -> Column:
        """Whether the nearest k are nearer than `t` from every place of the block."""
        x1, x2, y1, y2 = box(t)
        over = (
            _excess(bx1, bx2, s["x1"], s["x2"], x1, x2, [] if single else [x1, x2])
            + _excess(by1, by2, s["y1"], s["y2"], y1, y2, [] if single else [y1, y2])
        )
        return over < s["d"] * F.lit(-TINY)

    far = F.lit(float("inf"))
    by_span = F.sort_array(F.transform(tiles, lambda t: F.struct(
        span(t).alias("d"), (F.lit(1).cast("long") if single else t["n"]).alias("n"),
        *[v.alias(c) for c, v in zip(("x1", "x2", "y1", "y2"), box(t))],
    )))
    nearest = F.aggregate(
        by_span,
        F.struct(
            F.lit(0).cast("long").alias("seen"), far.alias("d"),
            far.alias("x1"), (-far).alias("x2"), far.alias("y1"), (-far).alias("y2"),
        ),
        lambda s, t: F.when(s["seen"] >= k, s).otherwise(
            F.struct(
                (s["seen"] + t["n"]).alias("seen"),
                F.when(s["seen"] + t["n"] >= k, t["d"]).otherwise(s["d"]).alias("d"),
                F.least(s["x1"], t["x1"]).alias("x1"), F.greatest(s["x2"], t["x2"]).alias("x2"),
                F.least(s["y1"], t["y1"]).alias("y1"), F.greatest(s["y2"], t["y2"]).alias("y2"),
            )
        ),
    )
    # with fewer than k points nothing can be dropped
    return let(nearest, lambda s: F.when(s["seen"] < k, tiles).otherwise(
        F.filter(tiles, lambda t: (gap(t) <= s["d"] * F.lit(SLACK)) & ~beyond(s, t))
    ))


def nearest_k(
    queries: DataFrame, points: DataFrame, k: int, *, tie: Sequence[str],
    payload: Sequence[str] = (), group: Sequence[str] = (), x: str = "x", y: str = "y",
) -> DataFrame:
    """Adds `neighbours` to `queries`: up to k structs (d2, *tie, *payload), nearest first.

    Distances are planar, in the units of x and y; equal distances are ordered by `tie`. With
    `group`, neighbours come from the same group only (groups must be non-NULL). Queries of a
    group without points get an empty list.
    """
    g = list(group)
    named = [*tie, *[c for c in payload if c not in tie]]
    at_place = W.partitionBy(*g, "_x", "_y").orderBy(*tie)
    usable = points.dropna(subset=[x, y]).select(
        *g, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *named
    )
    # equal places: only the first k by tie can be among the k nearest of anybody
    pts = materialise(
        usable.withColumn("_rn", F.row_number().over(at_place)).filter(F.col("_rn") <= k).drop("_rn"),
        "points",
    )
    groups = F.approx_count_distinct(F.struct(*g)) if g else F.lit(1)
    frame = pts.agg(
        F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y"), F.count("*"), groups
    ).first()
    fields = ["d2", *named]
    kind = ",".join(
        f"`{c}`:{'double' if c == 'd2' else pts.schema[c].dataType.simpleString()}" for c in fields
    )
    if frame[4] == 0:
        return queries.withColumn("neighbours", F.from_json(F.lit("[]"), f"array<struct<{kind}>>"))
    x0, y0 = frame[0], frame[2]
    side = max(frame[1] - x0, frame[3] - y0) or 1.0

    nodes, depth = _tile_tree(pts, g, _even_level(frame[4] / max(frame[5], 1)), x0, y0, side)
    leaves = _leaves(pts, nodes, g, depth, x0, y0, side, named)

    # query blocks are tiles of the same tree; a block is split with the tiles it looks at until
    # few enough candidates are left
    places = queries.dropna(subset=[x, y]).select(
        *g, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    blocks = materialise(_coarser(_counted(places, g, depth, x0, y0, side, _query_tile), g, 0, depth), "blocks")
    rect = {"bx1": "x1", "bx2": "x2", "by1": "y1", "by2": "y2"}
    block = [*g, "_bl", "_bx", "_by"]
    root = F.array(F.struct(*[F.lit(0) for _ in range(8)]).cast(TILE))
    live = blocks.filter(F.col("level") == 0).select(
        *g, F.lit(0).alias("_bl"), F.col("tx").alias("_bx"), F.col("ty").alias("_by"),
        *[F.col(c).alias(r) for r, c in rect.items()], F.col("n").alias("_asked"), root.alias("tiles"), F.lit(False).alias("_done"),
    )
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(depth):
        stage = nodes.filter(F.col("level") == level).select(
            *g, F.lit(level).alias("_l"), F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), "children"
        )
        opened = (
            live.select(*block, *rect, "_asked", "_done", F.explode("tiles").alias("t"))
            .withColumn("_l", F.col("t.level")).withColumn("_tx", F.col("t.tx")).withColumn("_ty", F.col("t.ty"))
            .join(stage, [*g, "_l", "_tx", "_ty"], "left")
            .withColumn("t", F.coalesce("children", F.array("t")))
            .groupBy(*block, *rect, "_asked", "_done").agg(F.flatten(F.collect_list("t")).alias("tiles"))
        )
        parts = blocks.filter(F.col("level") == level + 1).select(
            *g, F.lit(level).alias("_pl"), F.floor(F.col("tx") / 4).alias("_px"),
            F.floor(F.col("ty") / 4).alias("_py"), F.col("tx").alias("_cx"), F.col("ty").alias("_cy"),
            *[F.col(c).alias(f"_{c}") for c in rect.values()], F.col("n").alias("_n"),
        )
        # finished blocks meet no part and stay as they are; their tiles go on being opened
        split = opened.withColumn("_pl", F.when(F.col("_done"), -1).otherwise(F.lit(level))).withColumn(
            "_px", F.col("_bx")
        ).withColumn("_py", F.col("_by")).join(parts, [*g, "_pl", "_px", "_py"], "left")
        live = split.select(
            *g, F.when(F.col("_cx").isNotNull(), level + 1).otherwise(F.col("_bl")).alias("_bl"),
            F.coalesce("_cx", "_bx").alias("_bx"), F.coalesce("_cy", "_by").alias("_by"),
            *[F.coalesce(f"_{c}", r).alias(r) for r, c in rect.items()], F.coalesce("_n", "_asked").alias("_asked"), "tiles", "_done",
        )
        # a few bytes of blocks are much work, so they are dealt by number
        live = live.repartition(tasks, *block).withColumn("tiles", _prune(F.col("tiles"), k))
        total = F.aggregate("tiles", F.lit(0).cast("long"), lambda n, t: n + t["n"])
        light = (total <= MANY) & (total * F.col("_asked") <= WORK)
        live = live.withColumn("_done", F.col("_done") | light | (total <= max(FEW, 4 * k)))
    near = (
        live.select(*block, *rect, F.explode("tiles").alias("t"))
        .select(*block, *rect, F.col("t.level").alias("_l"), F.col("t.tx").alias("_tx"), F.col("t.ty").alias("_ty"))
        .join(leaves, [*g, "_l", "_tx", "_ty"], "left")
        .groupBy(*block, *rect).agg(F.flatten(F.collect_list("pts")).alias("_near"))
        .select(*block, _prune(F.col("_near"), k, single=True).alias("_near"))
    )
    counts = blocks.select(
        *g, F.col("level").alias("_bl"), F.col("tx").alias("_bx"), F.col("ty").alias("_by"),
        F.ceil(F.col("n") / SHARE).cast("int").alias("_shares"),
    )
    near = materialise(near.join(counts, block), "near")

    def ranked(p: Column, i: Column) -> Column:
        dx, dy = F.col(x) - p["_x"], F.col(y) - p["_y"]
        return F.struct((dx * dx + dy * dy).alias("d2"), *[p[c].alias(c) for c in tie], i.alias("_i"))

    # only distance, tie and place in the list are ordered; the payload is looked up afterwards
    order = F.transform("_near", ranked)
    top = F.array(F.array_min(order)) if k == 1 else F.slice(F.sort_array(order), 1, k)
    best = F.transform(
        top,
        lambda m: F.struct(
            m["d2"].alias("d2"), *[F.get("_near", m["_i"])[c].alias(c) for c in named]
        ),
    )
    empty = F.from_json(F.lit("[]"), f"array<struct<{kind}>>")
    # a place lies in exactly one finished block, at one of its levels: the deepest tiles are looked up, not the rows
    tile = [*g, "_fx", "_fy"]
    above = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    shift = F.pow(F.lit(4.0), F.lit(depth) - F.col("_bl"))
    lookup = (
        blocks.filter(F.col("level") == depth).select(*g, F.col("tx").alias("_fx"), F.col("ty").alias("_fy"), above.alias("_bl"))
        .withColumn("_bx", F.floor(F.col("_fx") / shift)).withColumn("_by", F.floor(F.col("_fy") / shift))
        .join(near.select(*block, "_shares"), block).select(*tile, "_bl", "_bx", "_by", "_shares")
    )
    lookup = materialise(lookup, "lookup")
    located = F.col(x).isNotNull() & F.col(y).isNotNull()
    asked = (
        queries.withColumn("_fx", F.when(located, _query_tile(F.col(x), x0, side, depth)))
        .withColumn("_fy", F.when(located, _query_tile(F.col(y), y0, side, depth)))
        .join(lookup, tile, "left")
        .withColumn("_share", F.pmod(F.xxhash64(*queries.columns), F.col("_shares")).cast("int"))
    )
    shares = near.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).select(*block, "_share", "_near")
    # ranking is the costly part: the rows are dealt by share, also where the candidates could be sent everywhere
    matched = asked.join(shares.hint("merge"), [*block, "_share"], "left")
    found = F.when(F.size("_near") > 0, best).otherwise(empty)
    # a generator is computed once, while a filter on what is made from the list would be computed below it again
    return matched.select(*queries.columns, F.explode(F.array(found)).alias("neighbours"))


def _even_level(count: float) -> int:
    """Level at which evenly spread points would fill the tiles to `LEAF`."""
    return min(max(math.ceil(math.log(max(count / LEAF, 1.0), 16)), 0), MAX_LEVEL)


def _counted(
    pts: DataFrame, g: list[str], level: int, x0: float, y0: float, side: float, tile: Callable[..., Column] = _tile
) -> DataFrame:
    """Tiles of one level with the number and extent of their points."""
    return pts.groupBy(
        *g, tile(F.col("_x"), x0, side, level).alias("fx"), tile(F.col("_y"), y0, side, level).alias("fy")
    ).agg(
        F.count("*").alias("n"), F.min("_x").alias("x1"), F.max("_x").alias("x2"),
        F.min("_y").alias("y1"), F.max("_y").alias("y2"),
    )


def _coarser(base: DataFrame, g: list[str], first: int, level: int) -> DataFrame:
    """Tiles of the levels `first` to `level` from those of `level`."""
    shift = F.pow(F.lit(4.0), F.lit(level) - F.col("level"))
    return (
        base.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(level))))
        .withColumn("tx", F.floor(F.col("fx") / shift)).withColumn("ty", F.floor(F.col("fy") / shift))
        .groupBy(*g, "level", "tx", "ty")
        .agg(
            F.sum("n").alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"),
            F.min("y1").alias("y1"), F.max("y2").alias("y2"),
        )
    )


def _tile_tree(pts: DataFrame, g: list[str], even: int, x0: float, y0: float, side: float):
    """Split tiles with the counts and extents of their children, and the depth of the tree.

    Most places need no level below that of an even spread; only the points of tiles that are
    still crowded there are counted further down, some levels at a time.
    """
    level = min(even + 1, MAX_LEVEL)
    base = materialise(_counted(pts, g, level, x0, y0, side), "tiles")
    tiles = _coarser(base, g, 1, level)
    crowded = base.filter(F.col("n") > LEAF)
    while level < MAX_LEVEL and not crowded.isEmpty():
        here = pts.withColumn("fx", _tile(F.col("_x"), x0, side, level)).withColumn(
            "fy", _tile(F.col("_y"), y0, side, level)
        )
        pts = here.join(crowded.select(*g, "fx", "fy"), [*g, "fx", "fy"], "left_semi").drop("fx", "fy")
        deeper = min(level + STEP, MAX_LEVEL)
        deep = materialise(_counted(pts, g, deeper, x0, y0, side), "tiles")
        tiles = tiles.unionByName(_coarser(deep, g, level + 1, deeper))
        level, crowded = deeper, deep.filter(F.col("n") > LEAF)
    child = F.struct("level", "tx", "ty", "n", "x1", "x2", "y1", "y2").cast(TILE)
    nodes = (
        tiles.groupBy(
            *g, (F.col("level") - 1).alias("level"),
            F.floor(F.col("tx") / 4).alias("tx"), F.floor(F.col("ty") / 4).alias("ty"),
        )
        .agg(F.sum("n").alias("n"), F.collect_list(child).alias("children"))
        .filter(F.col("n") > LEAF)
    )
    nodes = materialise(nodes, "nodes")
    deepest = nodes.agg(F.max("level")).first()[0]
    return nodes, 0 if deepest is None else deepest + 1


def _leaves(
    pts: DataFrame, nodes: DataFrame, g: list[str], depth: int, x0: float, y0: float, side: float,
    keep: list[str],
) -> DataFrame:
    """Points gathered by the unsplit tile they lie in."""
    placed = pts.withColumn("_l", F.lit(0))
    for level in range(depth):
        split = nodes.filter(F.col("level") == level).select(
            *g, F.col("tx").alias("_px"), F.col("ty").alias("_py"), F.lit(1).alias("_split")
        )
        placed = (
            placed.withColumn("_px", _tile(F.col("_x"), x0, side, level))
            .withColumn("_py", _tile(F.col("_y"), y0, side, level))
            .join(split, [*g, "_px", "_py"], "left")
            .withColumn("_l", F.col("_l") + F.coalesce("_split", F.lit(0)))
            .drop("_split")
        )
    shift = F.pow(F.lit(4.0), F.lit(MAX_LEVEL) - F.col("_l"))
    return (
        placed.withColumn("_tx", F.floor(_tile(F.col("_x"), x0, side, MAX_LEVEL) / shift))
        .withColumn("_ty", F.floor(_tile(F.col("_y"), y0, side, MAX_LEVEL) / shift))
        .groupBy(*g, "_l", "_tx", "_ty")
        .agg(F.collect_list(F.struct("_x", "_y", *keep)).alias("pts"))
    )
