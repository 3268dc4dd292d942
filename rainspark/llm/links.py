"""Connecting items that fall into common buckets, without all pairs of a bucket.

Shared by the operators that group near-duplicates: components of verified links, and the two
rounds in which the members of buckets are tested.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rainspark.session import materialise

#: Bits of a filter of ids: a fixed size, whatever the data. It only spares work; a join decides.
FILTER_BITS = 1 << 23


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable over edges(a, b), for every node of an edge.

    Each round takes the least label of the neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path. A node with very many edges is only ever
    the key of a partial aggregate or of a join that can be split.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        root = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        new = materialise(lower.join(root, "low").select("node", F.least("low", "root").alias("component"), (F.least("low", "root") < F.col("old")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def connect(
    members: DataFrame,
    items: DataFrame,
    possible: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """node, component of every item that a verified pair links to another.

    members(key, item): the buckets; every pair that verify() would keep lies in some bucket.
    items(item, rank, ...): one row per item; the highest rank of a bucket leads it.
    possible(x, y): a test on the columns of items with prefixes x and y that every link passes.
    verify(pairs(a, b)): the pairs that are links.

    Round 1 tests every member against the leader of its bucket. Round 2 tests the members that are
    not connected with their leader against those members that they are not connected with. A pair
    never tested is connected already: both its items are with their leader. So no link between
    components is lost, while a bucket of g copies costs g tests.
    """
    extra = [c for c in items.columns if c != "item"]

    def side(prefix: str) -> DataFrame:
        return items.select(F.col("item").alias(f"{prefix}item"), *[F.col(c).alias(f"{prefix}{c}") for c in extra])

    ranked = materialise(members.join(items.select("item", "rank"), "item"), "members")
    leaders = ranked.groupBy("key").agg(F.max("rank").alias("top")).where("top is not null")
    leaders = ranked.join(leaders, "key").where("rank = top").groupBy("key").agg(F.min("item").alias("leader"))
    led = materialise(ranked.join(leaders, "key").select("key", "item", "leader"), "led")
    first = led.where("item <> leader").select(F.least("item", "leader").alias("a"), F.greatest("item", "leader").alias("b")).distinct()
    first = first.join(side("x_"), F.col("a") == F.col("x_item")).join(side("y_"), F.col("b") == F.col("y_item")).where(possible("x_", "y_")).select("a", "b")
    links = materialise(verify(first), "links")
    labels = components(links)

    own = labels.select(F.col("node").alias("item"), F.col("component").alias("own"))
    top = labels.select(F.col("node").alias("leader"), F.col("component").alias("top"))
    labelled = (
        led.join(own, "item", "left").join(top, "leader", "left")
        .select("key", "item", "leader", F.coalesce("own", "item").alias("own"), F.coalesce("top", "leader").alias("top"))
    )
    # buckets in which somebody is not connected with the leader
    outside = materialise(labelled.where("own <> top").select("key", "item", "own"), "outside")
    if outside.isEmpty():
        return labels
    inside = labelled.where("item <> leader").join(outside.select("key").distinct(), "key", "left_semi")
    inside = materialise(inside.select("key", "item", "own", (F.col("own") != F.col("top")).alias("out")), "inside")
    x = outside.select("key", F.col("item").alias("x_item"), F.col("own").alias("x_own")).join(side("x_"), "x_item")
    y = inside.select(F.col("key").alias("y_key"), F.col("item").alias("y_item"), F.col("own").alias("y_own"), "out").join(side("y_"), "y_item")
    test = (F.col("key") == F.col("y_key")) & (F.col("x_own") != F.col("y_own")) & (~F.col("out") | (F.col("x_item") < F.col("y_item"))) & possible("x_", "y_")
    second = x.join(y, test).select(F.least("x_item", "y_item").alias("a"), F.greatest("x_item", "y_item").alias("b")).distinct()
    more = materialise(verify(second), "links")
    return components(links.unionByName(more))


def slot(column: Column, bits: int = FILTER_BITS) -> Column:
    """Place of a long in a filter; slot_of() is the same for arrays."""
    return F.pmod(column, F.lit(bits - 1)) + 1


def slot_of(values: np.ndarray, bits: int) -> np.ndarray:
    return np.mod(values, bits - 1) + 1


def filter_of(values: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Packed bits, set at the slot of every value: bits / 8 bytes, whatever the number of values."""
    slots = values.select(slot(F.col(column), bits).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    # bucket b from 1 on holds the slots (b - 1) * 32768 + 1 .. b * 32768, so one bit is left free before them
    out = np.zeros(bits // 8 + 1, dtype=np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[(r["bucket"] - 1) * len(part) :][: len(part)] = part[: len(out) - (r["bucket"] - 1) * len(part)]
    return out


def may_hold(filter_: np.ndarray, values: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Whether each value may have been given to filter_of(); never false for one that was."""
    place = slot_of(values, bits) - 1
    return (filter_[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0
