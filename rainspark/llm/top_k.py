"""Exact top-k search by inner product, with the threshold algorithm over sorted per-dimension lists.

The rows are dealt into blocks by a hash of vec_id. The index of a block holds its vectors and, for every
dimension, its rows in the order of that component. A query reads the lists of all its dimensions side by side, from the
large end where its own component is positive and from the small end where it is negative. A row met for
the first time in any list is scored at once on its whole vector. The values last read, weighted with
the query, bound the score of every row not met yet; the search of a block stops when that bound is below the kth
best score, which is carried from block to block. A bound equal to that score does not stop it, since
an equal score counts if its vec_id is smaller.

Queries meet blocks in groups: each task takes a bounded group of queries and a bounded run of
blocks, and the best rows of the runs are merged by one ranking. So nothing is broadcast, no task grows
with the data, and a lost task is done again from the written index.

Cases: vectors that are null or hold null or non-finite components, and rows without vec_id, take
no part; rows that repeat a vec_id count once, with the smallest of their vectors; missing
components of shorter vectors count as 0; an empty vector scores 0; ties go to the smaller vec_id;
scores beyond 2^53 are rounded to doubles; no rows give no result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from rainspark.llm import vectors
from rainspark.session import materialise

#: Rows of a block, blocks of a run, queries of a group: means of a hash, whatever the data.
BLOCK, RUN, GROUP = 4096, 4, 256
#: Entries of each list that the first round reads; every round reads to twice the depth.
DEPTH = 8
INDEX = "block long, rows int, ids binary, vectors binary, orders binary"


@dataclass
class Lists:
    """A block: vectors by row, and for every dimension the rows and values in ascending order."""

    ids: np.ndarray
    vectors: np.ndarray
    orders: np.ndarray
    values: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.values = np.take_along_axis(self.vectors.T, self.orders, axis=1)


@dataclass
class Best:
    """The k best rows so far, best first."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scored: int = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]

    def beats(self, bound: float) -> bool:
        return len(self.scores) == self.k and self.scores[-1] > bound


def search(lists: Lists, query_id: int, query: np.ndarray, best: Best) -> None:
    """Offers every row of the block that can be among the best, but the query's own."""
    n, width = len(lists.ids), min(len(query), lists.vectors.shape[1])
    query = query[:width]
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    met = np.zeros(n, dtype=bool)
    read, depth = 0, min(DEPTH, n)
    while True:
        fresh = np.zeros(n, dtype=bool)
        if len(up) + len(down):
            fresh[lists.orders[up, n - depth : n - read]] = True
            fresh[lists.orders[down, read:depth]] = True
            bound = query[up] @ lists.values[up, n - depth] + query[down] @ lists.values[down, depth - 1]
        else:  # every row scores 0
            fresh[:], depth, bound = True, n, 0.0
        new = np.flatnonzero(fresh & ~met)
        met |= fresh
        best.scored += len(new)
        scores, ids = lists.vectors[new, :width] @ query, lists.ids[new]
        other = ids != query_id
        best.offer(scores[other], ids[other])
        if depth == n or best.beats(bound):
            return
        read, depth = depth, min(2 * depth, n)


def index(rows: DataFrame, blocks: int) -> DataFrame:
    """The lists of every block of rows(vec_id, v): one row of bounded size per block."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        found = vectors.matrix(table["v"].combine_chunks())
        orders = np.argsort(found.T, axis=1, kind="stable").astype(places(len(ids)))
        return pa.table(
            {"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([len(ids)], pa.int32())}
            | {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("ids", ids), ("vectors", found.astype(narrow(found))), ("orders", orders))}
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("block")
    return dealt.groupBy("block", "vec_id").agg(F.min("v").alias("v")).groupBy("block").applyInArrow(build, INDEX)


def narrow(x: np.ndarray) -> type:
    return np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.float64


def places(rows: int) -> type:
    return np.uint16 if rows <= 1 << 16 else np.int32


def lists_of(rows: int, ids: bytes, found: bytes, orders: bytes) -> Lists:
    width = len(orders) // (np.dtype(places(rows)).itemsize * rows)
    kind = np.int16 if len(found) == 2 * rows * width else np.float64
    return Lists(
        np.frombuffer(ids, np.int64),
        np.frombuffer(found, kind).reshape(rows, width).astype(np.float64),
        np.frombuffer(orders, places(rows)).reshape(width, rows),
    )


def top_k(df: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of every row whose vec_id is divisible by `every`."""
    rows = vectors.integers(df.where("vec_id is not null"), scale).withColumn("vec_id", F.col("vec_id").cast("long"))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, n_asked = rows.agg(F.count("*"), F.count_if(asked)).first()
    blocks, groups = -(-n // BLOCK) or 1, -(-n_asked // GROUP) or 1
    runs = -(-blocks // RUN)
    lists = materialise(index(rows, blocks), "lists")
    queries = rows.where(asked).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))

    def every_one(count: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("run", every_one(runs))
    right = lists.withColumn("run", F.pmod("block", F.lit(runs)).cast("int")).withColumn("group", every_one(groups))

    def find(asking: pa.Table, held: pa.Table) -> pa.Table:
        ids, found = asking["query_id"].to_numpy(), vectors.matrix(asking["v"].combine_chunks()) if len(asking) else np.zeros((0, 0))
        best = [Best(k) for _ in ids]
        for row in range(len(held) if len(ids) else 0):
            part = lists_of(*(held[c][row].as_py() for c in ("rows", "ids", "vectors", "orders")))
            for i, query, b in zip(ids, found, best):
                search(part, int(i), query, b)
        return pa.table(
            {
                "query_id": pa.array(np.repeat(ids, [len(b.ids) for b in best]), pa.int64()),
                "vec_id": pa.array(np.concatenate([b.ids for b in best] or [ids]), pa.int64()),
                "score": pa.array(np.concatenate([b.scores for b in best] or [ids]).astype(np.int64), pa.int64()),
            }
        )

    # blocks of a stated query set against blocks of all rows
    found = left.groupBy("group", "run").cogroup(right.groupBy("group", "run")).applyInArrow(find, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
