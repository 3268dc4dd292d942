"""Compression of vectors to codes: one codebook for each part, refined by exact nearest-entry rounds.

Rescans are spared by norm-of-sum bounds. The entries of a codebook are cut into groups once. Each
vector part keeps, for every group, a lower bound of its distance to the entries of the group other
than its own, and the round in which that bound was exact. Since all codebooks are kept, the bound
holds in a later round less the largest true displacement of an entry of the group between the two rounds, i.e. the norm of the
sum of its moves, which is never more than the sum of their norms. A group whose bound still exceeds the
exact distance to the part's own entry is passed over; any other is scanned exactly. Bounds are rounded
down and compared with a margin, so the result is that of scanning everything.

A round is one pass that writes the rows with their codes and bounds to the shared folder, and one that sums the
parts of each entry in every task before the sums meet. To the driver come sums and counts of entries and the
first rows: a size fixed by the parameters and the dimension.

Cases: vectors that are null or hold null or non-finite components are left out; shorter vectors end
in zeros up to the longest one's length, rounded up to a multiple of the parts; repeated rows and
vec_ids are rows of their own (equal vec_ids start in the order of their vectors, a null vec_id comes
last); fewer rows than entries make smaller codebooks; unused entries stay; null labels
belong together; squared distances are exact below 2^53; no rows give no result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainspark.llm import vectors
from rainspark.session import materialise

#: Entries of a group, and rows of one step of the work in a task.
GROUP, STEP = 16, 4096
MARGIN = 1e-9


def cells(book: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """Groups of near entries of about `size`, by halving the widest component; indices ascend in a group."""

    def halve(part: np.ndarray) -> list[np.ndarray]:
        if len(part) <= size:
            return [np.sort(part)]
        widest = np.argmax(np.ptp(book[part], axis=0)) if book.shape[1] else 0
        ordered = part[np.argsort(book[part, widest], kind="stable")] if book.shape[1] else part
        return halve(ordered[: len(part) // 2]) + halve(ordered[len(part) // 2 :])

    return halve(np.arange(len(book)))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact for integers below 2^53."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def rounded_down(x: np.ndarray) -> np.ndarray:
    out = x.astype(np.float32)
    return np.where(out.astype(np.float64) > x, np.nextafter(out, np.float32(-np.inf)), out)


def displaced(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """For every earlier round and group, the largest net displacement of an entry since then."""
    moved = np.stack([np.sqrt(((history[-1] - old) ** 2).sum(1)) for old in history])
    return np.stack([moved[:, g].max(1, initial=0) for g in groups], axis=1) * (1 + MARGIN)


def nearest(
    x: np.ndarray, history: list[np.ndarray], groups: list[np.ndarray], code: np.ndarray | None, low: np.ndarray | None, stamp: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """code, its squared distance, bounds, their rounds, and the number of exact distances, for the parts x.

    code, low and stamp: what an earlier round gave, or None in the first one.
    """
    book, now, n = history[-1], len(history) - 1, len(x)
    least, second = np.full((n, len(groups)), np.inf), np.full((n, len(groups)), np.inf)
    place = np.full((n, len(groups)), len(book), dtype=np.int64)
    if code is None:
        own = np.full(n, np.inf)
        code = np.full(n, len(book), dtype=np.int64)
        bound = np.zeros((n, len(groups)))
        scan = np.ones((n, len(groups)), dtype=bool)
    else:
        own = ((x - book[code]) ** 2).sum(1)
        bound = low - displaced(history, groups)[stamp, np.arange(len(groups))]
        scan = bound <= (np.sqrt(own) * (1 + MARGIN))[:, None]
    best, distance = code.copy(), own.copy()
    for g, entries in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        found = squared(x[rows], book[entries])
        at = found.argmin(1)
        all_rows = np.arange(len(rows))
        least[rows, g], place[rows, g] = found[all_rows, at], entries[at]
        found[all_rows, at] = np.inf
        second[rows, g] = found.min(1)
        better = (least[rows, g] < distance[rows]) | ((least[rows, g] == distance[rows]) & (place[rows, g] < best[rows]))
        distance[rows] = np.where(better, least[rows, g], distance[rows])
        best[rows] = np.where(better, place[rows, g], best[rows])
    # bounds of scanned groups are exact now; the own entry of a part does not count
    exact = np.sqrt(np.where(place == best[:, None], second, least))
    old_bound = np.maximum(bound, 0)
    old_stamp = np.zeros((n, len(groups)), dtype=np.int8) if stamp is None else stamp
    left = best != code
    if low is not None and left.any():
        # the entry that a part has left is one of its group again
        group_of = np.zeros(len(book), dtype=np.int64)
        for g, entries in enumerate(groups):
            group_of[entries] = g
        rows = np.flatnonzero(left)
        rows = rows[~scan[rows, group_of[code[rows]]]]
        back = group_of[code[rows]]
        low, old_stamp = low.copy(), old_stamp.copy()
        low[rows, back] = rounded_down(np.minimum(old_bound[rows, back], np.sqrt(own[rows])) * (1 - MARGIN))
        old_stamp[rows, back] = now
    exact_low = rounded_down(exact * (1 - MARGIN))
    new_low = exact_low if low is None else np.where(scan, exact_low, low)
    new_stamp = np.where(scan, now, old_stamp).astype(np.int8)
    sizes = np.array([len(g) for g in groups])
    return best, distance, new_low, new_stamp, int((scan * sizes).sum())


def assign(rows: DataFrame, history: list[list[np.ndarray]], groups: list[list[np.ndarray]], first: bool) -> DataFrame:
    """rows with code, low, stamp, error, and scanned (the mean number of exact distances of a row in this round), by the
    last codebooks of the history (for each part, the list of its codebooks)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = spread(rows, history, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, groups = known.value
        parts, counts = len(history), [len(g) for g in groups]
        cuts = np.cumsum([0, *counts])
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = np.hsplit(vectors.matrix(part.column("v")), parts)
                if not first:
                    code, low, stamp = (vectors.matrix(part.column(c)) for c in ("code", "low", "stamp"))
                out, scanned = [], 0
                for m in range(parts):
                    old = (None, None, None) if first else (code[:, m].astype(np.int64), low[:, cuts[m] : cuts[m + 1]].astype(np.float32), stamp[:, cuts[m] : cuts[m + 1]].astype(np.int8))
                    *found, n = nearest(x[m], history[m], groups[m], *old)
                    out.append(found)
                    scanned += n
                codes, distances, lows, stamps = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("vec_id", "label", "v")),
                        vectors.lists(np.stack(codes, 1), pa.int16()),
                        vectors.lists(np.concatenate(lows, 1), pa.float32()),
                        vectors.lists(np.concatenate(stamps, 1), pa.int8()),
                        pa.array(np.sum(distances, axis=0).astype(np.int64)),
                        pa.array(np.full(part.num_rows, scanned // part.num_rows, dtype=np.int64)),
                    ],
                    names=["vec_id", "label", "v", "code", "low", "stamp", "error", "scanned"],
                )

    kept = ", ".join(f"{c} {kinds[c]}" for c in ("vec_id", "label", "v"))
    columns = ["vec_id", "label", "v", *([] if first else ["code", "low", "stamp"])]
    return rows.select(*columns).mapInArrow(run, f"{kept}, code array<smallint>, low array<float>, stamp array<tinyint>, error long, scanned long")


def spread(rows: DataFrame, history: list[list[np.ndarray]], groups: list[list[np.ndarray]]):
    """The codebooks for all tasks: rounds x parts x entries x components of a part, whatever the rows."""
    return rows.sparkSession.sparkContext.broadcast((history, groups))


def totals(rows: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums and counts of the parts of each entry, for every part: summed in each task first."""
    shape = (len(books), *books[0].shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            x, code = vectors.matrix(batch.column("v")), vectors.matrix(batch.column("code")).astype(np.int64)
            for m, part in enumerate(np.hsplit(x, shape[0])):
                np.add.at(sums[m], code[:, m], part)
                np.add.at(counts[m], code[:, m], 1)
        m, entry = np.nonzero(counts)
        if len(m):
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[m, entry]), vectors.lists(sums[m, entry].astype(np.int64), pa.int64())],
                names=["part", "entry", "n", "sums"],
            )

    found = rows.select("v", "code").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    each = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(shape[2])])
    out = [(np.zeros(shape[1:]), np.zeros(shape[1], dtype=np.int64)) for _ in books]
    for r in each.collect():  # one row per entry
        out[r["part"]][1][r["entry"]] = r["n"]
        out[r["part"]][0][r["entry"]] = [r[f"s{i}"] for i in range(shape[2])]
    return out


def first_rows(rows: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the n smallest vec_ids. Only ids are ordered over all rows; rows follow below the last of them."""
    ids = rows.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(n)
    last = ids.agg(F.max("vec_id"), F.count("vec_id")).first()
    near = rows if last[1] < n else rows.where(F.col("vec_id") <= last[0])
    return [r["v"] for r in near.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(n).collect()]


def codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, v, code (array of entries, one for each part), error and scanned, and the final codebooks."""
    rows = vectors.integers(df, scale, ("vec_id", "label"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // parts) * parts
    # no vector at all, or only empty ones, have codebooks of empty entries
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = materialise(rows.withColumn("v", padded), "vectors")
    smallest = first_rows(rows, entries)
    start = np.array(smallest, dtype=np.float64).reshape(len(smallest), width)
    history = [[part] for part in np.hsplit(start, parts)] if width else [[start] for _ in range(parts)]
    groups = [cells(h[0]) for h in history]
    if not len(start):
        return rows.select("vec_id", "label", "v", F.array().cast("array<smallint>").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scanned")), [h[0] for h in history]
    state = rows
    for turn in range(rounds + 1):
        state = materialise(assign(state, history, groups, first=turn == 0), "codes")
        if turn < rounds and width:
            for books, (sums, counts) in zip(history, totals(state, [h[-1] for h in history])):
                used = counts > 0
                book = books[-1].copy()
                book[used] = np.floor(sums[used] / counts[used, None])
                books.append(book)
        elif turn < rounds:
            for books in history:
                books.append(books[-1])
    return state, [h[-1] for h in history]


def digest(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 as text and numbers."""

    def hex2(x: Column) -> Column:
        return F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")

    # one row per label; written out, so that its size is measured and the other side can be split where a label is hot
    sums = materialise(state.groupBy(F.col("label").alias("own_label")).agg(F.sum("error").alias("label_error")), "labels")
    every = ",".join(str(int(x)) for book in books for x in book.reshape(-1))
    rows = state.select("vec_id", "label", F.array_join(F.transform("code", hex2), "").alias("code"), "error")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(every.encode()).hexdigest()).alias("codebooks_sha256"))
