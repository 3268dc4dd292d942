"""Substring dedup by windows: words covered by a window that also starts earlier go.

The reference is the corpus itself. Its index holds windows of WINDOW words by hash, each with the first
document that has it, spread over the partitions; every document is looked up in all that can know one of its
windows. A factor is the longest stretch all of whose windows occur earlier, in an earlier document or earlier
in the same one; its windows may come from several documents, so this is no relative Lempel-Ziv parse: a factor has no
source position. Windows across a factor boundary are looked up like all others, so a duplicate
that two factors share is not missed. Factors have WINDOW words or more; their words go.

To keep the index small, a window is only looked up if its anchor, the least k-gram hash in it, is shared by two
documents; equal windows have equal anchors. The shared anchors go to the tasks as a filter of a
fixed size, which lets some more windows through, but never loses one.

Cases: windows are judged on the input; a null or empty text has no words; rows that share a doc_id are
never earlier than one another; a row whose doc_id is null has no place in the order and is judged
by itself; repeated rows come out as often as they went in; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainspark.llm import links, words

#: Words of a window and of an anchor, and bits of the filter of shared anchors (16 MB).
WINDOW, ANCHOR, ANCHOR_BITS = 20, 7, 1 << 27
#: A text of at most 2 GB has fewer words.
_PLACE = np.uint64((1 << 31) - 1)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of v[i : i + width] for every i that has so many."""
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(w: words.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, their hashes, and those of their anchors."""
    whole, inside = w.windows(window)
    start = np.flatnonzero(inside)
    if not len(start):
        return start, whole[start], start
    grams, _ = w.windows(anchor)
    # the place breaks ties, from the left: the same in equal windows
    coded = grams & ~_PLACE | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    place = (sliding_min(coded, window - anchor + 1)[start] & _PLACE).astype(np.int64)
    return start, whole[start], grams[place]


def duplicates(docs: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """doc_id, windows: hashes of the windows of each document that an earlier document has."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", "text")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            w = words.words_of(part.column("text"))
            start, _, name = anchors(w, window, anchor)
            doc = part.column("doc_id").to_numpy()[w.document()[start]]
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]) if len(name) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(words.signed(name[new])), pa.array(doc[new])], names=["anchor", "doc_id"])

    shared = (
        rows.mapInArrow(anchor_rows, "anchor long, doc_id long")
        .groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
    )
    known = spark.sparkContext.broadcast(links.filter_of(shared, "anchor", bits))

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            w = words.words_of(part.column("text"))
            start, name, its_anchor = anchors(w, window, anchor)
            take = np.flatnonzero(links.may_hold(known.value, words.signed(its_anchor), bits))
            doc = w.document()[start[take]]
            # once per document
            _, first = np.unique(name[take] ^ words.mix(doc.astype(np.uint64)), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.signed(name[take][first])), pa.array(part.column("doc_id").to_numpy()[doc[first]])], names=["window", "doc_id"]
            )

    found = rows.mapInArrow(window_rows, "window long, doc_id long")
    # the index stays on the partitions of its aggregate, so windows of one document cost no shuffle there
    index = found.groupBy(F.col("window").alias("known")).agg(F.min("doc_id").alias("source"))
    later = found.join(index, (F.col("window") == F.col("known")) & (F.col("source") < F.col("doc_id")))
    # bounded by the length of a document
    return later.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))


def factors(start: np.ndarray, window: int) -> np.ndarray:
    """Greedy factors [from, to) of words, from the sorted starts of the windows that occur earlier."""
    if not len(start):
        return np.zeros((0, 2), dtype=np.int64)
    cut = np.flatnonzero(np.diff(start) > 1) + 1
    return np.stack([start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])] + window], axis=1)


def kept_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = ANCHOR_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors and kept, the other words joined by spaces, of every row of docs(doc_id, text)."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    earlier = duplicates(typed, window, anchor, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            w = words.words_of(part.column("text"))
            name, inside = w.windows(window)
            raw = w.data.tobytes()
            rows: list[tuple] = []
            for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                own = name[a:b][inside[a:b]]
                _, first = np.unique(own, return_index=True)
                old = np.ones(len(own), dtype=bool)
                old[first] = False
                listed = part.column("windows")[i]
                if listed.is_valid:
                    old |= np.isin(words.signed(own), listed.values.to_numpy())
                found = factors(np.flatnonzero(old), window)
                edge = np.zeros(b - a + 1, dtype=np.int64)
                np.add.at(edge, found[:, 0], 1)
                np.add.at(edge, found[:, 1], -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + a
                kept = b" ".join([raw[x:y] for x, y in zip(w.starts[keep].tolist(), w.ends[keep].tolist())]).decode()
                rows.append((int(b - a), int(b - a) - len(keep), len(found), kept))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "n_factors", "kept"],
            )

    return typed.join(earlier, "doc_id", "left").select("doc_id", "text", "windows").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, n_factors long, kept string"
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_factors")
