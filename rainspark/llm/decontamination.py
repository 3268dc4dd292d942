"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Texts and benchmark items are compared as words in lower case without punctuation, on their shingles
of SHINGLE words (an item with fewer words is one shingle). A shingle weighs as often as it occurs, and
the similarity is the weighted Jaccard index, sum of the lesser over sum of the greater weights.

For every size that an item has, the windows of that size over every whole text get a 128-bit SimHash of their
shingles. A window needs no SimHash if fewer than SIMILARITY of its shingles occur in any item, since its
similarity cannot reach SIMILARITY then; item shingles go to the tasks as a filter of a fixed size. The
bits of a SimHash are cut into BLOCKS blocks; every item is entered under all values within
BLOCK_RADIUS of its own value in each block, which finds all fingerprints within RADIUS bits. The exact
similarity of those windows is then computed from the texts.

Cases: null and empty texts and items match nothing; items with equal texts each match; a text that
holds an item several times is found once, at its best and then first place; rows that share a doc_id are found
if one of them is, once for each of their texts; a null doc_id is found as well; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainspark.llm import links, words
from rainspark.llm.tables import text_key
from rainspark.session import materialise

SHINGLE, SIMILARITY = 5, 0.8
#: Of 128 bits: at the similarity limit two windows differ in 19 bits on the mean, with a deviation of 4.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BITS = BLOCKS * BLOCK_BITS
MASKS = np.array(
    [sum(1 << b for b in bits) for k in range(BLOCK_RADIUS + 1) for bits in itertools.combinations(range(BLOCK_BITS), k)], dtype=np.int64
)


def votes(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS votes, 1 or -1, for each shingle."""
    both = np.stack([words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), words.mix(shingles ^ np.uint64(0x14057B7EF767814F))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, two longs each, of rows of summed votes."""
    return np.packbits(sums > 0, axis=1).view(np.int64).reshape(-1, 2)


def plain_words(texts: pa.Array) -> words.Words:
    return words.words_of(texts, lower=True, spaces=words.PUNCTUATION)


def prepared_items(items: DataFrame) -> DataFrame:
    """item_id, size in words, shingles in order with repetitions, fp0, fp1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            w = plain_words(part.column("text"))
            rows = []
            for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                if b > a:
                    own = words.Words(w.hashes[a:b], w.starts[a:b], w.ends[a:b], np.array([0, b - a]), w.data)
                    k = min(SHINGLE, int(b - a))
                    s = own.windows(k)[0][: b - a - k + 1]
                    fp = packed(votes(s).sum(axis=0, keepdims=True))[0]
                    rows.append((part.column("item_id")[i].as_py(), int(b - a), words.signed(s), int(fp[0]), int(fp[1])))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (part.column("item_id").type, pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "size", "shingles", "fp0", "fp1"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, size int, shingles array<long>, fp0 long, fp1 long")


def window_prints(w: words.Words, sizes: list[int], known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """size, starts and fingerprints of the windows that can reach SIMILARITY."""
    n = len(w.hashes)
    last = np.repeat(w.bounds[1:], w.counts())
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sizes:
        k = min(SHINGLE, size)
        if k not in by_length:
            name, inside = w.windows(k)
            hit = np.concatenate([[0], np.cumsum(inside & links.may_hold(known, words.signed(name)))])
            by_length[k] = name, hit
        name, hit = by_length[k]
        count = size - k + 1
        if n < size:
            continue
        enough = hit[count : n - k + 2] - hit[: n - size + 1] >= SIMILARITY * count - 1e-9
        start = np.flatnonzero(enough & (np.arange(n - size + 1) + size <= last[: n - size + 1]))
        if not len(start):
            continue
        # windows near one another share their running sums
        for run in np.split(start, np.flatnonzero(np.diff(start) > size) + 1):
            for piece in np.array_split(run, len(run) // 4096 + 1):
                a, b = piece[0], piece[-1] + count
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(votes(name[a:b]), axis=0, dtype=np.int32)])
                yield size, piece, packed(sums[piece - a + count] - sums[piece - a])


def block_entries(items: DataFrame) -> DataFrame:
    """item_id, size, block, value, fp0, fp1: every value within BLOCK_RADIUS of each block of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                fp = np.stack([part.column("fp0").to_numpy(), part.column("fp1").to_numpy()], axis=1)
                value = np.concatenate([(fp[:, [h]] >> np.arange(0, 64, BLOCK_BITS)) & (1 << BLOCK_BITS) - 1 for h in (0, 1)], axis=1)
                entries = (value[:, :, None] ^ MASKS).ravel()
                rows = pa.array(np.repeat(np.arange(part.num_rows), BLOCKS * len(MASKS)))
                block = np.tile(np.repeat(np.arange(BLOCKS), len(MASKS)), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(rows), part.column("size").take(rows), pa.array(block.astype(np.int32)), pa.array(entries),
                     part.column("fp0").take(rows), part.column("fp1").take(rows)],
                    names=["item_id", "size", "block", "value", "fp0", "fp1"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "size", "fp0", "fp1").mapInArrow(run, f"item_id {kind}, size int, block int, value long, fp0 long, fp1 long")


def similar(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard index of two bags."""
    a, n = np.unique(x, return_counts=True)
    b, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(x) + len(y) - common)


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, doc_key (of the text), item_id, start and size in words, similarity, of every item that a text holds."""
    spark = docs.sparkSession
    prepared = materialise(prepared_items(items), "items")
    sizes = [r[0] for r in prepared.select("size").distinct().orderBy("size").collect()]  # at most the longest item's words
    known = spark.sparkContext.broadcast(links.filter_of(prepared.select(F.explode("shingles").alias("s")), "s"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("doc_key"), "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            w = plain_words(part.column("text"))
            doc = w.document()
            for size, start, fp in window_prints(w, sizes, known.value):
                rows = pa.array(doc[start])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("doc_key").take(rows), pa.array(np.full(len(start), size, np.int32)),
                     pa.array((start - w.bounds[doc[start]]).astype(np.int64)), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy())],
                    names=["doc_id", "doc_key", "size", "start", "fp0", "fp1"],
                )

    found = materialise(texts.mapInArrow(windows, "doc_id long, doc_key long, size int, start long, fp0 long, fp1 long"), "windows")
    per_long = BLOCKS // 2
    blocks = F.array(*[
        F.struct(F.lit(b).alias("block"), F.shiftright(f"w{b // per_long}", b % per_long * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).alias("value")) for b in range(BLOCKS)
    ])
    # windows with one text have one fingerprint: looked up once, however often the text occurs
    prints = found.select("size", F.col("fp0").alias("w0"), F.col("fp1").alias("w1")).distinct()
    asked = prints.select("size", "w0", "w1", F.explode(blocks).alias("b")).select("size", "w0", "w1", "b.block", "b.value")
    distance = F.bit_count(F.col("w0").bitwiseXOR(F.col("fp0"))) + F.bit_count(F.col("w1").bitwiseXOR(F.col("fp1")))
    # the entries are many times the items, which a plan made from the items' size would broadcast
    entries = block_entries(prepared).hint("merge")
    near = asked.join(entries, ["size", "block", "value"]).where(distance <= RADIUS).select("size", F.col("w0").alias("fp0"), F.col("w1").alias("fp1"), "item_id").distinct()
    candidates = materialise(found.join(near, ["size", "fp0", "fp1"]).select("doc_id", "doc_key", "start", "size", "item_id"), "candidates")

    # the texts of the candidates, and of few others, are read once more
    wanted = spark.sparkContext.broadcast(links.filter_of(candidates.select("doc_key").distinct(), "doc_key"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(links.may_hold(wanted.value, b.column("doc_key").to_numpy())))

    contents = texts.select("doc_key", "text").mapInArrow(likely, "doc_key long, text string").dropDuplicates(["doc_key"])
    # bounded by the windows of one text
    listed = candidates.select("doc_key", "start", "size", "item_id").distinct().join(prepared.select("item_id", "shingles"), "item_id")
    listed = listed.groupBy("doc_key").agg(F.collect_list(F.struct("item_id", "start", "size", "shingles")).alias("asked"))
    kind = prepared.schema["item_id"].dataType.simpleString()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            w = plain_words(part.column("text"))
            names: dict[int, np.ndarray] = {}
            rows = []
            for i, key in enumerate(part.column("doc_key").to_pylist()):
                a, best = int(w.bounds[i]), {}
                for q in part.column("asked")[i]:
                    size, start = q["size"].as_py(), q["start"].as_py()
                    k = min(SHINGLE, size)
                    if k not in names:
                        names[k] = w.windows(k)[0]
                    s = similar(words.signed(names[k][a + start : a + start + size - k + 1]), q["shingles"].values.to_numpy())
                    item = q["item_id"].as_py()
                    if s >= SIMILARITY and (s, -start) > best.get(item, (0.0, 0))[:2]:
                        best[item] = (s, -start, size)
                rows += [(key, item, -start, size, s) for item, (s, start, size) in best.items()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), part.schema.field("asked").type.value_type.field("item_id").type, pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_key", "item_id", "start", "size", "similarity"])

    exact = contents.join(listed, "doc_key").select("doc_key", "text", "asked").mapInArrow(
        verified, f"doc_key long, item_id {kind}, start long, size long, similarity double"
    )
    having = candidates.select("doc_id", "doc_key", "item_id").distinct()
    return having.join(exact, ["doc_key", "item_id"]).select("doc_id", "doc_key", "item_id", "start", "size", "similarity")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item."""
    held = matches(docs.select("doc_id", "text"), items).select("doc_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("doc_key"))
    return rows.join(held, "doc_key", "left_anti").select("row.*")
