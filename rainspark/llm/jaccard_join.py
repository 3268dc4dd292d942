"""Jaccard join of documents on their word shingles, by universe partition and pigeonhole.

The universe of shingles is partitioned by hash into cells, more for each size band than the largest
symmetric difference that two linked sets of the band can have. So two linked sets
agree in a cell, or differ by one shingle in a pair of cells merged into one segment, which takes
two differences to miss. A band indexes either every cell (exact segment subsets), or merged
pairs with their one-deletion neighbourhoods; which one is chosen by cost: the pairs that exact cells would
bring together, estimated on the first cell of every set, against the added entries. A set that occupies more cells than
any linked set can differ in leaves out its empty cells: one of the occupied ones agrees. Pairs in a
common bucket pass a test on parity bits, about as many as a set has shingles, and are verified on the whole sets.

Equal sets are one item from the start. The members of a bucket are tested as links.connect says.

Cases: null, empty and blank texts have the empty set and are linked with nothing; a text shorter than a
shingle is one shingle; rows that share a doc_id count as one document (linked with each other if
their sets are not empty); a null doc_id is not compared and has no component; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainspark.llm import links, words
from rainspark.session import materialise

#: Sizes in a band differ by this factor at most. Least parity words of a set, a filter before verification.
GROWTH, PARITY = 1.5, 4
#: Bits of the table of shared keys, of a fixed size; it only spares shuffle.
KEY_BITS = 1 << 26
ALL = (1 << 64) - 1


@functools.cache
def lowest(band: int) -> int:
    return int(np.ceil(GROWTH**band - 1e-9))


@functools.cache
def groups_of(n: int, percent: int) -> tuple[int, ...]:
    """Bands whose smaller sets a set of n shingles can be linked with: its own and some below."""
    band = 0
    while lowest(band + 1) <= n:
        band += 1
    out = []
    for g in range(band, -1, -1):
        largest = lowest(g + 1) - 1
        if largest < lowest(g):
            continue
        if g < band and 100 * largest < percent * n:
            break
        out.append(g)
    return tuple(out)


def furthest(n: int, other: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (n + other) // (100 + percent)


@functools.cache
def cells_of(group: int, percent: int) -> int:
    """Cells for linked sets whose smaller one is in the band: more than they can differ in, and so many that about as
    many are occupied."""
    small = lowest(group + 1) - 1
    needed = furthest(small, 100 * small // percent, percent) + 1
    cells = needed
    while cells * (1 - np.exp(-small / cells)) < needed and 4 * cells < 5 * needed:
        cells += 1
    return cells


def indexed(occupied: np.ndarray, n: int, group: int, percent: int) -> np.ndarray:
    """Cells that a set of n shingles indexes in a group. If it occupies no more cells than it can differ in from a linked
    set, that set may agree with it in empty cells alone, and both then index them."""
    largest = lowest(group + 1) - 1
    most = furthest(n, 100 * n // percent if n <= largest else largest, percent)
    return np.flatnonzero(occupied) if np.count_nonzero(occupied) > most else np.arange(len(occupied))


def shingle_sets(texts: pa.Array, n: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words.words_of(texts, lower)
    counts = w.counts()
    hashes, inside = w.windows(n)
    out = []
    short = {k: w.windows(k)[0] for k in set(counts[(counts > 0) & (counts < n)].tolist())}
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        k = int(b - a)
        out.append(np.unique(hashes[a : b - n + 1]) if k >= n else short[k][a : a + 1] if k else hashes[:0])
    return out


def cell_sums(values: np.ndarray, group: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each shingle, the shingles' codes, and the sum of the codes in each cell."""
    h = words.mix(values + np.uint64((group + 1) * 0xC2B2AE3D27D4EB4F & ALL))
    cell = ((h >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    code = words.mix(h ^ np.uint64(0x165667B19E3779F9))
    total = np.zeros(cells, dtype=np.uint64)
    np.add.at(total, cell, code)
    return cell, code, total


def keys(total: np.ndarray, cell: np.ndarray, group: int, merged: bool) -> np.ndarray:
    place = (cell.astype(np.uint64) * np.uint64(2) + np.uint64(merged)) * np.uint64(0x9FB21C651E98DF25) + np.uint64(group * 0xD6E8FEB86659FD93 & ALL)
    return words.mix(total ^ words.mix(place))


def signatures(values: np.ndarray, percent: int, merged_groups: frozenset[int]) -> np.ndarray:
    """Keys of the buckets of a set in all its groups."""
    found = []
    for g in groups_of(len(values), percent):
        m = cells_of(g, percent)
        cell, code, total = cell_sums(values, g, m)
        if g in merged_groups and m > 1:
            pairs = m // 2
            both = total[: 2 * pairs : 2] + total[1 : 2 * pairs : 2]
            found.append(keys(both, np.arange(pairs), g, True))
            mine = cell < 2 * pairs
            found.append(keys(both[cell[mine] // 2] - code[mine], cell[mine] // 2, g, True))
            rest = np.arange(2 * pairs, m)
        else:
            rest = indexed(np.bincount(cell, minlength=m) > 0, len(values), g, percent)
        found.append(keys(total[rest], rest, g, False))
    return np.concatenate(found)


def name_of(values: np.ndarray) -> np.uint64:
    """A hash of the set."""
    return words.mix(np.array([words.mix(values ^ np.uint64(0x27D4EB2F165667C5)).sum(dtype=np.uint64) + np.uint64(len(values))], dtype=np.uint64))[0]


def parity(values: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles falls on it. The number of words is a power of two, at least a bit for
    each shingle, so that a longer row of words can be folded onto a shorter one."""
    bits = 64 * PARITY
    while bits < len(values):
        bits *= 2
    code = words.mix(values ^ np.uint64(0x27D4EB2F165667C5))
    odd = np.bincount((code >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(x: str, y: str) -> Column:
    """Bits in which the parity words of two sets differ: never more than the shingles in which the sets do."""
    words_ = F.least(F.size(x), F.size(y))

    def word(side: str, i: Column) -> Column:
        folded = F.get(side, i).bitwiseXOR(F.get(side, i + words_))
        return F.when(F.size(side) > words_, folded).otherwise(F.get(side, i))

    return F.aggregate(F.sequence(F.lit(0), words_ - 1), F.lit(0), lambda n, i: n + F.bit_count(word(x, i).bitwiseXOR(word(y, i))))


def set_table(docs: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """doc_id, n, item, parity words, and the first bucket key of each group that indexes its first cell, for every row."""

    def first_key(s: np.ndarray, group: int) -> int | None:
        m = cells_of(group, percent)
        cell, _, total = cell_sums(s, group, m)
        if 0 not in indexed(np.bincount(cell, minlength=m) > 0, len(s), group, percent)[:1]:
            return None
        return int(words.signed(keys(total[:1], np.zeros(1, np.int64), group, False))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            sets = shingle_sets(part.column("text"), n, lower)
            groups = [list(groups_of(len(s), percent)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(words.signed(np.array([name_of(s) for s in sets], dtype=np.uint64))),
                    pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                    pa.array(groups, pa.list_(pa.int32())),
                    pa.array([[first_key(s, g) for g in own] for s, own in zip(sets, groups)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "item", "odd", "groups", "first_keys"],
            )

    schema = "doc_id long, n long, item long, odd array<long>, groups array<int>, first_keys array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def allocation(sets: DataFrame, percent: int) -> frozenset[int]:
    """Groups that index merged cells with one-deletion neighbourhoods, by cost. One row per group comes to
    the driver: as many as the logarithm of the longest text."""
    first = sets.where("n > 0").select("item", "n", F.explode(F.arrays_zip("groups", "first_keys")).alias("z")).select("item", "n", "z.groups", "z.first_keys").distinct()
    buckets = first.groupBy("groups", "first_keys").agg(F.count("first_keys").alias("c"), F.sum("n").alias("n"))
    costs = buckets.groupBy("groups").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("n").alias("entries")).collect()
    return frozenset(r["groups"] for r in costs if r["pairs"] * cells_of(r["groups"], percent) > r["entries"])


def bucket_members(docs: DataFrame, n: int, percent: int, lower: bool, merged: frozenset[int]) -> DataFrame:
    """key, item of every bucket that holds different sets."""

    def entries(wanted=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in words.slices(batches):
                # copies in this part count once
                sets = {int(name_of(s)): s for s in shingle_sets(part.column("text"), n, lower) if len(s)}
                found = [words.signed(signatures(s, percent, merged)) for s in sets.values()]
                if wanted is not None:
                    found = [k[links.may_hold(wanted.value, k, KEY_BITS)] for k in found]
                if found:
                    items = np.repeat(np.array(list(sets), dtype=np.uint64), [len(k) for k in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(words.signed(items))], names=["key", "item"])

        return docs.where("doc_id is not null").select("text").mapInArrow(run, "key long, item long")

    shared = entries().groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low < high").select("key")
    shared = materialise(shared, "keys")
    # the second time only entries whose key may be shared leave their task; the join decides
    likely = docs.sparkSession.sparkContext.broadcast(links.filter_of(shared, "key", KEY_BITS))
    return entries(likely).join(shared, "key").distinct()


def most_different(x: str, y: str, percent: int) -> Column:
    """Largest symmetric difference of linked sets of these sizes."""
    return F.floor((100 - percent) * (F.col(f"{x}n") + F.col(f"{y}n")) / (100 + percent) + 1e-9)


def components(docs: DataFrame, n: int, percent: int, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text): documents are linked when
    100 * intersection >= percent * union of their sets of n-word shingles."""
    spark = docs.sparkSession
    sets = materialise(set_table(docs, n, percent, lower), "sets")
    named = sets.where("n > 0 and doc_id is not null")
    items = materialise(
        named.groupBy("item").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.max("n").alias("n"), F.any_value("odd").alias("odd"))
        .withColumn("rank", F.shiftleft(F.least("copies", F.lit((1 << 22) - 1)), 40) + F.col("item").bitwiseAND((1 << 40) - 1)),
        "items",
    )

    def possible(x: str, y: str) -> Column:
        sizes = 100 * F.least(F.col(f"{x}n"), F.col(f"{y}n")) >= percent * F.greatest(F.col(f"{x}n"), F.col(f"{y}n"))
        return F.when(sizes, differing(f"{x}odd", f"{y}odd") <= most_different(x, y, percent)).otherwise(False)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.col("a").alias("item")).unionByName(pairs.select(F.col("b").alias("item"))).distinct()
        wanted = materialise(wanted.join(items.select("item", "doc"), "item"), "wanted")
        likely = spark.sparkContext.broadcast(links.filter_of(wanted, "doc"))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in words.slices(iter([b.filter(pa.array(links.may_hold(likely.value, b.column("doc_id").to_numpy())))])):
                    found = shingle_sets(part.column("text"), n, lower)
                    name = words.signed(np.array([name_of(s) for s in found], dtype=np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([s.tobytes() for s in found], pa.binary())], names=["item", "shingles"])

        texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        whole_sets = texts.mapInArrow(whole, "item long, shingles binary").join(wanted.select("item"), "item", "left_semi")
        whole_sets = materialise(whole_sets.dropDuplicates(["item"]), "shingles")

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in words.slices(batches, "x"):
                kept = []
                for x, y in zip(part.column("x"), part.column("y")):
                    p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                    both = len(p) + len(q)
                    common = both - len(np.unique(np.concatenate([p, q])))
                    kept.append(100 * common >= percent * (both - common))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

        x = whole_sets.select(F.col("item").alias("a"), F.col("shingles").alias("x"))
        y = whole_sets.select(F.col("item").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(linked, "a long, b long")

    members = bucket_members(docs, n, percent, lower, allocation(named, percent))
    found = links.connect(members, items.select("item", "rank", "n", "odd"), possible, verify)
    # rows of one doc_id with different texts are one document
    several = named.groupBy("doc_id").agg(F.min("item").alias("a"), F.max("item").alias("b")).where("a < b")
    several = named.join(several.select("doc_id", "a"), "doc_id").where("item <> a").select("a", F.col("item").alias("b"))
    if not several.isEmpty():
        found = links.components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(several))
    joined = items.select("item", "doc").join(found.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    least = joined.groupBy("component").agg(F.min("doc").alias("least"))
    names = joined.join(least, "component").select("item", "least")
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "item").join(names, "item", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("least"))).otherwise(F.col("doc_id")).alias("component_id")
    )
