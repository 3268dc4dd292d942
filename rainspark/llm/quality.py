"""Quality rules: an isolation forest over rule statistics.

The rule statistics of every whole text are computed over all documents. As the method has it, each of the
TREES trees of the forest is grown on LEAF_SAMPLE rows, with a random feature and a random threshold at every
split; the trees draw them from the good ones among SAMPLE labelled rows. Splits are drawn from the box that all labelled
rows fill, so that what no good row shows is cut off in an empty leaf after few steps. A text that
random splits isolate so soon is unlike good text. The threshold on its score is calibrated on all labelled
rows: the highest share of bad rows caught less PRICE times the share of good rows lost.

Cases: a null or empty text has no words and fails the base rule; without labelled rows there is no
verdict beyond the base rule; repeated rows are judged one by one; labels that disagree about a
doc_id count as bad; rows whose doc_id is null are judged, but have no label; empty tables and
other columns are no matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from rainspark.llm import words
from rainspark.session import materialise

SAMPLE, TREES, LEAF_SAMPLE, PRICE, SEED = 20_000, 150, 256, 20.0, 11
SLICES = 4096  # parts of the range of scores that are counted apart
# fixed values of the base rules
SYMBOLS, WINDOW, LEAST_WORDS = b"#*$%&|<>", 8, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_marks", "n_distinct", "longest_word", "n_top_word", "n_high", "n_lines")
STATISTICS = COUNTS + MORE
SCHEMA = ", ".join(f"{c} long" for c in STATISTICS)

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[list(b"!?.,;:-\"'()[]{}/\\@^_~=+`")] = 1


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines that equal an earlier line, and all lines, among those with a word."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row per text, one column per name of STATISTICS."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    w = words.words_of(texts)
    n_docs, n, n_words = len(texts), len(w.hashes), w.counts()
    doc = w.document()
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)

    def per_document(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[ends] - total[ends - lengths]

    first_byte = (w.data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": per_document((first_byte & ~words.SPACES[w.data]).astype(np.int64))}
    out["n_symbols"] = per_document(_SYMBOL[w.data])
    lines = np.array([duplicate_lines(t) for t in texts.to_pylist()], dtype=np.int64).reshape(n_docs, 2)
    out["n_dup_lines"], out["n_lines"] = lines[:, 0], lines[:, 1]

    # equal windows of one text have equal keys
    salt = words.mix(doc.astype(np.uint64))
    window, inside = w.windows(WINDOW)
    at = np.flatnonzero(inside)
    _, key, count = np.unique(window[at] ^ salt[at], return_inverse=True, return_counts=True)
    edge = np.zeros(n + 1, dtype=np.int64)
    repeated = at[count[key] > 1]
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    covered = (np.cumsum(edge[:n]) > 0).astype(np.int64)
    out["n_repeat_words"] = np.bincount(doc, covered, n_docs).astype(np.int64)

    for name, table in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = per_document(table[w.data])
    out["n_high"] = per_document((first_byte & (w.data >= 0x80)).astype(np.int64))
    _, at, count = np.unique(w.hashes ^ salt, return_index=True, return_counts=True)
    out["n_distinct"] = np.bincount(doc[at], minlength=n_docs)
    out["n_top_word"], out["longest_word"] = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    np.maximum.at(out["n_top_word"], doc[at], count)
    np.maximum.at(out["longest_word"], doc, w.ends - w.starts)
    return np.stack([out[c].astype(np.int64) for c in STATISTICS], axis=1)


def base_failed(s: np.ndarray) -> np.ndarray:
    n_words, repeated = s[:, 0], s[:, STATISTICS.index("n_repeat_words")]
    return (n_words < LEAST_WORDS) | (100 * repeated > 30 * n_words)


def features(s: np.ndarray) -> np.ndarray:
    """What the forest sees: shares and means, and the few lengths on a log scale."""
    v = {c: s[:, i].astype(np.float64) for i, c in enumerate(STATISTICS)}
    n, chars, lines = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1), np.maximum(v["n_lines"], 1)
    shares = [
        v["n_symbols"] / chars, v["n_dup_lines"] / lines, v["n_repeat_words"] / n, v["n_upper"] / chars, v["n_digits"] / chars,
        v["n_marks"] / chars, v["n_top_word"] / n,
    ]
    logs = [v["word_chars"] / n, v["longest_word"], v["n_symbols"] / n]
    return np.stack([*map(np.sqrt, shares), *map(np.log1p, logs), np.log1p(v["n_distinct"]) / np.log1p(n)], axis=1)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as rows of arrays; a node without a feature (-1) is a leaf with its path length."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int

    @staticmethod
    def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, size: int = LEAF_SAMPLE, seed: int = SEED) -> Forest:
        """x: the rows to grow on; box: the lowest and highest value of each feature."""
        rng = np.random.Generator(np.random.PCG64(seed))
        size = min(size, len(x))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        grown = []
        for _ in range(trees):
            nodes: list[list[float]] = []

            def split(rows: np.ndarray, low: np.ndarray, high: np.ndarray, level: int, nodes: list = nodes) -> int:
                me = len(nodes)
                nodes.append([-1, 0.0, 0, level + float(mean_path(len(rows)))])
                wide = np.flatnonzero(high > low)
                if level < depth and len(rows) > 1 and len(wide):
                    f = rng.choice(wide)
                    cut = rng.uniform(low[f], high[f])
                    left = rows[:, f] <= cut
                    below, above = high.copy(), low.copy()
                    below[f] = above[f] = cut
                    nodes[me][:3] = [f, cut, split(rows[left], low, below, level + 1)]
                    right[me] = split(rows[~left], above, high, level + 1)
                return me

            right: dict[int, int] = {}
            split(x[rng.choice(len(x), size, replace=False)], *box, 0)
            grown.append((nodes, right))
        width = max(len(n) for n, _ in grown)
        feature, threshold = np.full((trees, width), -1), np.zeros((trees, width))
        child, path = np.zeros((trees, width, 2), dtype=np.int64), np.zeros((trees, width))
        for t, (nodes, right) in enumerate(grown):
            for i, (f, cut, a, length) in enumerate(nodes):
                feature[t, i], threshold[t, i], path[t, i] = f, cut, length
                child[t, i] = (a, right.get(i, i)) if f >= 0 else (i, i)
        return Forest(feature, threshold, child, path / max(float(mean_path(size)), 1.0), depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for what is isolated at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, child, path in zip(self.feature, self.threshold, self.child, self.path):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = child[node, (x[rows, f] > threshold[node]).astype(np.int64)]
            total += path[node]
        return 2.0 ** -(total / max(len(self.feature), 1))


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    def kept(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verdict and score of rows of statistics."""
        failed = base_failed(s)
        score = self.forest.score(features(s)) if self.forest else np.zeros(len(s))
        return ~failed & (score <= self.threshold), score


def calibrate(good: np.ndarray, bad: np.ndarray, price: float = PRICE) -> float:
    """Highest score that is kept."""
    cuts = np.unique(np.concatenate([good, bad]))
    lost = 1 - np.searchsorted(np.sort(good), cuts, side="right") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), cuts, side="right") / max(len(bad), 1)
    best = int(np.argmax(caught - price * lost))
    above = cuts[best + 1] if best + 1 < len(cuts) else np.inf
    return float((cuts[best] + above) / 2) if np.isfinite(above) else np.inf


def threshold(scores: DataFrame, price: float = PRICE) -> float:
    """`calibrate` over all rows of scores(good, score).

    Rows are counted by score. Counts up to a score are running sums within slices of the scores, on top of the sums of
    the slices below; only those sums come to the driver.
    """
    good = F.col("good").cast("long")
    counts = materialise(scores.groupBy("score").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad")), "scores")
    counts = counts.withColumn("slice", F.floor(F.col("score") * SLICES))
    sums = sorted(tuple(r) for r in counts.groupBy("slice").agg(F.sum("good"), F.sum("bad")).collect())
    below, n_good, n_bad = [], 0, 0
    for at, more_good, more_bad in sums:
        below.append((at, n_good, n_bad))
        n_good, n_bad = n_good + more_good, n_bad + more_bad
    # an Arrow table reaches the executors without Python workers of its own, which rows of a list would start
    sums_below = pa.table(dict(zip(("slice", "good_below", "bad_below"), (pa.array(c, pa.int64()) for c in zip(*below)))))
    started = counts.join(scores.sparkSession.createDataFrame(sums_below), "slice")
    upto = W.partitionBy("slice").orderBy("score")
    lost = F.lit(1.0) - (F.sum("good").over(upto) + F.col("good_below")) / F.lit(float(n_good))
    caught = F.lit(1.0) - (F.sum("bad").over(upto) + F.col("bad_below")) / F.lit(float(max(n_bad, 1)))
    best = started.select("score", (caught - F.lit(price) * lost).alias("gain")).agg(F.max(F.struct("gain", (-F.col("score")).alias("s"))))
    cut = -best.first()[0]["s"]
    above = counts.where(F.col("score") > cut).agg(F.min("score")).first()[0]
    return np.inf if above is None else (cut + above) / 2


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in STATISTICS], axis=1)


def feature_box(labelled: DataFrame) -> np.ndarray:
    """Lowest and highest value of each feature over all rows that pass the base rule."""

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _rows(b)
            x = features(s[~base_failed(s)])
            if len(x):
                yield pa.RecordBatch.from_arrays([*map(pa.array, (np.arange(x.shape[1]), x.min(axis=0), x.max(axis=0)))], names=["feature", "low", "high"])

    found = labelled.select(*STATISTICS).mapInArrow(extent, "feature long, low double, high double")
    sides = sorted(tuple(r) for r in found.groupBy("feature").agg(F.min("low"), F.max("high")).collect())
    return np.array([side[1:] for side in sides]).T


def scored(labelled: DataFrame, forest: Forest) -> DataFrame:
    """good, score of all rows that pass the base rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, quality = _rows(b), b.column("_quality").to_numpy()
            open_ = ~base_failed(s)
            yield pa.RecordBatch.from_arrays([pa.array(quality[open_] > 0), pa.array(forest.score(features(s[open_])))], names=["good", "score"])

    return labelled.select("_quality", *STATISTICS).mapInArrow(run, "good boolean, score double")


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from stats(doc_id, *STATISTICS) and labels(doc_id, quality).

    Box and threshold are those of all labelled rows. Trees draw their few rows from the good ones of the first
    `sample` labelled rows by a hash of doc_id. The number of labelled doc_ids gives a cutoff of the hash below which a
    quarter more than `sample` of them lie, so only about that many rows are ordered, however many tasks there are.
    """
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    labelled = materialise(stats.select("doc_id", *STATISTICS).join(judged, "doc_id"), "labelled")
    n = labelled.select("doc_id").distinct().count()
    near = F.lit(True)
    if n > 1.25 * sample:
        near = F.xxhash64("doc_id") <= int((1.25 * sample / n) * 2**64) - 2**63
    rows = (
        labelled.where(near)
        .orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS)
        .limit(sample)
        .select("_quality", *STATISTICS)
        .toPandas()
    )
    s, quality = rows[list(STATISTICS)].to_numpy(dtype=np.int64).reshape(len(rows), len(STATISTICS)), rows["_quality"].to_numpy()
    grown_on = s[~base_failed(s) & (quality > 0)]
    if not len(grown_on):
        return Model(None, np.inf)
    forest = Forest.grow(features(grown_on), feature_box(labelled))
    return Model(forest, threshold(scored(labelled, forest)))


def over_batches(fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            yield fn(part, statistics(part.column(part.schema.get_field_index("text"))))

    return run


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row of docs(doc_id, text)."""

    def row(part: pa.RecordBatch, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, s.T)], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(row), f"doc_id {kind}, {SCHEMA}")


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """stats with base_failed, kept and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _rows(b)
            kept, score = model.kept(s)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (base_failed(s), kept, score))], names=[*b.schema.names, "base_failed", "kept", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, {SCHEMA}, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns, in the pass that reads them."""

    def kept(part: pa.RecordBatch, s: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(model.kept(s)[0]))

    return docs.mapInArrow(over_batches(kept), docs.schema)
