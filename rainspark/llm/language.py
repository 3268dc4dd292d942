"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, by the forward algorithm; a text's score is
the sum of its words' log-probabilities. The piece probabilities are learned by expectation
maximisation from the words of all training rows: the expected count of a piece is summed over all
segmentations, by forward and backward. Bytes that are no piece have one small fixed probability.

Words are runs of letters, in lower case; a word starts with the vocabulary's word mark.

Cases: `und` with score 0 for null texts, texts without letters, and where nothing was learned; ties go
to the language that sorts first; rows without a language are not learned from; repeated rows count
as often as they occur; other columns are ignored. Words of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from rainspark.llm import words
from rainspark.session import materialise

NONE = "und"
#: Rounds of expectation maximisation, probability of a byte that is no piece, count added to every piece.
ROUNDS, UNKNOWN, PRIOR = 2, 1e-7, 0.1
MEMORY = 200_000   # distinct words whose log-probabilities a task remembers
MARK = b" "


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


class Pieces:
    """The vocabulary's pieces that can occur in a lower-case word, found by hashes of substrings."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        found = set()
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i)
            body = piece.removeprefix("▁")
            if piece != "▁" and body.isalpha() and body == body.lower():
                found.add((MARK if piece != body else b"") + body.encode())
        self.pieces = sorted(found | {MARK})
        self.longest = max(map(len, self.pieces))
        keys = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    def _hash(self, piece: bytes) -> int:
        data = np.frombuffer(piece, dtype=np.uint8)
        return int(self._substring_hashes(data, np.array([0]), len(piece))[0])

    @staticmethod
    def _prefix(data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(words.BYTE_CODE[data] * words.powers(words.BASE, len(data)), out=out[1:])
        return out

    def _substring_hashes(self, data: np.ndarray, starts: np.ndarray, length: int, prefix: np.ndarray | None = None, inverse: np.ndarray | None = None) -> np.ndarray:
        prefix = self._prefix(data) if prefix is None else prefix
        inverse = words.powers(words.BASE_INVERSE, len(data)) if inverse is None else inverse
        return words.mix((prefix[starts + length] - prefix[starts]) * inverse[starts] + np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    def lattice(self, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Piece of every substring of words of one length in bytes: [word, position, piece length - 1], -1 for none.
        A byte by itself that is no piece gets the number after the last piece."""
        span = min(self.longest, length)
        out = np.full((len(starts), length, span), -1, dtype=np.int32)
        prefix, inverse = self._prefix(data), words.powers(words.BASE_INVERSE, len(data))
        for n in range(1, span + 1):
            at = starts[:, None] + np.arange(length - n + 1)[None, :]
            h = self._substring_hashes(data, at.ravel(), n, prefix, inverse)
            hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
            right = self.keys[place] == h[hit]
            flat = np.full(len(h), -1, dtype=np.int32)
            flat[hit[right]] = self.ids[place[right]]
            out[:, : length - n + 1, n - 1] = flat.reshape(at.shape)
        out[:, :, 0] = np.where(out[:, :, 0] < 0, len(self.pieces), out[:, :, 0])
        return out


def forward(lattice: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each word under each column of p[piece, language], summed over its segmentations,
    and the scaled forward sums [position, word, language]. The last row of p but one is an unknown byte, the last is 0."""
    n, length, span = lattice.shape
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1
    log = np.zeros((n, p.shape[1]))
    for t in range(1, length + 1):
        for k in range(1, min(span, t) + 1):
            alpha[t] += alpha[t - k] * p[lattice[:, t - k, k - 1]]
        # rescale what later positions still use
        scale = alpha[t].copy()
        log += np.log(scale)
        alpha[max(0, t - span + 1) : t + 1] /= scale
    return log, alpha


def by_length(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of words of one length in bytes, in runs of a bounded size."""
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(rows):
            length = int(lengths[rows[0]])
            step = max(1, 400_000 // (length + 1))
            for i in range(0, len(rows), step):
                yield length, rows[i : i + step]


def marked(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with the word mark before each."""
    n = len(offsets) - 1
    out = np.full(len(values) + n, MARK[0], dtype=np.uint8)
    letters = np.ones(len(out), dtype=bool)
    letters[offsets[:-1] + np.arange(n)] = False
    out[letters] = values
    return out, offsets + np.arange(n + 1)


def string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def unique_words(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One position of each distinct word, the distinct word of each position, and their 64-bit hashes in order."""
    prefix = Pieces._prefix(values)
    starts, lengths = offsets[:-1], np.diff(offsets)
    inverse = words.powers(words.BASE_INVERSE, len(values) + 1)
    h = words.mix((prefix[offsets[1:]] - prefix[starts]) * inverse[starts] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
    return first, back, distinct


class Known:
    """Log-probabilities of words that a task has met, by hash; forgotten when there are more than `MEMORY`."""

    def __init__(self, languages: int):
        self.hashes, self.log = np.zeros(0, dtype=np.uint64), np.zeros((0, languages))

    def look_up(self, hashes: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Rows of the distinct `hashes`, in order; `compute` gives those of the places that are new."""
        at = np.searchsorted(self.hashes, hashes)
        old = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        old[inside] = self.hashes[at[inside]] == hashes[inside]
        out = np.empty((len(hashes), self.log.shape[1]))
        out[old] = self.log[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            out[new] = compute(new)
            if len(self.hashes) + len(new) > MEMORY:
                self.hashes, self.log = hashes[:MEMORY], out[:MEMORY].copy()
            else:
                self.log = np.insert(self.log, at[new], out[new], axis=0)
                self.hashes = np.insert(self.hashes, at[new], hashes[new])
        return out


@dataclass
class Model:
    languages: list[str]
    #: [piece, language], then an unknown byte, then 0
    p: np.ndarray

    def log_probability(self, pieces: Pieces, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, bounds = marked(values, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for length, rows in by_length(data, bounds):
            out[rows] = forward(pieces.lattice(data, bounds[rows], length), self.p)[0]
        return out


def uniform(pieces: Pieces, languages: list[str]) -> Model:
    return model_of(pieces, languages, np.zeros((len(pieces.pieces), len(languages))))


def model_of(pieces: Pieces, languages: list[str], counts: np.ndarray) -> Model:
    p = (counts + PRIOR) / (counts.sum(axis=0) + PRIOR * len(counts))
    return Model(languages, np.concatenate([p, np.full((1, len(languages)), UNKNOWN), np.zeros((1, len(languages)))]))


def expected_counts(pieces: Pieces, model: Model, language: int, values: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in weighted words of one language."""
    data, bounds = marked(values, offsets)
    p = model.p[:, [language]]
    total = np.zeros(len(p))
    for length, rows in by_length(data, bounds):
        lattice = pieces.lattice(data, bounds[rows], length)
        span = lattice.shape[2]
        # backward sums in the scale that the forward sums end with
        beta = np.zeros((length + 1, len(rows)))
        beta[length] = 1
        scale = np.ones((length + 1, len(rows)))
        a = np.zeros_like(beta)
        a[0] = 1
        for t in range(1, length + 1):
            for k in range(1, min(span, t) + 1):
                back = np.prod(scale[t - k + 1 : t], axis=0)
                a[t] += a[t - k] / back * p[lattice[:, t - k, k - 1], 0]
            scale[t] = a[t]
            a[t] = 1
        for t in range(length, 0, -1):
            for k in range(1, min(span, t) + 1):
                within = np.prod(scale[t - k + 1 : t + 1], axis=0)
                use = p[lattice[:, t - k, k - 1], 0] * beta[t] / within
                beta[t - k] += use
                total += np.bincount(lattice[:, t - k, k - 1] % len(p), use * weight[rows], len(p))
    return total[: len(pieces.pieces)]


_pieces: dict[str, Pieces] = {}


def pieces_of(model_file: str) -> Pieces:
    if model_file not in _pieces:
        _pieces[model_file] = Pieces(model_file)
    return _pieces[model_file]


def learn(training: DataFrame, model_file: str, rounds: int = ROUNDS) -> Model:
    """The model of training(text, lang). Counts of words cover all rows; only piece counts, languages x
    pieces of the fixed vocabulary at most, come to the driver."""
    spark = training.sparkSession
    counted = materialise(
        training.where("lang is not null")
        .select("lang", F.explode(words_column(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n")),
        "words",
    )
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    pieces = pieces_of(model_file)
    model = uniform(pieces, languages)
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, m = pieces_of(model_file), shared.value
            total = np.zeros((len(m.languages), len(own.pieces)))
            for b in batches:
                values, offsets = string_buffers(b.column("word"))
                weight, lang = b.column("n").to_numpy(), np.array(b.column("lang").to_pylist(), dtype=object)
                for i, name in enumerate(m.languages):
                    rows = np.flatnonzero(lang == name)
                    if len(rows):
                        v, o = string_buffers(b.column("word").take(pa.array(rows)))
                        total[i] += expected_counts(own, m, i, v, o, weight[rows])
            i, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[i, piece])], names=["i", "piece", "n"])

        counts = np.zeros((len(pieces.pieces), len(languages)))
        summed = counted.mapInArrow(count, "i int, piece int, n double").groupBy("i", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts[summed["piece"].to_numpy(), summed["i"].to_numpy()] = summed["n"].to_numpy()
        # the same model whatever order the tasks' sums came in
        model = model_of(pieces, languages, counts.round(6))
    return model


def predict(docs: DataFrame, model: Model, model_file: str) -> DataFrame:
    """doc_id, lang_pred and score, the posterior of that language, of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = pieces_of(model_file), shared.value
        known = Known(len(m.languages))
        for batch in batches:
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            part = np.cumsum(sizes) // 500_000
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for a, b in zip(first, [*first[1:], batch.num_rows]):
                rows = batch.slice(a, b - a)
                lists = rows.column("words")
                bounds = lists.offsets.to_numpy()
                values, offsets = string_buffers(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
                n = np.diff(bounds)
                total = np.zeros((len(n), len(m.languages)))
                if len(offsets) > 1 and m.languages:
                    whole = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
                    distinct, back, hashes = unique_words(values, offsets)

                    def compute(new: np.ndarray, whole=whole, distinct=distinct) -> np.ndarray:
                        return m.log_probability(own, *string_buffers(whole.take(pa.array(distinct[new]))))

                    log = known.look_up(hashes, compute)
                    doc = np.repeat(np.arange(len(n)), n)
                    for i in range(len(m.languages)):
                        total[:, i] = np.bincount(doc, log[back, i], len(n))
                names, score = [NONE] * len(n), np.zeros(len(n))
                if m.languages:
                    best = total.argmax(axis=1)
                    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [m.languages[j] if k else NONE for j, k in zip(best, n)]
                    score = np.where(n > 0, posterior, 0.0)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", words_column(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    return found.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
