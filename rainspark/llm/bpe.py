"""Byte-level BPE encoding and decoding with a public vocabulary.

Encoding: the text is cut at the added tokens, then into pieces by the vocabulary's pattern. The
symbols of a piece stand in a doubly linked list; a priority queue holds (rank, position) of the
pairs that can merge. The lowest rank merges first, the leftmost among equals; an entry whose pair
has changed since it was pushed is stale and is skipped. Decoding concatenates the vocabulary's
strings and reads the bytes as UTF-8, with U+FFFD for what is none.

Cases: a null text is empty and has no ids; empty tables, repeated rows and other columns are
carried through; a piece of any length costs n log n.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rainspark.llm import words

# fixed values: the pattern of this kind of vocabulary, with the library's meaning of white space
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces kept during a task, and the longest piece that is kept.
KEPT_PIECES, KEPT_LENGTH = 400_000, 48


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = itertools.count(256)
    return {chr(b if b in printable else next(free)): b for b in range(256)}


class Bpe:
    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of_symbol = byte_symbols()
        self.first = [0] * 256
        for symbol, byte in of_symbol.items():
            self.first[byte] = vocab[symbol]
        #: by left id: right id -> rank; and the merged symbol's id by rank
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[vocab[a]][vocab[b]] = rank
            self.merged.append(vocab[a + b])
        strings = {i: bytes(of_symbol[c] for c in s) for s, i in vocab.items() if s not in self.added}
        strings |= {i: s.encode() for s, i in self.added.items()}
        self.strings = Strings([strings.get(i, b"") for i in range(max(strings) + 1)])
        self.decimals = Strings([b"%d," % i for i in range(max(strings) + 1)])
        self.pattern = regex.compile(PIECES)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: two generations of a task's frequent pieces
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        symbols = list(map(self.first.__getitem__, piece))
        ranks, merged, n = self.ranks, self.merged, len(piece)
        # the rank of each symbol with its right neighbour, None where they do not merge
        pair = [ranks[a].get(b) for a, b in zip(symbols, symbols[1:])]
        queue = [rank * n + i for i, rank in enumerate(pair) if rank is not None]
        if not queue:
            return tuple(symbols)
        pair.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            new = symbols[i] = merged[rank]
            symbols[j], pair[j] = -1, None
            if k < n:
                before[k] = i
                pair[i] = found = ranks[new].get(symbols[k])
                if found is not None:
                    heapq.heappush(queue, found * n + i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = found = ranks[symbols[h]].get(new)
                if found is not None:
                    heapq.heappush(queue, found * n + h)
        return tuple([s for s in symbols if s >= 0])

    def look_up(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is not in `kept`."""
        ids = self.older.get(piece) or self.merge(piece.encode())
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.older, self.kept = self.kept, {}
            self.kept[piece] = ids
        return ids

    def forget(self) -> None:
        """Drops the kept pieces; the vocabulary stays."""
        self.kept, self.older = {}, {}

    def encode(self, text: str) -> np.ndarray:
        parts = self.cuts.split(text) if self.cuts and self.cuts.search(text) else [text]
        found: list[tuple[int, ...]] = []
        for part in parts:
            if part in self.added:
                found.append((self.added[part],))
            else:
                kept = self.kept.get
                found += [kept(p) or self.look_up(p) for p in self.pattern.findall(part)]
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.strings.joined(ids)[0].tobytes().decode("utf-8", "replace")


class Strings:
    """Byte strings by id, gathered for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.length = np.array([len(s) for s in strings], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of `ids` one after another, and where each ends."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.start[ids] - ends + length, length) + np.arange(total)], ends


@functools.lru_cache(maxsize=2)
def vocabulary(vocabulary_file: str) -> Bpe:
    return Bpe(vocabulary_file)


def encoded(batches: Iterator[pa.RecordBatch], vocabulary_file: str) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of batches of doc_id and text."""
    bpe = vocabulary(vocabulary_file)
    try:
        for part in words.slices(batches):
            ids = [bpe.encode(t) if t else np.zeros(0, np.int32) for t in part.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))],
                names=["doc_id", "ids"],
            )
    finally:
        # a worker outlives its task and may wait beside other work
        bpe.forget()
        pa.default_memory_pool().release_unused()


def decoded(batches: Iterator[pa.RecordBatch], vocabulary_file: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids, text and decimals of batches of doc_id and ids."""
    bpe = vocabulary(vocabulary_file)
    for batch in batches:
        lists = batch.column("ids")
        for i in range(0, batch.num_rows, 64):
            part = lists.slice(i, 64)
            bounds = part.offsets.to_numpy()
            ids = part.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            columns = []
            for table, tail in ((bpe.strings, 0), (bpe.decimals, 1)):
                data, ends = table.joined(ids)
                cuts = np.concatenate([[0], ends])[bounds]
                raw = data.tobytes()
                columns.append([raw[a : max(a, b - tail)].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, 64), part, *(pa.array(c, pa.string()) for c in columns)],
                names=["doc_id", "ids", "text", "decimals"],
            )


def encode(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """docs(doc_id, text) as doc_id, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: encoded(b, vocabulary_file), f"doc_id {kind}, ids array<int>")


def decode(encoded_docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """encoded_docs(doc_id, ids) with `text`, the decoded text, and `decimals`, the ids joined by commas."""
    kind = encoded_docs.schema["doc_id"].dataType.simpleString()
    return encoded_docs.select("doc_id", "ids").mapInArrow(
        lambda b: decoded(b, vocabulary_file), f"doc_id {kind}, ids array<int>, text string, decimals string"
    )


def round_trip(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """decode(encode(docs)) in one worker for each task, with one vocabulary in memory."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: decoded(encoded(b, vocabulary_file), vocabulary_file), f"doc_id {kind}, ids array<int>, text string, decimals string"
    )
