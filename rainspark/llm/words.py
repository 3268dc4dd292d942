"""Vectorised words and word windows over Arrow batches of whole texts.

A word is a maximal run of bytes outside space and \\t..\\r, i.e. `[^\\x20\\x09-\\x0D]+`; since those
bytes never occur inside a multi-byte UTF-8 character, bytes and code points give the same words.
Words are compared through 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
#: Also between the words of texts that are compared without their punctuation: all of ASCII's.
PUNCTUATION = SPACES.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SLICE_BYTES = 1 << 21

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """The words of several documents one after another; document d has words bounds[d]:bounds[d+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def document(self) -> np.ndarray:
        """The number of the document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and whether they lie in one document."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        acc = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            acc = acc * np.uint64(BASE) + self.hashes[j : n - k + 1 + j]
        inside = np.zeros(n, dtype=bool)
        last = np.repeat(self.bounds[1:], self.counts())
        inside[: n - k + 1] = np.arange(n - k + 1) + k <= last[: n - k + 1]
        return np.concatenate([mix(acc ^ np.uint64(k)), np.zeros(k - 1, dtype=np.uint64)]), inside


def words_of(texts: pa.Array, lower: bool = False, spaces: np.ndarray = SPACES) -> Words:
    """Words of an Arrow array of strings; a null has none. lower: A-Z count as a-z; spaces: bytes between words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    n = len(data)
    inside = ~spaces[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    after = np.ones(n, dtype=bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    prefix = np.zeros(n + 1, dtype=np.uint64)
    codes = (LOWER_CODE if lower else BYTE_CODE)[data]
    np.cumsum(codes * powers(BASE, n), out=prefix[1:])
    hashes = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, n)[starts] if n else np.zeros(0, np.uint64)
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `size` bytes, to bound the memory of their arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        part = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // size
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(first, [*first[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)
