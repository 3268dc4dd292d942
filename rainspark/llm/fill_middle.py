"""Fill-in-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of bounded size, each with the number of code
points and of units that end before it. A unit is a word with the white space before it, or the white space at
the end of the text. To cut a text after a number of units, the frame in which that unit ends is
found in the counts, and it alone is decompressed. The output is an order of the old frames: those between
the cuts are taken over as they are stored, the two cut frames are split, and the marks become frames of their
own. Digests stream the frames of an output in order, and the frames of a text restored from an
output in the order of its sections, one frame in memory at a time.

The forms and cuts depend on the seed and the decimal doc_id alone: h1 to h4 are the first four 32-bit numbers of the
sha256 of `seed:doc_id`. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the
larger. A text stays plain if it is empty or holds a mark, or if h3 % 100 >= rate; else it is spm if h4 % 100 <
spm_rate, and psm otherwise.

Cases: a null text is empty; a null doc_id counts as an empty string; a unit may span frames; repeated rows come out
as often as they went in; no rows give no rows; other columns are ignored. Texts are UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from rainspark.llm import words
from rainspark.session import materialise

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Order of the sections in the output of a form.
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: A frame ends with the unit that reaches so many units, or inside a unit at so many bytes.
FRAME_UNITS, FRAME_BYTES = 512, 1 << 16
LEVEL = 3
FRAME = "units_before:bigint,chars_before:bigint,data:binary"
FRAMES = f"array<struct<{FRAME}>>"


class Frame(NamedTuple):
    """A frame of a text, and how many units and code points end before it."""

    units_before: int
    chars_before: int
    data: bytes


def points(raw: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where the units end in the bytes of a whole text."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    inside = ~words.SPACES[raw]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = np.flatnonzero(last) + 1
    return ends if inside[-1] else np.append(ends, len(raw))


def frame_cuts(raw: np.ndarray, ends: np.ndarray) -> list[int]:
    """Where the frames of a text end: at ends of units where possible, never inside a character."""
    cuts, at = [], 0
    for end in [*ends[FRAME_UNITS - 1 :: FRAME_UNITS].tolist(), len(raw)]:
        while end - at > FRAME_BYTES:
            after = np.searchsorted(ends, at + FRAME_BYTES, "right")
            near = int(ends[after - 1]) if after else 0
            if near <= at:  # a unit longer than a frame
                near = at + FRAME_BYTES
                while (raw[near] & 0xC0) == 0x80:
                    near -= 1
            cuts.append(near)
            at = near
        if end > at:
            cuts.append(end)
            at = end
    return cuts


def frames_of(text: bytes) -> tuple[int, list[Frame]]:
    """Units of a text, and its frames."""
    raw = np.frombuffer(text, dtype=np.uint8)
    ends = unit_ends(raw)
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    out, at, chars = [], 0, 0
    for cut in frame_cuts(raw, ends):
        out.append(Frame(int(np.searchsorted(ends, at, "right")), chars, compress(text[at:cut])))
        chars += points(raw[at:cut])
        at = cut
    return len(ends), out


def encode(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, n (units), n_chars, marked (whether the text holds a mark) and frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            texts = [t.encode() if t else b"" for t in part.column("text").to_pylist()]
            found = [frames_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([points(np.frombuffer(t, dtype=np.uint8)) for t in texts], pa.int64()),
                    pa.array([any(m.encode() in t for m in MARKS.values()) for t in texts], pa.bool_()),
                    frame_column([f for _, f in found]),
                ],
                names=["doc_id", "n", "n_chars", "marked", "frames"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, n_chars long, marked boolean, frames {FRAMES}")


def frame_column(rows: list[list[Frame]]) -> pa.Array:
    kind = pa.list_(pa.struct([("units_before", pa.int64()), ("chars_before", pa.int64()), ("data", pa.binary())]))
    return pa.array([[f._asdict() for f in row] for row in rows], kind)


def frames_from(row: pa.Scalar) -> list[Frame]:
    return [Frame(f["units_before"], f["chars_before"], f["data"]) for f in row.as_py() or []]


def choices(stored: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """stored with form, and first and second, the units before the two cuts."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def h(i: int) -> Column:
        return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")

    cuts = [h(i) % (F.col("n") + 1) for i in (1, 2)]
    plain = (F.col("n_chars") == 0) | F.col("marked") | (h(3) % 100 >= rate)
    form = F.when(plain, "plain").when(h(4) % 100 < spm_rate, "spm").otherwise("psm")
    return stored.withColumn("form", form).withColumn("first", F.least(*cuts)).withColumn("second", F.greatest(*cuts))


def cut(frames: list[Frame], unit: int, n: int) -> tuple[int, int, bytes]:
    """The frame in which the unit with this number (from 1) ends, the end in its bytes, and these bytes."""
    k = int(np.searchsorted([f.units_before for f in frames], unit, "left")) - 1
    text = zstandard.ZstdDecompressor().decompress(frames[k].data)
    raw = np.frombuffer(text, dtype=np.uint8)
    # the last unit of a text ends with it; a word that goes on in the next frame is not among the units asked for here
    end = len(raw) if unit == n else int(unit_ends(raw)[unit - frames[k].units_before - 1])
    return k, end, text


def sections(frames: list[Frame], n: int, first: int, second: int) -> tuple[dict[str, list[bytes]], dict[str, int]]:
    """Compressed frames and code points of prefix, middle and suffix: only the cut frames are opened."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    places = []
    for unit in (first, second):
        k, end, text = cut(frames, unit, n) if unit else (0, 0, b"")
        places.append((k, end, text, frames[k].chars_before + points(np.frombuffer(text[:end], dtype=np.uint8)) if frames else 0))
    (k1, e1, t1, c1), (k2, e2, t2, c2) = places
    if not second:
        return {"prefix": [], "middle": [], "suffix": [f.data for f in frames]}, {"prefix": 0, "middle": 0}

    def piece(text: bytes) -> list[bytes]:
        return [compress(text)] if text else []

    whole = [f.data for f in frames]
    prefix = whole[:k1] + piece(t1[:e1])
    if k1 == k2 and first:
        middle = piece(t1[e1:e2])
    else:
        rest = piece(t1[e1:]) if first else whole[:1] if k2 else []
        middle = rest + whole[k1 + 1 : k2] + piece(t2[:e2])
    suffix = piece(t2[e2:]) + whole[k2 + 1 :]
    return {"prefix": prefix, "middle": middle, "suffix": suffix}, {"prefix": c1, "middle": c2 - c1}


def transform(chosen: DataFrame) -> DataFrame:
    """chosen(doc_id, n, form, first, second, frames) as doc_id, n, form, prefix_chars, middle_chars (null if plain) and output:
    the frames of the output in order, marks among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        marks = {name: compress(mark.encode()) for name, mark in MARKS.items()}
        for part in sized(batches, "frames"):
            prefix, middle, output = [], [], []
            for n, form, first, second, stored in zip(*(part.column(c).to_pylist() for c in ("n", "form", "first", "second")), part.column("frames")):
                frames = frames_from(stored)
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    output.append([f.data for f in frames])
                else:
                    found, chars = sections(frames, n, first, second)
                    prefix.append(chars["prefix"])
                    middle.append(chars["middle"])
                    output.append([x for name in ORDERS[form] for x in (marks[name], *found[name])])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "n", "form")), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.list_(pa.binary()))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.select("doc_id", "n", "form", "first", "second", "frames").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
    )


def sized(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose column takes about `size` bytes, or single rows beyond it."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            most = 1
            while at + most < batch.num_rows and most < 256 and batch.column(column).slice(at, most).nbytes < size:
                most *= 2
            part = batch.slice(at, most)
            yield part
            at += part.num_rows


def read_frames(frames: list[bytes]) -> Iterator[bytes]:
    """The bytes of frames in order, one frame at a time."""
    open_ = zstandard.ZstdDecompressor()
    for f in frames:
        yield open_.decompress(f)


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text from an output and its form, frame by frame: the sections lie between the marks, which no
    transformed text holds, and marks are frames of their own."""
    if form == "plain":
        yield from read_frames(frames)
        return
    marks = {mark.encode(): name for name, mark in MARKS.items()}
    found: dict[str, list[bytes]] = {}
    for frame, text in zip(frames, read_frames(frames)):
        if text in marks:
            current = found.setdefault(marks[text], [])
        else:
            current.append(frame)
    for name in ("prefix", "middle", "suffix"):
        yield from read_frames(found[name])


def from_output(transformed: DataFrame, name: str, kind: pa.DataType, spark_kind: str, of: Callable[[list[bytes], str], object]) -> DataFrame:
    """transformed with a column `name` in place of output, made from the frames and the form of each output."""
    fields = [f for f in transformed.schema.fields if f.name not in ("output", name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized(batches, "output"):
            made = [of(output.as_py(), form) for output, form in zip(part.column("output"), part.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(made, kind)], names=[*(f.name for f in fields), name])

    return transformed.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} {spark_kind}"]))


def texts(transformed: DataFrame) -> DataFrame:
    """transformed with `text`, the whole output, for training."""
    return from_output(transformed, "text", pa.string(), "string", lambda output, form: b"".join(read_frames(output)).decode())


def digests(transformed: DataFrame) -> DataFrame:
    """transformed with digests(output, restored): sha256 of the output and of the text restored from it."""

    def streamed(parts: Iterator[bytes]) -> str:
        digest = hashlib.sha256()
        for p in parts:
            digest.update(p)
        return digest.hexdigest()

    def both(output: list[bytes], form: str) -> dict[str, str]:
        return {"output": streamed(read_frames(output)), "restored": streamed(restored(output, form))}

    return from_output(transformed, "digests", pa.struct([("output", pa.string()), ("restored", pa.string())]), "struct<output:string,restored:string>", both)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """The transformed documents, from frames that are written to the shared folder once."""
    stored = materialise(encode(docs), "frames")
    return transform(choices(stored, seed, rate, spm_rate))
