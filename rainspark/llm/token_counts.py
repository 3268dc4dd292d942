"""Token counts through a digest cache.

Every text is named by the SHA-256 of its normalised content (a null becomes an empty text; nothing
else is normalised, since any further change could change the count). Digests that the cache does
not hold for this tokenizer version are encoded once each, whatever the number of their copies, and
appended to the cache; then all rows join the cache.

Cases: a null text counts as empty (0 tokens); rows are never merged, so repeated rows come out as
often as they went in; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from rainspark.llm import words
from rainspark.session import materialise

CACHE = "digest binary, tokenizer string, n_tokens long"
LIMIT = 4096


def tokenizer_version(model_file: str) -> str:
    """Digest of the library's version and the model file."""
    with open(model_file, "rb") as f:
        return hashlib.sha256(f"sentencepiece {sentencepiece.__version__}\n".encode() + f.read()).hexdigest()


@functools.lru_cache(maxsize=2)
def processor(model_file: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at `path`, made empty where there is none. One row per digest and version, also
    where two runs have appended the same digest."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, path: str, model_file: str) -> None:
    """Encode the distinct texts (digest, text) that the cache lacks and append their counts."""
    version = tokenizer_version(model_file)
    known = open_cache(texts.sparkSession, path).where(F.col("tokenizer") == version)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = processor(model_file).encode
        for part in words.slices(batches):
            counts = [len(ids) for ids in encode(part.column("text").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"],
            )

    # copies meet in the partial aggregate before the shuffle, so that a text held by a third of all rows is sent
    # once per task
    misses = texts.dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    misses.mapInArrow(count, CACHE).write.mode("append").parquet(path)


def token_counts(docs: DataFrame, cache_path: str, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    fill_cache(keyed.select("digest", "text"), cache_path, model_file)
    counts = open_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer_version(model_file)).select("digest", "n_tokens")
    # written out, the rows of a text that a third of all rows hold can be split over tasks in the join
    counts = materialise(counts, "counts")
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )

