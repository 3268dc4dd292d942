"""From raw documents to token ids: quality rules, line dedup, near-duplicate documents, benchmark
decontamination, BPE. Each stage reads what its predecessor kept; all but the last return the
columns of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rainspark.llm import bpe, decontamination, jaccard_join, line_dedup, quality
from rainspark.llm.tables import read
from rainspark.session import materialise

SHINGLE, PERCENT = 5, 80
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the forest finds anomalous go."""
    stats = materialise(quality.rule_statistics(docs), "statistics")
    return quality.keep(docs, quality.fit(stats, read(spark, sf_dir, "labels")))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines the first stays; a document that loses all its words goes."""
    found = line_dedup.cleaned(docs, line_dedup.by_sketch)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.where(~emptied).select(*[made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns])


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by similar shingle sets the one with the smallest doc_id stays."""
    found = jaccard_join.components(docs.select("doc_id", "text"), SHINGLE, PERCENT)
    later = found.where("component_id < doc_id").select(F.col("doc_id").alias("later")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("later"))
    return rows.join(later, "later", "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    decoded = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", fuzzy_lines),
    ("jaccard_join", near_documents),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]
#: No SQL: the forest's verdict, near-equal lines and byte pairs are compared with brute-force versions in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
