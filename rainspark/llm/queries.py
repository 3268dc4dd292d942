"""The registered queries of this folder, one per operator, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainspark.llm import bpe, decontamination, fill_middle, html_text, jaccard_join, language, line_dedup, quality, secret_ledger, sql, substring_dedup, token_counts, top_k, vector_codes
from rainspark.llm.tables import read
from rainspark.session import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for state that is kept between runs in production and starts empty in a query."""
    return f"{shared_folder(spark)}/rainspark/{name}-{uuid.uuid4().hex}"


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents"), line_dedup.by_sketch).select("doc_id", "n_lines", "n_removed", "text")


@query("op2_substring_dedup", sql.SUBSTRINGS)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.kept_words(read(spark, sf_dir, "documents")))


@query("op3_jaccard_join", sql.JACCARD)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"), n=3, percent=90)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality.rule_statistics(read(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats, read(spark, sf_dir, "labels"))
    return quality.judge(stats, model).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("doc_key")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, new_folder(spark, "counts"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_secret_scan", sql.SECRETS)
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_ledger.Ledger(spark, new_folder(spark, "ledger"))
    found = secret_ledger.secret_findings(read(spark, sf_dir, "documents"), ledger)
    kinds = F.array(*[F.lit(r.kind) for r in secret_ledger.RULES])

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")

    def count(kind_no: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind_no"] == kind_no)).cast("long")

    base = F.filter("found", lambda s: s["kind_no"] < len(secret_ledger.BASE))
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(secret_ledger.BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    model = language.learn(docs.where(~held_out & F.col("doc_id").isNotNull()).select("text", "lang"), pieces)
    found = language.predict(docs, model, pieces)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), vocabulary)
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decimals", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query("op11_top_k", sql.TOP_K)
def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


@query("op12_vector_codes", sql.VECTOR_CODES)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.codes(read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024))


@query("op13_fill_in_middle", sql.FILL_IN_MIDDLE)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.digests(fill_middle.fill_in_middle(read(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("digests.output").alias("output_sha256"), F.col("digests.restored").alias("restored_sha256")
    )
