"""Four fifths of the rows hold one text: no task may get them all where results meet the rows."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rainspark.llm import queries, secret_ledger, token_counts

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df, n):
    parts = Counter(r.p for r in df.select("doc_id", F.spark_partition_id().alias("p")).collect())
    assert sum(parts.values()) == n
    return max(parts.values()) / n


def test_rows_of_one_text_are_split(spark, skewed):
    n = 20_000
    docs = spark.range(0, n, 1, 40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 5 < 4, F.lit("password = abcdefgh1 in one text")).otherwise(F.concat(F.lit("text "), "id")).alias("text")
    )
    counts = token_counts.token_counts(docs, queries.new_folder(spark, "hot"), public_tokenizers.path("piece_bpe_32k.model"))
    assert largest_share(counts, n) < 0.25
    found = secret_ledger.secret_findings(docs, secret_ledger.Ledger(spark, queries.new_folder(spark, "hot")))
    assert largest_share(found, n) < 0.25
    assert found.where(F.size("found") > 0).count() == n * 4 // 5
