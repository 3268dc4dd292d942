"""Exact linear-interpolated quantiles of groups of any size.

`percentile` keeps all distinct values of a group in one task. Here a group may hold most of the
data: equal values are counted first, and the counts are range-partitioned by group and value, so
that a large group fills many slices. The totals of the slices say which of them hold a wanted
rank, and only those are ordered. All probabilities and groups share that one table of counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from rainspark.session import materialise


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], slices: int | None = None
) -> DataFrame:
    """(groups..., prob, q, n): NumPy's default linear quantile of the non-NULL values.

    `groups` must be non-NULL columns; give none for a single group. The value counts are written
    once, in `slices` ranges (the session's number of shuffle partitions by default); the written
    table fixes where each range ends.
    """
    keys = ["_g", *groups]
    counts = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_g", F.lit(0))
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    order = [*keys, "v"]
    ranged = counts.repartitionByRange(slices, *order) if slices else counts.repartitionByRange(*order)
    values = materialise(ranged.withColumn("_slice", F.spark_partition_id()), "values")

    up_to_here = W.unboundedPreceding, W.currentRow
    parts = values.groupBy(*keys, "_slice").agg(F.sum("n").alias("size"), F.min("v").alias("start"))
    ends = parts.withColumn(
        "before", F.sum("size").over(W.partitionBy(*keys).orderBy("start").rowsBetween(*up_to_here)) - F.col("size")
    )
    ranked = (
        parts.groupBy(*keys).agg(F.sum("size").alias("total"))
        .select(*keys, "total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("pos", F.col("prob") * (F.col("total") - 1))
        .withColumn("lo", F.floor("pos"))
        .withColumn("hi", F.ceil("pos"))
    )
    wanted = ranked.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    left = F.col("rank") - F.col("before")
    hit = wanted.join(ends, keys).filter((left >= 0) & (left < F.col("size"))).select(
        *keys, "_slice", "rank", left.alias("left")
    )
    opened = values.join(hit.select(*keys, "_slice"), [*keys, "_slice"], "left_semi")
    inside = W.partitionBy(*keys, "_slice").orderBy("v").rowsBetween(*up_to_here)
    at_rank = (
        opened.withColumn("upto", F.sum("n").over(inside))
        .join(hit, [*keys, "_slice"])
        .filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))
    )
    v_lo, v_hi = F.element_at("values", F.col("lo")), F.element_at("values", F.col("hi"))
    return ranked.join(at_rank, keys).select(
        *groups, "prob",
        (v_lo + (v_hi - v_lo) * (F.col("pos") - F.col("lo"))).alias("q"),
        F.col("total").alias("n"),
    )


def quantile_columns(
    df: DataFrame, groups: Sequence[str], value: str, named: dict[str, float], slices: int | None = None
) -> DataFrame:
    """The same quantiles, one column per name, with the group size `n`."""
    rows = exact_quantiles(df, groups, value, sorted(set(named.values())), slices)
    picks = [
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(name)
        for name, p in named.items()
    ]
    return rows.groupBy(*groups).agg(F.max("n").alias("n"), *picks)
