"""Tail quantile mapping of annual maxima, and flow-duration curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from rainspark.functions.series import hermite_with_linear_tails, pchip_slopes

MODEL_SCHEMA = "struct<q0:double,p_q:array<double>,g_q:array<double>>"
MODELS_SCHEMA = f"map<string,{MODEL_SCHEMA}>"


def parse_models(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """(code, q0, p_q, g_q, slope) from rows of JSON text {code: {q0, p_q, g_q}, ...}.

    Knot slopes are computed here, once per model.
    """
    models = json_rows.select(F.explode(F.from_json(column, MODELS_SCHEMA)).alias("code", "m"))
    return models.select(
        "code", "m.q0", "m.p_q", "m.g_q", pchip_slopes(F.col("m.p_q"), F.col("m.g_q")).alias("slope")
    )


def paired_annual_max(daily: DataFrame) -> DataFrame:
    """(code, year, prod_ams, gauge_ams): both annual maxima in one pass over (pr_p, pr_g)."""
    return daily.groupBy("code", F.year("date").alias("year")).agg(
        F.max("pr_p").alias("prod_ams"), F.max("pr_g").alias("gauge_ams")
    )


def ecdf_position(
    sample: DataFrame, queries: DataFrame, key: str = "code", value: str = "v"
) -> DataFrame:
    """`queries` (key, value, ...) with u in [0, 1], its position in the sample of its key.

    Linear between order statistics over n-1; 0 up to the smallest and 1 from the largest value;
    of equal sample values the last one counts. Sample and queries are merged in one ordered
    window per key, which holds the days of one station.
    """
    extra = [c for c in queries.columns if c not in (key, value)]
    merged = sample.filter(F.col(value).isNotNull()).select(
        key, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_s"), F.lit(None).alias("_q")
    ).unionByName(
        queries.select(
            key, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_s"),
            F.struct(value, *extra).alias("_q"),
        )
    )
    # samples come before queries of the same value, so one ascending sort serves everything
    ordered = W.partitionBy(key).orderBy("_v", F.desc("_s"))
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    placed = (
        merged.withColumn("_own", F.when(F.col("_s") == 1, F.col("_v")))
        .withColumn("_below", F.sum("_s").over(upto))
        .withColumn("_x0", F.max("_own").over(upto))
        .withColumn("_x1", F.expr(
            f"lead(_own, 1) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY _v, _s DESC)"
        ))
        .withColumn("_n", F.sum("_s").over(whole))
        .withColumn("_lo", F.min("_own").over(whole)).withColumn("_hi", F.max("_own").over(whole))
        .filter(F.col("_s") == 0)
    )
    frac = F.coalesce(
        (F.col("_v") - F.col("_x0")) / F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0.0)), F.lit(0.0)
    )
    u = (
        F.when(F.col("_n") == 0, F.lit(None).cast("double"))
        .when(F.col("_v") <= F.col("_lo"), 0.0)
        .when(F.col("_v") >= F.col("_hi"), 1.0)
        .otherwise((F.col("_below") - 1 + frac) / F.nullif(F.col("_n") - 1, F.lit(0)))
    )
    return placed.select(
        key, F.col(f"_q.{value}").alias(value), *[F.col(f"_q.{c}").alias(c) for c in extra], u.alias("u")
    )


def placed_annual_max(daily: DataFrame) -> DataFrame:
    """`paired_annual_max` with u, the position of prod_ams in the station's product record.

    An annual maximum is itself one of the record's values and u grows with the value, so u is
    taken for every day in one ordered window per station and the largest of a year is kept. The
    yearly groups stay on the partitions of the window.
    """
    whole = W.partitionBy("code")
    upto = whole.orderBy("pr_p").rangeBetween(W.unboundedPreceding, W.currentRow)
    n, x = F.count("pr_p").over(whole), F.col("pr_p")
    inner = (F.count("pr_p").over(upto) - 1) / F.nullif(n - 1, F.lit(0))
    u = F.when(x <= F.min("pr_p").over(whole), 0.0).when(x >= F.max("pr_p").over(whole), 1.0)
    return (
        daily.withColumn("_u", u.when(x.isNotNull(), inner))
        .groupBy("code", F.year("date").alias("year"))
        .agg(F.max("pr_p").alias("prod_ams"), F.max("pr_g").alias("gauge_ams"), F.max("_u").alias("u"))
    )


def tail_mapping(daily: DataFrame, models: DataFrame) -> DataFrame:
    """(code, year, prod_ams, prod_ams_qm, gauge_ams).

    An annual maximum whose position in the station's product record is below q0 stays; above it
    the monotone cubic of the model maps it. Stations without a model get NULL.
    """
    x = F.col("prod_ams")
    mapped = hermite_with_linear_tails(x, F.col("p_q"), F.col("g_q"), F.col("slope"))
    corrected = F.when(x.isNull() | F.col("q0").isNull(), None).when(F.col("u") < F.col("q0"), x).otherwise(mapped)
    return placed_annual_max(daily).join(models, "code", "left").select(
        "code", "year", "prod_ams", corrected.alias("prod_ams_qm"), "gauge_ams"
    )


def flow_duration(flows: DataFrame, keys: Sequence[str] = ("code",), value: str = "q") -> DataFrame:
    """(keys, date, q, rank, exceedance): Weibull position of each daily flow of a station.

    A window holds the days of one station; equal flows are ranked by date.
    """
    w = W.partitionBy(*keys)
    ranked = w.orderBy(F.desc(value), "date")
    return (
        flows.filter(F.col(value).isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("exceedance", F.col("rank") / (F.count("*").over(w) + 1.0))
    )
