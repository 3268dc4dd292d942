"""Descriptive statistics of the station inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rainspark.functions.numeric import coerce_numeric
from rainspark.operators.quantiles import quantile_columns

NUMERIC = ("NYD", "MD", "N_YWOMD", "YWMD")
POINTS = {"min": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "max": 1.0}


def stacked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the numeric columns that exist."""
    present = [c for c in columns if c in rows.columns]
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), coerce_numeric(F.col(c)).alias("value")) for c in present
    ])
    return rows.select(F.explode(items).alias("i")).select("i.*").filter(F.col("value").isNotNull())


def describe(rows: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """(column, n, mean, std, min, p05, p50, p95, max) with the sample standard deviation."""
    values = stacked(rows, columns)
    moments = values.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return quantile_columns(values, ["column"], "value", POINTS).join(moments, "column").select(
        "column", "n", "mean", "std", *POINTS
    )


def record_length(start: Column, end: Column) -> Column:
    """Years from start to end; NULL when the end comes first."""
    years = end - start
    return F.when(years >= 0, years)


def auto_bins(values: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, low, high, n, n_bins): the narrower of the Sturges and Freedman-Diaconis widths.

    This is NumPy's 'auto' up to 2.2; later releases also keep the second from becoming too narrow.
    """
    q = quantile_columns(
        values, groups, value, {"low": 0.0, "q1": 0.25, "q3": 0.75, "high": 1.0}
    )
    n = F.col("n").cast("double")
    span = F.col("high") - F.col("low")
    sturges = span / (F.log2(n) + 1.0)
    fd = F.lit(2.0) * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3.0))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    bins = F.when(span > 0, F.ceil(span / width)).otherwise(1).cast("int")
    return q.select(*groups, "low", "high", "n", bins.alias("n_bins"))


def histogram(values: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, bin, left, right, n) with automatic bins; empty bins are listed too.

    The last bin includes its right edge; a constant group is one bin of width 1 around it.
    """
    plan = auto_bins(values, groups, value).withColumn("flat", F.col("high") == F.col("low"))
    plan = plan.select(
        *groups, "n_bins",
        F.when(F.col("flat"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("flat"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).withColumn("step", (F.col("high") - F.col("low")) / F.col("n_bins"))
    v = F.col(value)
    guess = F.floor((v - F.col("low")) / F.col("step"))
    up = F.when(F.col("low") + (guess + 1) * F.col("step") <= v, guess + 1).otherwise(guess)
    exact = F.when(F.col("low") + up * F.col("step") > v, up - 1).otherwise(up)
    index = F.least(F.greatest(exact, F.lit(0)), F.col("n_bins") - 1).cast("int")
    counted = (
        values.filter(v.isNotNull()).join(plan, list(groups))
        .groupBy(*groups, index.alias("bin")).agg(F.count("*").alias("n"))
    )
    frame = plan.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    return frame.join(counted, [*groups, "bin"], "left").select(
        *groups, "bin", (F.col("low") + F.col("bin") * F.col("step")).alias("left"),
        (F.col("low") + (F.col("bin") + 1) * F.col("step")).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
