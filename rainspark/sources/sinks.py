"""Text outputs with two decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def two_decimals(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c))


def daily_table(daily: DataFrame) -> DataFrame:
    return daily.select("code", F.col("date").alias("Date"), two_decimals(F.col("pr_g")).alias("Rain_mm_day"))


def annual_table(annual: DataFrame) -> DataFrame:
    return annual.select(
        "code", F.col("year").alias("Year"),
        two_decimals(F.col("max_mm")).alias("MaxDaily_mm"),
        F.col("date_of_max").alias("DateOfMax"),
    )


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """As many files as tasks, so nothing is gathered in one place."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
