"""Gridded rainfall products: fixed configuration as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Code, label, first year, last year, grid step, scale, offset, bias options.
PRODUCTS = (
    ("XAVIER", "BR-DWGD", 1994, 2024, 0.10, 0.006866665, 225.0, ("RAW", "BC")),
    ("IMERG", "IMERG", 2000, 2024, 0.10, 1.0, 0.0, ("RAW", "BC")),
    ("CHIRPS", "CHIRPS", 1994, 2024, 0.05, 1.0, 0.0, ("RAW", "BC")),
    ("PERS", "PERSIANN", 1994, 2024, 0.25, 1.0, 0.0, ("RAW", "BC")),
)
DISAGGREGATIONS = (("LOC", "Locally-Disaggregated"), ("CET", "CETESB"), ("STN", "Station-derived"))
SCHEMA = (
    "product string, label string, first_year int, last_year int, step double, "
    "scale double, offset double, biases array<string>"
)


def product_config(spark: SparkSession) -> DataFrame:
    """One row per product (four rows, fixed)."""
    return spark.createDataFrame([(*p[:7], list(p[7])) for p in PRODUCTS], SCHEMA)


def in_years(df: DataFrame, products: DataFrame, year: str = "year") -> DataFrame:
    """Rows of `df` (product, `year`, ...) in the years of their product, both ends included.

    Products that are not configured go. One equality on the product with a range on the year.
    """
    windows = products.select(F.col("product").alias("_product"), "first_year", "last_year")
    inside = (F.col("product") == F.col("_product")) & F.col(year).between(F.col("first_year"), F.col("last_year"))
    return df.join(windows, inside, "left_semi")


def availability(products: DataFrame) -> DataFrame:
    """Years and bias options of each product as display text."""
    return products.select(
        "product", "label",
        F.concat_ws("-", "first_year", "last_year").alias("years"),
        F.array_join("biases", ", ").alias("bias_options"),
    )
