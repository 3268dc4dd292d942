"""Event-pair tables on disk."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rainspark.functions.numeric import coerce_numeric, safe_ratio
from rainspark.functions.text import normalise_code8
from rainspark.sources.columns import file_headers, normalise_product_column, require_columns
from rainspark.sources.outputs import write_missing

PAIR_COLUMNS = ("station_id", "lat", "lon", "date", "pr_p", "pr_g", "ratio", "product", "year")


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per product and year, fixed column order."""
    table = pairs.withColumn("year", F.year("date")).select(*PAIR_COLUMNS)
    writer = table.write.mode("overwrite").partitionBy("product", "year")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_missing_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Like `write_pairs`, but only product-years the folder lacks; returns the (product, year) written."""
    table = pairs.withColumn("year", F.year("date")).select(*PAIR_COLUMNS)
    return write_missing(table, path, ("product", "year"), ("station_id", "date"), fmt)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs written by `write_pairs` as parquet."""
    return require_columns(
        spark.read.parquet(path), {"station_id", "date", "pr_p", "pr_g", "product"}, "pair table"
    )


def read_pair_csv(spark: SparkSession, paths: list[str], hint: str | None = None) -> DataFrame:
    """Yearly CSV files, with the product column of whatever name; files of one header are one scan."""
    if not paths:
        raise FileNotFoundError("no pair files given")
    frames = []
    for header, files in sorted(file_headers(spark, paths).items()):
        names = next(csv.reader([header.removeprefix("\ufeff")]))
        # every column as text: station ids keep their zeros and no inference pass is run
        kinds = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frames.append(normalise_product_column(spark.read.schema(kinds).option("header", True).csv(files), hint))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    require_columns(merged, {"station_id", "date", "pr_g"}, "pair files")
    return normalise_pairs(merged)


def normalise_pairs(df: DataFrame) -> DataFrame:
    out = (
        df.withColumn("station_id", normalise_code8(F.col("station_id")))
        .withColumn("date", F.try_to_date(F.substring(F.col("date").cast("string"), 1, 10)))
        .withColumn("pr_g", coerce_numeric(F.col("pr_g")))
        .withColumn("pr_p", coerce_numeric(F.col("pr_p")))
    )
    computed = safe_ratio(F.col("pr_g"), F.col("pr_p"))
    given = coerce_numeric(F.col("ratio")) if "ratio" in df.columns else F.lit(None).cast("double")
    out = out.withColumn("ratio", F.coalesce(given, computed))
    for c in ("lat", "lon"):
        if c in df.columns:
            out = out.withColumn(c, coerce_numeric(F.col(c)))
    return out
