"""Station inventories: reading, filtering and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rainspark.functions.numeric import coerce_numeric
from rainspark.functions.text import is_two_letter, normalise_code8, state_code
from rainspark.sources.columns import require_columns

# Metadata columns in their order of preference.
PREFERRED_METADATA = (
    "Code", "Name", "City", "State", "Latitude", "Longitude",
    "StartDate", "EndDate", "NYD", "MD", "N_YWOMD", "YWMD",
)


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding): 'UTF-8' for each file whose lines are all valid UTF-8, else 'ISO-8859-1'.

    Lines are taken as bytes, so one reading with one aggregate per file decides.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    encoding = F.when(F.bool_and("valid"), "UTF-8").otherwise("ISO-8859-1")
    return lines.groupBy("file").agg(encoding.alias("encoding"))


def read_inventory(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """CSV inventory with every column as text, so that codes keep their zeros.

    Without `encoding` every file of the folder is read as UTF-8 if it is valid UTF-8, and as
    latin-1 otherwise; the driver sees the names of the files. A byte order mark is dropped.
    """
    def read(files: str | list[str], name: str) -> DataFrame:
        raw = spark.read.option("header", True).option("encoding", name).csv(files)
        return raw.toDF(*[c.removeprefix("\ufeff") for c in raw.columns])

    if encoding is not None:
        return require_columns(read(path, encoding), {"Code", "Latitude", "Longitude"}, "inventory")
    files: dict[str, list[str]] = {}
    for r in file_encodings(spark, path).collect():
        files.setdefault(r["encoding"], []).append(unquote(r["file"]))
    if len(files) < 2:
        raw = read(path, next(iter(files), "UTF-8"))
    else:
        parts = [read(sorted(files[name]), name) for name in sorted(files)]
        raw = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return require_columns(raw, {"Code", "Latitude", "Longitude"}, "inventory")


def filter_owner_type(
    df: DataFrame, owners: Iterable[str] | None = ("ANA",), types: Iterable[int] | None = (2,)
) -> DataFrame:
    """Keep listed owners and station types; rows where they are unknown stay."""
    if owners is not None and "Responsible" in df.columns:
        c = F.col("Responsible")
        df = df.filter(F.upper(c).isin(*owners) | c.isNull())
    if types is not None and "Type" in df.columns:
        c = F.col("Type")
        number = F.coalesce(coerce_numeric(c), F.lit(-1.0)).cast("int")
        df = df.filter(number.isin(*types) | c.isNull())
    return df


def first_row_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order (a partial limit runs before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def clean_coords(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `Code8`, numeric coordinates; drops rows without them; one row per code.

    `order` says which of several rows of a code came first in the source.
    """
    cleaned = (
        df.withColumn("Code8", normalise_code8(F.col("Code")))
        .withColumn("Latitude", coerce_numeric(F.col("Latitude")))
        .withColumn("Longitude", coerce_numeric(F.col("Longitude")))
        .dropna(subset=["Code8", "Latitude", "Longitude"])
    )
    return first_row_per(cleaned, ["Code8"], order)


def reorder_metadata(df: DataFrame) -> DataFrame:
    """Preferred columns first, all others after them."""
    preferred = [c for c in PREFERRED_METADATA if c in df.columns]
    return df.select(*preferred, *[c for c in df.columns if c not in preferred])


def clean_inventory(
    df: DataFrame,
    order: Sequence[str],
    owners: Iterable[str] | None = ("ANA",),
    types: Iterable[int] | None = (2,),
) -> DataFrame:
    return reorder_metadata(clean_coords(filter_owner_type(df, owners, types), order))


def select_region(
    df: DataFrame, state: str | None = None, city: str | None = None, source: str | None = None
) -> DataFrame:
    for column, value in (("State", state), ("City", city), ("Responsible", source)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def with_state_code(df: DataFrame, column: str = "State", share: float = 0.9) -> DataFrame:
    """Adds `STATE_ABBR`: names become codes unless `share` of the rows are codes already.

    The share is a scalar subquery: one value, computed once.
    """
    coded = df.agg(F.avg(F.when(is_two_letter(F.col(column)), 1.0).otherwise(0.0)) >= share)
    text = F.col(column)
    return df.withColumn(
        "STATE_ABBR", F.when(coded.scalar(), text).otherwise(state_code(text))
    )
