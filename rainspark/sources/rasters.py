"""Raster catalogues and parameter stacks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainspark.grid import PARAMETER_BANDS
from rainspark.sources.inventory import first_row_per

TRAILING_YEAR = r"_(\d{4})(?=\D*$)"


def raster_catalogue(
    files: DataFrame, first: int, last: int, pattern: str = TRAILING_YEAR,
    keys: tuple[str, ...] = (), name: str = "name",
) -> DataFrame:
    """Files of the year window, the first file of each year, sorted by year."""
    year = F.regexp_extract(F.col(name), pattern, 1).try_cast("int")
    dated = files.withColumn("year", year).filter(F.col("year").between(first, last))
    return first_row_per(dated, [*keys, "year"], [name]).orderBy(*keys, "year")


def new_only(wanted: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no output yet."""
    return wanted.join(written.select(*keys), keys, "left_anti")


def band(df: DataFrame, name: str, stored_as: str | None = None, keys: int = 0) -> Column:
    """A parameter band by name, else by its fixed position after the `keys` leading columns."""
    stored = stored_as or name
    if stored in df.columns:
        return F.col(stored).alias(name)
    position = keys + PARAMETER_BANDS.index(name)
    if position >= len(df.columns):
        raise ValueError(f"stack has neither band {stored} nor position {position}")
    return F.col(df.columns[position]).alias(name)


def parameter_stack(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the 13 parameter bands, taken by name when all are named, else by position."""
    return df.select(*keys, *[band(df, b, keys=len(keys)) for b in PARAMETER_BANDS])


def compact_stack(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the seven bands used for serving."""
    return df.select(
        *keys, *[band(df, b, keys=len(keys)) for b in ("K", "a", "b", "c", "MSE", "RMSE", "R2")]
    )
