"""Fitted parameters on disk by tile, so that points read only the tiles they lie in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainspark.grid import Grid

#: Rows and columns of cells in a tile.
TILE = 256
TILE_KEYS = ("tile_row", "tile_col")


def tile_of(size: int) -> dict[str, Column]:
    return {k: F.floor(F.col(c) / size).cast("int") for k, c in zip(TILE_KEYS, ("row", "col"))}


def write_store(params: DataFrame, path: str, size: int = TILE) -> None:
    """One folder per tile, ordered by cell; a task writes at most one file for each tile it meets."""
    tiled = params.withColumns(tile_of(size))
    place = (*TILE_KEYS, "row", "col")
    tiled.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy(*TILE_KEYS).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sample_store(
    points: DataFrame, store: DataFrame, grid: Grid, bands: Sequence[str], keys: Sequence[str] = (), size: int = TILE
) -> DataFrame:
    """Points with the bands of their cell, as `raster.sample_raster`, from the tiles that hold points.

    The tiles of the points on the grid are a small table that prunes the folders of the store while the query
    runs; with so many points that it is no longer broadcast, nearly every tile is needed anyway. Points off the
    grid or without coordinates keep one row with NULL bands.
    """
    cell = {"row": grid.row_of(F.col("lat")), "col": grid.col_of(F.col("lon"))}
    placed = points.withColumns(cell).withColumns(tile_of(size))
    tiles = placed.filter(grid.inside(F.col("row"), F.col("col"))).select(*TILE_KEYS).distinct()
    cells = store.join(tiles, list(TILE_KEYS), "left_semi").select(*TILE_KEYS, *keys, "row", "col", *bands)
    return placed.join(cells, [*TILE_KEYS, "row", "col"], "left").drop(*TILE_KEYS)
