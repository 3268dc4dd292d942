"""Gauges and products to bias factors, factor surfaces and corrected annual maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rainspark.grid import Grid
from rainspark.operators import bias, extremes, kriging, polygons, raster
from rainspark.session import materialise


def station_zetas(
    gauge_daily: DataFrame, stations: DataFrame, product_daily: DataFrame, grid: Grid,
    method: str = "mean", min_samples: int = 10, order: Sequence[str] = ("lat", "lon"),
) -> DataFrame:
    """(product, station_id, zeta, n_pairs, ..., lat, lon) in one chain of jobs.

    `order` names the columns of `stations` that say which of several rows of a code came first.
    """
    events = extremes.extremes(gauge_daily)
    pairs = extremes.event_pairs(events, stations, product_daily, grid, order=order)
    return bias.with_coordinates(bias.zeta(pairs, method, min_samples), stations, order)


def zeta_surface(
    zetas: DataFrame, cells: DataFrame, k: int = 8, power: float = 2.0, method: str = "idw",
    boundary: DataFrame | None = None, model: str = "spherical",
) -> DataFrame:
    """(product, row, col, lat, lon, zeta) on `cells` (product, row, col, lat, lon).

    `method` is 'idw' or 'ok' (ordinary kriging on the k nearest points); with `boundary` (rings)
    only cells inside it remain.
    """
    points = bias.interpolation_points(zetas)
    if boundary is not None:
        cells = polygons.clip_to(cells, boundary)
    if method == "ok":
        return kriging.local_kriging(points, cells, k, model, groups=["product"])
    if method != "idw":
        raise ValueError(f"method {method!r} is neither 'idw' nor 'ok'")
    return raster.idw(points, cells, k, power, group=["product"])


def corrected_maxima(
    amax: DataFrame, surface: DataFrame, surface_grid: Grid, amax_grid: Grid
) -> DataFrame:
    """Annual maxima (product, row, col, year, mm) times the surface, regridded when grids differ."""
    if surface_grid.same_as(amax_grid):
        on_grid = surface
    else:
        # the cells and the maxima are read apart
        amax = materialise(amax, "maxima")
        targets = amax.select("row", "col").distinct()
        on_grid = raster.regrid(surface, surface_grid, targets, amax_grid, "zeta", ["product"])
    return raster.apply_bias(amax, on_grid)
