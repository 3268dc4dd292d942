"""Gauges and products to fitted parameters: the whole chain as one job.

Station factors are computed from declustered gauge and product extremes, interpolated inside the boundary and applied to the
product's annual maxima; raw and corrected maxima of the years of each product are then fitted
side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rainspark.grid import Grid
from rainspark.plans import bias_correction, idf_fit
from rainspark.session import materialise
from rainspark.sources.products import in_years


def both_options(amax: DataFrame, surface: DataFrame, products: DataFrame, surface_grid: Grid, amax_grid: Grid) -> DataFrame:
    """(product, bias, row, col, year, mm): raw and corrected maxima inside each product's years.

    `products` (product, first_year, last_year, biases) says which years count and which of 'RAW'
    and 'BC' are wanted. A cell that the surface leaves out has raw rows only.
    """
    inside = in_years(amax, products)
    corrected = bias_correction.corrected_maxima(inside, surface, surface_grid, amax_grid).filter("mm IS NOT NULL")
    options = products.select("product", F.explode("biases").alias("bias"))
    columns = ["product", "bias", "row", "col", "year", "mm"]
    raw = inside.withColumn("bias", F.lit("RAW")).select(*columns)
    return raw.unionByName(corrected.withColumn("bias", F.lit("BC")).select(*columns)).join(
        options, ["product", "bias"], "left_semi"
    )


def parameters_from_gauges(
    gauge_daily: DataFrame, stations: DataFrame, product_daily: DataFrame, product_grid: Grid,
    amax: DataFrame, cells: DataFrame, grid: Grid, products: DataFrame, *,
    zeta_method: str = "mean", method: str = "idw", k: int = 8, boundary: DataFrame | None = None,
    station_ratios: DataFrame | None = None, vectors: DataFrame | None = None,
    order: Sequence[str] = ("lat", "lon"),
) -> DataFrame:
    """The parameter table of every product, bias option and mode, from gauges on.

    `amax` (product, row, col, year, mm) and `cells` (row, col, lat, lon) lie on `grid`,
    `product_daily` on `product_grid`. `method` is 'idw' or 'ok'; with `boundary` (rings) only cells
    inside it are corrected.
    """
    zetas = materialise(
        bias_correction.station_zetas(gauge_daily, stations, product_daily, product_grid, zeta_method, order=order), "zetas"
    )
    surface = bias_correction.zeta_surface(zetas, _per_product(cells, products), k, method=method, boundary=boundary)
    # the fit reads the maxima once, so they need not be written
    maxima = both_options(amax, surface, products, grid, grid)
    return idf_fit.parameter_table(maxima, cells, station_ratios, vectors)


def _per_product(cells: DataFrame, products: DataFrame) -> DataFrame:
    """The cells once for each product that is to be corrected; the driver sees the names of the products."""
    names = [r[0] for r in products.filter(F.array_contains("biases", "BC")).select("product").distinct().orderBy("product").collect()]
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return cells.select(F.explode(listed).alias("product"), "row", "col", "lat", "lon")
