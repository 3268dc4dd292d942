"""The chain from gauges to parameters: years, bias options, mask and method."""

import pytest
from pyspark.sql import functions as F

from rainspark.grid import Grid
from rainspark.operators.polygons import rectangle
from rainspark.plans import bias_correction, gauges_to_idf, idf_fit
from rainspark.sources.products import in_years

GRID = Grid(0.0, 10.0, 1.0, 1.0, 10, 10)
CONFIG = "product string, first_year int, last_year int, biases array<string>"


@pytest.fixture
def products(spark):
    return spark.createDataFrame([("A", 2000, 2004, ["RAW", "BC"]), ("B", 2003, 2009, ["RAW"]), ("C", 1990, 2020, ["BC"])], CONFIG)


def test_years_of_each_product(spark, products):
    rows = spark.createDataFrame([(p, y) for p in "ABCD" for y in (1999, 2000, 2003, 2004, 2005, None)], "product string, year int")
    got = {tuple(r) for r in in_years(rows, products).collect()}
    assert got == {(p, y) for p, a, b in (("A", 2000, 2004), ("B", 2003, 2009), ("C", 1990, 2020)) for y in (1999, 2000, 2003, 2004, 2005) if a <= y <= b}


def test_options_and_masked_cells(spark, products):
    amax = spark.createDataFrame([(p, 0, c, 2003, 10.0 * (c + 1)) for p in "ABC" for c in range(3)], "product string, row int, col int, year int, mm double")
    surface = spark.createDataFrame([(p, 0, c, 2.0) for p in "AC" for c in range(2)], "product string, row int, col int, zeta double")
    got = {tuple(r) for r in gauges_to_idf.both_options(amax, surface, products, GRID, GRID).collect()}
    raw = {(p, "RAW", 0, c, 2003, 10.0 * (c + 1)) for p in "AB" for c in range(3)}
    corrected = {(p, "BC", 0, c, 2003, 20.0 * (c + 1)) for p in "AC" for c in range(2)}
    assert got == raw | corrected


@pytest.mark.parametrize("method", ["idw", "ok"])
def test_surface_of_the_nearest_station_inside_the_boundary(spark, method):
    zetas = spark.createDataFrame(
        [("A", "s1", 1.0, 20, 8.5, 1.5), ("A", "s2", 2.0, 20, 2.5, 7.5), ("A", "few", 9.0, 3, 5.0, 5.0)],
        "product string, station_id string, zeta double, n_pairs long, lat double, lon double",
    )
    cells = spark.range(100).select(
        F.lit("A").alias("product"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col")
    ).withColumn("lat", GRID.lat_of(F.col("row"))).withColumn("lon", GRID.lon_of(F.col("col")))
    boundary = spark.range(1).select(F.lit(1).alias("poly_id"), rectangle(F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(10.0)).alias("rings"))
    got = bias_correction.zeta_surface(zetas, cells, 1, method=method, boundary=boundary).collect()
    assert {(r.row, r.col) for r in got} == {(i, j) for i in range(10) for j in range(8)}
    for r in got:
        near = min(((r.lat - la) ** 2 + (r.lon - lo) ** 2, s, z) for s, z, la, lo in (("s1", 1.0, 8.5, 1.5), ("s2", 2.0, 2.5, 7.5)))
        assert r.zeta == pytest.approx(near[2])


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        bias_correction.zeta_surface(spark.createDataFrame([], "product string, station_id string, zeta double, n_pairs long, lat double, lon double"), None, method="spline")


def test_maxima_go_to_the_fit_unwritten(spark, products, monkeypatch):
    """They are read once, so the fit gets the join itself and not a table written by as few tasks as its bytes ask for."""
    zetas = spark.createDataFrame([(p, "s1", 2.0, 20, 8.5, 1.5) for p in "AC"], "product string, station_id string, zeta double, n_pairs long, lat double, lon double")
    monkeypatch.setattr(bias_correction, "station_zetas", lambda *_, **__: zetas)
    monkeypatch.setattr(idf_fit, "parameter_table", lambda maxima, *_: maxima)
    cells = spark.createDataFrame([(0, 0, 9.5, 0.5)], "row int, col int, lat double, lon double")
    amax = spark.createDataFrame([(p, 0, 0, 2003, 10.0) for p in "ABC"], "product string, row int, col int, year int, mm double")
    maxima = gauges_to_idf.parameters_from_gauges(None, None, None, GRID, amax, cells, GRID, products)
    assert "Union" in maxima._jdf.queryExecution().optimizedPlan().toString()
    raw, corrected = {(p, "RAW", 0, 0, 2003, 10.0) for p in "AB"}, {(p, "BC", 0, 0, 2003, 20.0) for p in "AC"}
    assert {tuple(r) for r in maxima.collect()} == raw | corrected
