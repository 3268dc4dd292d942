import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainspark.grid import Grid
from rainspark.operators import kriging, polygons, raster

SHAPES = {
    1: [[(0, 0), (10, 0), (4, 9)]],
    2: [[(5, 1), (15, 1), (15, 12), (5, 12)], [(8, 4), (12, 4), (12, 8), (8, 8)]],        # with a hole
    3: [[(-9, -9), (-5, -9), (-5, -5), (-9, -5)], [(20, 20), (24, 21), (21, 25)]],        # two parts
}


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(k, f"name{k}", [[{"x": float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in SHAPES.items()]
    return spark.createDataFrame(rows, "poly_id int, name string, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("tile", [0.7, 5.0, 100.0])
def test_first_polygon_against_a_loop(spark, shapes, tile):
    rng = random.Random(11)
    pts = [(rng.uniform(-12, 28), rng.uniform(-12, 28)) for _ in range(600)]
    pts += [(6.0, 3.0 + rng.random() / 100) for _ in range(300)]                          # one hot tile
    pts += [(5.0, 5.0), (15.0, 5.0), (-9.0, -9.0), (-5.0, -5.0), (0.0, 0.0)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id int, lon double, lat double")
    got = {r.id: (r.poly_id, r.name) for r in polygons.first_polygon(df, shapes, ["name"], tile=tile).collect()}
    assert len(got) == len(pts)
    for i, (x, y) in enumerate(pts):
        first = next((k for k, v in SHAPES.items() if inside(v, x, y)), None)
        assert got[i] == (first, first and f"name{first}")
    assert polygons.clip_to(df, shapes, tile=tile).count() == sum(v[0] is not None for v in got.values())
    assert polygons.clip_to(df, None) is df


def test_place_label_fallbacks(spark):
    rows = [("a", "b", "c"), (None, "b", "c"), ("", "", "c"), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    got = [tuple(r) for r in df.select(*polygons.place_label(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got == [("a", "a, b, c"), ("b", "b, c"), ("c", "c"), ("—", "—")]


def test_grid_counts_match_arange(spark):
    pts = spark.createDataFrame([(-50.0, -20.0), (-48.7, -19.0)], "lon double, lat double")
    got = raster.build_grid(raster.point_bounds(pts), 0.1, 0.5).toPandas()
    xs, ys = np.arange(-50.5, -48.2 + 0.1, 0.1), np.arange(-20.5, -18.5 + 0.1, 0.1)
    assert len(got) == len(xs) * len(ys)
    np.testing.assert_allclose(np.sort(got.lon.unique()), xs)


def test_idw_is_exact_at_points_and_stays_in_range(spark):
    rng = np.random.default_rng(1)
    pts = pd.DataFrame({"station_id": [f"{i:03d}" for i in range(50)], "lon": rng.uniform(0, 9, 50), "lat": rng.uniform(0, 9, 50), "zeta": rng.uniform(0.5, 3, 50)})
    cells = pd.DataFrame({"lon": np.r_[rng.uniform(-1, 10, 200), pts.lon], "lat": np.r_[rng.uniform(-1, 10, 200), pts.lat]})
    got = raster.idw(spark.createDataFrame(pts), spark.createDataFrame(cells)).toPandas()
    assert got.zeta.between(pts.zeta.min(), pts.zeta.max()).all()
    at = got.merge(pts, on=["lon", "lat"])
    np.testing.assert_allclose(at.zeta_x, at.zeta_y, rtol=1e-9)
    one = got.iloc[0]
    d = np.hypot(pts.lon - one.lon, pts.lat - one.lat).to_numpy()
    near = np.argsort(d)[:8]
    assert one.zeta == pytest.approx(np.sum(pts.zeta.to_numpy()[near] / d[near] ** 2) / np.sum(1 / d[near] ** 2))
    capped = raster.idw(spark.createDataFrame(pts), spark.createDataFrame(cells), limits=(1.0, 1.1)).toPandas()
    assert capped.zeta.between(1.0, 1.1).all()


def test_regrid_is_linear_and_guards_gaps(spark):
    src, dst = Grid(0.0, 10.0, 1.0, 1.0, 10, 10), Grid(0.3, 9.6, 0.5, 0.5, 18, 18)
    rows = [(r, c, None if (r, c) == (5, 5) else 2.0 * c - 3.0 * r) for r in range(10) for c in range(10)]
    cells = spark.createDataFrame(rows, "row int, col int, v double")
    targets = spark.createDataFrame([(r, c) for r in range(18) for c in range(18)], "row int, col int")
    got = {(r.row, r.col): r.v for r in raster.regrid(cells, src, targets, dst, "v").collect()}
    for r in range(18):
        for c in range(18):
            fr, fc = (10 - (9.6 - (r + .5) * .5)) - .5, (0.3 + (c + .5) * .5) - .5
            outside = not (0 <= fr <= 9 and 0 <= fc <= 9)
            gap = abs(fr - 5) < 1 and abs(fc - 5) < 1
            assert ((r, c) in got) == (not outside and not gap)
            if (r, c) in got:
                assert got[r, c] == pytest.approx(2 * fc - 3 * fr)
    same = raster.regrid(cells, src, cells, Grid(0.0, 10.0, 1.0, 1.0, 10, 10), "v")
    assert same.exceptAll(cells).count() == 0 and same.count() == 100


@pytest.mark.parametrize("reach", [1, 3, 8])
def test_fill_takes_the_nearest_good_cell(spark, reach):
    rng = random.Random(6)
    rows = [("g", r, c, rng.random() < 0.15, float(r * 40 + c)) for r in range(40) for c in range(40)]
    rows += [("none", r, 0, False, 1.0) for r in range(3)] + [("all", r, 0, True, float(r)) for r in range(3)]
    df = spark.createDataFrame(rows, "k string, row int, col int, ok boolean, v double")
    good = [(r, c) for k, r, c, ok, _ in rows if k == "g" and ok]
    for x in raster.fill_nearest(df, "ok", ["v"], ["k"], reach=reach).collect():
        if x.k == "none":
            assert (x.v, x.src_row, x.src_dist) == (1.0, None, None)
        elif x.ok:
            assert (x.v, x.src_row, x.src_dist) == ((x.row * 40 + x.col if x.k == "g" else x.row), None, 0.0)
        else:
            d, r, c = min(((x.row - r) ** 2 + (x.col - c) ** 2, r, c) for r, c in good)
            assert (x.v, x.src_row, x.src_col, x.src_dist) == (r * 40 + c, r, c, math.sqrt(d))


def test_bias_is_capped_and_null_stays(spark):
    amax = spark.createDataFrame([("p", 0, 0, 100.0), ("p", 0, 1, 300.0), ("p", 0, 2, None), ("p", 0, 3, 9.0)], "product string, row int, col int, mm double")
    z = spark.createDataFrame([("p", 0, 0, 0.01), ("p", 0, 1, 9.0), ("p", 0, 2, 1.0)], "product string, row int, col int, zeta double")
    got = {r.col: r.mm for r in raster.apply_bias(amax, z).collect()}
    assert got == {0: 25.0, 1: 500.0, 2: None, 3: None}


# kriging ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(9)
    x, y = rng.uniform(0, 10, 90), rng.uniform(0, 10, 90)
    return pd.DataFrame({"station_id": [f"{i:03d}" for i in range(90)], "lon": x, "lat": y, "zeta": 1 + 0.1 * x + 0.3 * np.sin(y)})


@pytest.mark.parametrize("block", [7, 2000])
def test_variogram_counts_every_pair_once(spark, field, block):
    got = kriging.empirical_variogram(spark.createDataFrame(field), block=block).orderBy("lag").toPandas()
    i, j = np.triu_indices(90, 1)
    d = np.hypot(field.lon.to_numpy()[i] - field.lon.to_numpy()[j], field.lat.to_numpy()[i] - field.lat.to_numpy()[j])
    g = 0.5 * (field.zeta.to_numpy()[i] - field.zeta.to_numpy()[j]) ** 2
    lag = np.clip(np.floor((d - d.min()) / ((d.max() - d.min()) / 12)), 0, 11).astype(int)
    assert got.n_pairs.sum() == 90 * 89 // 2
    np.testing.assert_allclose(got.gamma, [g[lag == k].mean() for k in got.lag])
    np.testing.assert_allclose(got.d_mean, [d[lag == k].mean() for k in got.lag])


@pytest.mark.parametrize(("block", "max_lag"), [(25, 0.7), (40, 4.0), (2000, 30.0)])
def test_variogram_up_to_a_largest_lag(spark, field, block, max_lag):
    """Half of the points crowd one tile; points without value do not count."""
    crowd = field.assign(station_id="c" + field.station_id, lon=5 + field.lon / 1000, lat=5 + field.lat / 1000)
    both = pd.concat([field, crowd, field.iloc[:3].assign(station_id=["n1", "n2", "n3"], zeta=None)])
    got = kriging.empirical_variogram(spark.createDataFrame(both), block=block, max_lag=max_lag).orderBy("lag").toPandas()
    x, y, z = (both.dropna()[c].to_numpy() for c in ("lon", "lat", "zeta"))
    i, j = np.triu_indices(180, 1)
    d, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (z[i] - z[j]) ** 2
    d, g = d[d <= max_lag], g[d <= max_lag]
    lag = np.clip(np.floor(d / (max_lag / 12)), 0, 11).astype(int)
    assert got.n_pairs.tolist() == [n for n in np.bincount(lag) if n]
    np.testing.assert_allclose(got.gamma, [g[lag == k].mean() for k in got.lag])


@pytest.mark.parametrize("max_lag", [None, 3.0])
def test_points_at_one_place_meet_as_one_row(spark, max_lag, monkeypatch):
    rng = np.random.default_rng(8)
    n = 600
    pts = pd.DataFrame({"station_id": range(n), "lon": rng.integers(0, 6, n) * 1.0, "lat": rng.integers(0, 5, n) * 1.0, "zeta": 1000 + rng.random(n)})
    kept = {}
    materialise = kriging.materialise
    monkeypatch.setattr(kriging, "materialise", lambda df, name: kept.setdefault(name, materialise(df, name)))
    got = kriging.empirical_variogram(spark.createDataFrame(pts), block=8, max_lag=max_lag).orderBy("lag").toPandas()
    assert kept["krige-blocks"].count() == 30
    x, y, z = (pts[c].to_numpy() for c in ("lon", "lat", "zeta"))
    i, j = np.triu_indices(n, 1)
    d, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (z[i] - z[j]) ** 2
    low, high = (d[d > 0].min(), d.max()) if max_lag is None else (0.0, max_lag)
    d, g = d[d <= high], g[d <= high]
    lag = np.clip(np.floor((d - low) / ((high - low) / 12)), 0, 11).astype(int)
    assert got.n_pairs.tolist() == [c for c in np.bincount(lag) if c]
    np.testing.assert_allclose(got.gamma, [g[lag == k].mean() for k in got.lag], rtol=1e-9)
    np.testing.assert_allclose(got.d_mean, [d[lag == k].mean() for k in got.lag])


def test_few_blocks_meet_up_to_a_largest_lag(spark):
    rng = np.random.default_rng(4)
    pts = pd.DataFrame({"_g": 0, "key": range(4000), "x": rng.uniform(0, 100, 4000), "y": rng.uniform(0, 100, 4000), "z": 1.0})
    placed = kriging._blocks(spark.createDataFrame(pts), ["_g"], 40, 2.0)
    blocks = placed.select("block").distinct().count()
    assert kriging._pairs_of_blocks(placed, ["_g"], 2.0).count() <= 9 * blocks
    assert kriging._pairs_of_blocks(placed, ["_g"], None).count() == blocks * (blocks + 1) // 2


def test_solve_agrees_with_the_pseudo_inverse(field):
    """Twins, regular neighbours and a variogram without any variance in one batch."""
    x, y, z = (np.array(field[c][:24]).reshape(4, 6) for c in ("lon", "lat", "zeta"))
    x[1, 1], y[1, 1] = x[1, 0], y[1, 0]
    d0 = np.hypot(x - 3.0, y - 3.0)
    for v in (kriging.Variogram("spherical", 1.0, 4.0, 0.1), kriging.Variogram("spherical", 0.0, 1.0, 0.0)):
        want = []
        for r in range(4):
            a = np.ones((7, 7))
            d = np.hypot(x[r][:, None] - x[r], y[r][:, None] - y[r])
            a[:6, :6], a[6, 6] = np.where(d > 0, v(d), 0.0), 0.0
            want.append((np.linalg.pinv(a) @ np.append(v(d0[r]), 1.0))[:6] @ z[r])
        np.testing.assert_allclose(kriging._solve(x, y, z, d0, v), want, atol=1e-9)


def test_points_at_one_place_are_solved_as_one(monkeypatch):
    """As the pseudo-inverse of all points has it, from systems of as many rows as there are places."""
    rng = np.random.default_rng(11)
    x, y = rng.uniform(0, 9, (2, 40, 8))
    for r in range(1, 40):
        take = rng.integers(0, 1 + r % 8, 8)
        x[r], y[r] = x[r][take], y[r][take]
    z, d0 = rng.uniform(0.2, 5, (40, 8)), np.hypot(x - 4, y - 4)
    sizes = []
    inverse = np.linalg.pinv
    for v in (kriging.Variogram("spherical", 2.0, 5.0, 0.1), kriging.Variogram("linear", 0.5, 1.0, 0.0), kriging.Variogram("spherical", 0.0, 1.0, 0.0)):
        want = []
        for r in range(40):
            a = np.ones((9, 9))
            d = np.hypot(x[r][:, None] - x[r], y[r][:, None] - y[r])
            a[:8, :8], a[8, 8] = np.where(d > 0, v(d), 0.0), 0.0
            want.append((inverse(a, hermitian=True, rcond=1e-12) @ np.append(np.where(d0[r] > 0, v(d0[r]), 0.0), 1.0))[:8] @ z[r])
        with monkeypatch.context() as at:
            at.setattr(np.linalg, "pinv", lambda a, **b: sizes.append(len(a)) or inverse(a, **b))
            np.testing.assert_allclose(kriging._solve(x, y, z, d0, v), want, atol=1e-9)
        # without any variance all places are alike, and only then there is no other way
        assert v.sill == 0 or not sizes


@pytest.mark.parametrize("model", kriging.MODELS)
def test_kriging_is_exact_at_data_and_keeps_constants(spark, field, model):
    pts = spark.createDataFrame(field)
    v = kriging.Variogram(model, 1.0, 1.5 if model == "power" else 4.0, 0.0)
    cells = spark.createDataFrame(field[["lon", "lat"]].iloc[:20].reset_index())
    got = kriging.local_kriging(pts, cells, fitted={(): v}, limits=None).orderBy("index").toPandas()
    np.testing.assert_allclose(got.zeta, field.zeta.iloc[:20], atol=1e-5)
    away = spark.createDataFrame(pd.DataFrame({"lon": [0.2, 5.5, 20.0], "lat": [0.1, 4.4, -3.0]}))
    flat = kriging.local_kriging(pts.withColumn("zeta", F.lit(1.7)), away, fitted={(): v}).toPandas()
    np.testing.assert_allclose(flat.zeta, 1.7, atol=1e-6)       # weights sum to 1


def test_fitted_variogram_and_twins(spark, field):
    lags = kriging.empirical_variogram(spark.createDataFrame(field)).toPandas()
    v = kriging.fit_variogram(lags)
    assert v.sill >= 0 and v.nugget >= 0 and v.reach > 0
    with pytest.raises(ValueError, match="unknown variogram"):
        kriging.fit_variogram(lags, "cubic")
    twins = pd.concat([field, field.assign(station_id="t" + field.station_id)])
    cells = spark.createDataFrame(pd.DataFrame({"lon": [5.05], "lat": [4.95]}))
    z = kriging.local_kriging(spark.createDataFrame(twins), cells).toPandas().zeta[0]
    assert z == pytest.approx(1 + 0.505 + 0.3 * np.sin(4.95), abs=0.15)


def test_each_group_has_its_own_variogram(spark, field):
    two = pd.concat([field.assign(product="a"), field.assign(product="b", zeta=5 - field.zeta)])
    pts = spark.createDataFrame(two)
    lags = kriging.empirical_variogram(pts, groups=["product"], block=40).toPandas()
    alone = kriging.empirical_variogram(spark.createDataFrame(field)).toPandas().sort_values("lag")
    for p in "ab":
        np.testing.assert_allclose(lags[lags["product"] == p].sort_values("lag").gamma, alone.gamma)
    cells = spark.createDataFrame(pd.DataFrame({"product": ["a", "b", "c"], "lon": 5.1, "lat": 5.2}))
    got = kriging.local_kriging(pts, cells, groups=["product"], limits=None).toPandas().set_index("product").zeta
    assert got["a"] == pytest.approx(5 - got["b"]) and np.isnan(got["c"])
