"""Raster, spatial, extreme-value, parameter and serving queries."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import case, r6, rounded
from checks.sql_views import DUR_SQL, PERIODS_SQL, r6 as q6
from rainspark.grid import CURVE_DURATIONS_MIN, CURVE_RETURN_PERIODS, DESIGN_POINTS, PARAMETER_BANDS
from rainspark.operators import (
    bias, diagnostics, disaggregation, gumbel, kriging, mapping, polygons, raster, serving, sherman,
)
from rainspark.operators.neighbours import nearest_k
from rainspark.plans import bias_correction, gauges_to_idf, idf_fit
from rainspark.session import shared_folder
from rainspark.sources import parameter_store, rasters

RC = 'r AS "row", c AS col'
CELL = ["product", "bias", "row", "col"]


def _zetas(spark, d):
    return bias_correction.station_zetas(
        t.gauge_daily(spark, d), t.stations(spark, d), t.product_daily(spark, d), t.COARSE
    )


def _located(spark, d):
    return raster.cell_centres(t.fine_cells(spark, d), t.FINE)


def _product_cells(spark, d):
    products = F.explode(F.array(*[F.lit(p) for p, _ in t.FACTORS])).alias("product")
    return _located(spark, d).select(products, "row", "col", "lat", "lon")


# rasters and neighbours -----------------------------------------------------------------------
@case("grid_nodes", """
SELECT CAST(i AS INTEGER) AS iy, CAST(j AS INTEGER) AS ix, miny - 0.5e0 + i * 0.5e0 AS lat, minx - 0.5e0 + j * 0.5e0 AS lon
FROM (SELECT min(lon) AS minx, max(lon) AS maxx, min(lat) AS miny, max(lat) AS maxy FROM v_stations),
     range(1000) a(i), range(1000) b(j)
WHERE i < ceil((maxy + 0.5e0 + 0.5e0 - (miny - 0.5e0)) / 0.5e0) AND j < ceil((maxx + 0.5e0 + 0.5e0 - (minx - 0.5e0)) / 0.5e0)""")
def grid_nodes(spark, d):
    return raster.build_grid(raster.point_bounds(t.stations(spark, d)), 0.5, 0.5)


NEAR_SQL = """
SELECT k.r, k.c, s.code, (k.lon - s.lon) * (k.lon - s.lon) + (k.lat - s.lat) * (k.lat - s.lat) AS d2,
       row_number() OVER (PARTITION BY k.r, k.c ORDER BY
         (k.lon - s.lon) * (k.lon - s.lon) + (k.lat - s.lat) * (k.lat - s.lat), s.code) AS rank
FROM v_cells k, v_stations s"""


@case("nearest_stations", f"""
SELECT {RC}, CAST(rank AS INTEGER) AS rank, code, {q6('d2')} AS d2 FROM ({NEAR_SQL}) WHERE rank <= 8""")
def nearest_stations(spark, d):
    near = nearest_k(_located(spark, d), t.stations(spark, d), 8, tie=["code"], x="lon", y="lat")
    return near.select("row", "col", F.posexplode("neighbours").alias("p", "n")).select(
        "row", "col", (F.col("p") + 1).alias("rank"), "n.code", r6("n.d2").alias("d2")
    )


@case("idw_surface", f"SELECT product, {RC}, {q6('zeta')} AS zeta FROM v_surface")
def idw_surface(spark, d):
    surface = bias_correction.zeta_surface(_zetas(spark, d), _product_cells(spark, d))
    return surface.filter("zeta IS NOT NULL").select("product", "row", "col", r6("zeta").alias("zeta"))


@case("bias_corrected_maxima", f"""
SELECT a.product, a.r AS "row", a.c AS col, a.y AS year,
       CASE WHEN zeta IS NOT NULL THEN {q6('least(mm * least(greatest(zeta, 0.25e0), 5e0), 500e0)')} END AS mm
FROM v_amax a LEFT JOIN v_surface z USING (product, r, c)""")
def bias_corrected_maxima(spark, d):
    """The whole chain: gauges and products to pairs, factors, surface and corrected maxima."""
    surface = bias_correction.zeta_surface(_zetas(spark, d), _product_cells(spark, d))
    maxima = bias_correction.corrected_maxima(t.fine_amax(spark, d), surface, t.FINE, t.FINE)
    return rounded(maxima.select("product", "row", "col", "year", "mm"), "mm")


@case("boundary_grid", f"""
SELECT CAST(i AS INTEGER) AS iy, CAST(j AS INTEGER) AS ix, miny - 0.25e0 + i * 0.5e0 AS lat, minx - 0.25e0 + j * 0.5e0 AS lon
FROM (SELECT min(x1) AS minx, max(x2) AS maxx, min(y1) AS miny, max(y2) AS maxy FROM v_areas),
     range(200) u(i), range(200) v(j)
WHERE i < ceil((maxy + 0.25e0 + 0.5e0 - (miny - 0.25e0)) / 0.5e0) AND j < ceil((maxx + 0.25e0 + 0.5e0 - (minx - 0.25e0)) / 0.5e0)
  AND EXISTS (SELECT 1 FROM v_areas s WHERE minx - 0.25e0 + j * 0.5e0 >= s.x1 AND minx - 0.25e0 + j * 0.5e0 < s.x2
              AND miny - 0.25e0 + i * 0.5e0 >= s.y1 AND miny - 0.25e0 + i * 0.5e0 < s.y2)""")
def boundary_grid(spark, d):
    """Nodes around the boundary's envelope, kept where they fall inside it."""
    boundary = t.areas(spark, d)
    nodes = raster.build_grid(raster.polygon_bounds(boundary), 0.5, 0.25)
    return polygons.clip_to(nodes, boundary, tile=2.0)


@case("local_kriging")
def local_kriging(spark, d):
    """No SQL: a linear system per cell; see the kriging tests."""
    points = bias.interpolation_points(_zetas(spark, d))
    return kriging.local_kriging(points, _product_cells(spark, d), groups=["product"])


def _ranked_zetas(k):
    """The k nearest points of each product and cell, as columns."""
    cols = ", ".join(
        f"max({c}) FILTER (rank = {i}) AS {c}{i}" for i in range(1, k + 1) for c in ("zeta", "d", "lon", "lat")
    )
    return f"""
SELECT product, r, c, {cols}, avg(zeta) FILTER (rank <= {k}) AS mean, min(d) AS nearest FROM (
  SELECT z.product, k.r, k.c, z.zeta, z.lon, z.lat,
         sqrt((k.lon - z.lon) * (k.lon - z.lon) + (k.lat - z.lat) * (k.lat - z.lat)) AS d,
         row_number() OVER (PARTITION BY z.product, k.r, k.c ORDER BY
           (k.lon - z.lon) * (k.lon - z.lon) + (k.lat - z.lat) * (k.lat - z.lat), z.station_id) AS rank
  FROM v_cells k, v_zeta z WHERE z.zeta BETWEEN 0.05 AND 10) GROUP BY product, r, c"""


def _between(i, j):
    """Distance of the i-th and j-th nearest point."""
    return f"sqrt((lon{i} - lon{j}) * (lon{i} - lon{j}) + (lat{i} - lat{j}) * (lat{i} - lat{j}))"


def _gamma(x):
    """Spherical model with sill 2, range 15 and nugget 0.1."""
    return f"(CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 15 THEN 2.1e0 ELSE 0.1e0 + 2e0 * (1.5e0 * {x} / 15e0 - 0.5e0 * pow({x} / 15e0, 3)) END)"


@case("kriging_two_points", f"""
SELECT product, {RC}, {q6('w * zeta1 + (1 - w) * zeta2')} AS zeta FROM (
  SELECT *, ({_gamma('d12')} + {_gamma('d2')} - {_gamma('d1')}) / (2e0 * {_gamma('d12')}) AS w FROM (
    SELECT *, sqrt((lon1 - lon2) * (lon1 - lon2) + (lat1 - lat2) * (lat1 - lat2)) AS d12 FROM ({_ranked_zetas(2)})))""")
def kriging_two_points(spark, d):
    """With two neighbours the system has a closed form."""
    points = bias.interpolation_points(_zetas(spark, d))
    model = kriging.Variogram("spherical", 2.0, 15.0, 0.1)
    fitted = {(p,): model for p, _ in t.FACTORS}
    z = kriging.local_kriging(points, _product_cells(spark, d), 2, groups=["product"], fitted=fitted)
    return z.filter("zeta IS NOT NULL").select("product", "row", "col", r6("zeta").alias("zeta"))


@case("kriging_pure_nugget", f"SELECT product, {RC}, {q6('mean')} AS zeta FROM ({_ranked_zetas(5)})")
def kriging_pure_nugget(spark, d):
    """Without spatial structure all neighbours weigh the same."""
    points = bias.interpolation_points(_zetas(spark, d))
    fitted = {(p,): kriging.Variogram("spherical", 0.0, 1.0, 1.0) for p, _ in t.FACTORS}
    z = kriging.local_kriging(points, _product_cells(spark, d), 5, groups=["product"], fitted=fitted)
    return z.filter("zeta IS NOT NULL").select("product", "row", "col", r6("zeta").alias("zeta"))


@case("kriging_three_points", f"""
SELECT product, {RC}, {q6('w1 * zeta1 + w2 * zeta2 + (1 - w1 - w2) * zeta3')} AS zeta FROM (
  SELECT *, (u * e - b * v) / (a * e - b * b) AS w1, (a * v - b * u) / (a * e - b * b) AS w2 FROM (
    SELECT *, -2e0 * g13 AS a, g12 - g23 - g13 AS b, -2e0 * g23 AS e, g1 - g3 - g13 AS u, g2 - g3 - g23 AS v FROM (
      SELECT *, {_gamma('d1')} AS g1, {_gamma('d2')} AS g2, {_gamma('d3')} AS g3,
             {_gamma(_between(1, 2))} AS g12, {_gamma(_between(1, 3))} AS g13, {_gamma(_between(2, 3))} AS g23
      FROM ({_ranked_zetas(3)}))))""")
def kriging_three_points(spark, d):
    """Three neighbours: two of the weights by elimination."""
    points = bias.interpolation_points(_zetas(spark, d))
    fitted = {(p,): kriging.Variogram("spherical", 2.0, 15.0, 0.1) for p, _ in t.FACTORS}
    z = kriging.local_kriging(points, _product_cells(spark, d), 3, groups=["product"], fitted=fitted)
    return z.filter("zeta IS NOT NULL").select("product", "row", "col", r6("zeta").alias("zeta"))


@case("variogram_to_largest_lag", f"""
SELECT product, CAST(lag AS INTEGER) AS lag, {q6('avg(d)')} AS d_mean, {q6('avg(g)')} AS gamma, count(*) AS n_pairs FROM (
  SELECT product, d, g, least(floor(d / (6e0 / 12e0)), 11) AS lag FROM (
    SELECT a.product, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS d,
           0.5e0 * (a.zeta - b.zeta) * (a.zeta - b.zeta) AS g
    FROM v_zeta a JOIN v_zeta b ON a.product = b.product AND a.station_id < b.station_id) WHERE d <= 6)
GROUP BY 1, 2""")
def variogram_to_largest_lag(spark, d):
    """Only blocks within the largest lag of each other meet."""
    points = bias.interpolation_points(_zetas(spark, d))
    return rounded(kriging.empirical_variogram(points, groups=["product"], block=32, max_lag=6.0), "d_mean", "gamma")


@case("empirical_variogram", f"""
SELECT product, CAST(lag AS INTEGER) AS lag, {q6('avg(d)')} AS d_mean, {q6('avg(g)')} AS gamma, count(*) AS n_pairs FROM (
  SELECT product, d, g, greatest(least(floor((d - lo) / ((hi - lo) / 12e0)), 11), 0) AS lag FROM (
    SELECT *, min(d) FILTER (d > 0) OVER (PARTITION BY product) AS lo, max(d) OVER (PARTITION BY product) AS hi FROM (
      SELECT a.product, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS d,
             0.5e0 * (a.zeta - b.zeta) * (a.zeta - b.zeta) AS g
      FROM v_zeta a JOIN v_zeta b ON a.product = b.product AND a.station_id < b.station_id)))
GROUP BY 1, 2""")
def empirical_variogram(spark, d):
    points = bias.interpolation_points(_zetas(spark, d))
    lags = kriging.empirical_variogram(points, groups=["product"])
    return rounded(lags, "d_mean", "gamma")


REGRID_SQL = f"""
SELECT product, r, c, CASE WHEN count(z) = count(*) THEN sum(w * z) END AS zeta FROM (
  SELECT g.r, g.c, p.product, w, z.zeta AS z FROM (
    SELECT r, c, r0 + i AS sr, c0 + j AS sc,
           (CASE WHEN i = 1 THEN fr - r0 ELSE 1e0 - (fr - r0) END) * (CASE WHEN j = 1 THEN fc - c0 ELSE 1e0 - (fc - c0) END) AS w
    FROM (SELECT r, c, fr, fc, floor(fr) AS r0, floor(fc) AS c0 FROM (
      SELECT r, c, round((5e0 - (4.9e0 - (r + 0.5e0) * 0.25e0)) / 0.19e0 - 0.5e0, 9) AS fr,
             round((-72.9e0 + (c + 0.5e0) * 0.5e0 + 73e0) / 0.38e0 - 0.5e0, 9) AS fc
      FROM (SELECT DISTINCT floor((4.9e0 - lat) / 0.25e0) AS r, floor((lon + 72.9e0) / 0.5e0) AS c FROM v_cells)
      WHERE r >= 0 AND c BETWEEN 0 AND 74)), range(2) a(i), range(2) b(j)) g
  CROSS JOIN (SELECT DISTINCT product FROM v_zeta_cells) p
  LEFT JOIN v_zeta_cells z ON z.r = g.sr AND z.c = g.sc AND z.product = p.product WHERE w > 0)
GROUP BY product, r, c"""


def _targets(spark, d):
    cells = _located(spark, d)
    row, col = t.TARGET.row_of(F.col("lat")), t.TARGET.col_of(F.col("lon"))
    return cells.select(row.alias("row"), col.alias("col")).filter(
        t.TARGET.inside(F.col("row"), F.col("col"))
    ).distinct()


@case("regrid_bilinear", f"""
SELECT product, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {q6('zeta')} AS zeta FROM ({REGRID_SQL}) WHERE zeta IS NOT NULL""")
def regrid_bilinear(spark, d):
    return rounded(
        raster.regrid(t.zeta_cells(spark, d), t.FINE, _targets(spark, d), t.TARGET, "zeta", ["product"]), "zeta"
    )


@case("regrid_same_grid", f"SELECT product, {RC}, zeta FROM v_zeta_cells")
def regrid_same_grid(spark, d):
    same = dataclasses.replace(t.FINE, x0=t.FINE.x0 + 1e-12)
    return raster.regrid(t.zeta_cells(spark, d), same, t.fine_cells(spark, d), t.FINE, "zeta", ["product"])


@case("apply_bias", f"""
SELECT product, {RC}, y AS year, {q6('least(mm * least(greatest(zeta, 0.25e0), 5e0), 500e0)')} AS mm
FROM v_amax JOIN v_zeta_cells USING (product, r, c)""")
def apply_bias(spark, d):
    return rounded(raster.apply_bias(t.fine_amax(spark, d), t.zeta_cells(spark, d)), "mm")


@case("corrected_maxima_regridded", f"""
SELECT a.product, a.r AS "row", a.c AS col, a.y AS year,
       CASE WHEN zeta IS NOT NULL THEN {q6('least(mm * least(greatest(zeta, 0.25e0), 5e0), 500e0)')} END AS mm
FROM (SELECT product, floor((4.9e0 - (5e0 - (r + 0.5e0) * 0.19e0)) / 0.25e0)::INTEGER AS r,
             floor((-73e0 + (c + 0.5e0) * 0.38e0 + 72.9e0) / 0.5e0)::INTEGER AS c, y, max(mm) AS mm FROM v_amax GROUP BY 1, 2, 3, 4) a
LEFT JOIN ({REGRID_SQL}) z ON z.product = a.product AND z.r = a.r AND z.c = a.c
WHERE a.r >= 0 AND a.c BETWEEN 0 AND 74""")
def corrected_maxima_regridded(spark, d):
    """Maxima on a coarser grid than the factors."""
    fine = raster.cell_centres(t.fine_amax(spark, d), t.FINE)
    coarse = (
        fine.withColumn("row", t.TARGET.row_of(F.col("lat"))).withColumn("col", t.TARGET.col_of(F.col("lon")))
        .filter(t.TARGET.inside(F.col("row"), F.col("col")))
        .groupBy("product", "row", "col", "year").agg(F.max("mm").alias("mm"))
    )
    return rounded(
        bias_correction.corrected_maxima(coarse, t.zeta_cells(spark, d), t.FINE, t.TARGET), "mm"
    )


@case("elevation_at_stations", f"""
SELECT s.code, k.elev_m FROM v_stations s LEFT JOIN v_cells k
ON k.r = floor((5e0 - s.lat) / 0.19e0) AND k.c = floor((s.lon + 73e0) / 0.38e0)""")
def elevation_at_stations(spark, d):
    return raster.sample_raster(
        t.stations(spark, d).select("code", "lat", "lon"), t.elevation(spark, d), t.FINE, ["elev_m"]
    ).select("code", "elev_m")


INSIDE = "s.lon >= a.x1 AND s.lon < a.x2 AND s.lat >= a.y1 AND s.lat < a.y2"


@case("place_labels", f"""
SELECT s.code, coalesce(a.adm2, '—') AS place, coalesce(a.adm2 || ', ' || a.adm1 || ', ' || a.adm0, '—') AS place_full
FROM v_stations s LEFT JOIN v_areas a ON {INSIDE}""")
def place_labels(spark, d):
    found = polygons.first_polygon(
        t.stations(spark, d).select("code", "lat", "lon"), t.areas(spark, d), ["adm2", "adm1", "adm0"], tile=2.0
    )
    return found.select("code", *polygons.place_label(F.col("adm2"), F.col("adm1"), F.col("adm0")))


@case("cells_in_countries", f"""
SELECT s.r AS "row", s.c AS col FROM v_cells s JOIN v_areas a ON {INSIDE} WHERE a.adm0 IN (
  (SELECT min(r_name) FROM region), (SELECT max(r_name) FROM region))""")
def cells_in_countries(spark, d):
    names = t.table(spark, d, "region").agg(F.min("r_name"), F.max("r_name")).first()
    inside = serving.in_countries(t.areas(spark, d), list(names))
    return polygons.clip_to(_located(spark, d), inside, tile=2.0).select("row", "col")


# cell statistics --------------------------------------------------------------------------------
@case("grid_annual_max", f"SELECT product, {RC}, y AS year, mm, 'annual_max' AS stat FROM v_amax")
def grid_annual_max(spark, d):
    return gumbel.grid_annual_max(t.fine_daily(spark, d))


@case("mean_annual_total", f"""
SELECT product, {RC}, {q6('avg(total)')} AS mean_ann, count(*) AS n_years FROM (
  SELECT product, r, c, year(date) AS y, sum(pr_p) AS total FROM v_fine_daily GROUP BY ALL) GROUP BY product, r, c""")
def mean_annual_total(spark, d):
    return rounded(gumbel.mean_annual_total(t.fine_daily(spark, d)), "mean_ann")


TOTALS = "SELECT product, r, c, avg(total) AS v FROM (SELECT product, r, c, year(date) AS y, sum(pr_p) AS total FROM v_fine_daily GROUP BY ALL) GROUP BY product, r, c"


@case("raster_summary", f"""
SELECT product, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS std, count(*) AS n FROM ({TOTALS}) GROUP BY 1""")
def raster_summary(spark, d):
    totals = gumbel.mean_annual_total(t.fine_daily(spark, d))
    return rounded(diagnostics.raster_summary(totals, ["product"], "mean_ann"), "mean", "std")


@case("rain_classes", f"""
SELECT product, CAST(least(floor((least(greatest(v, 50e0), 450e0) - 50e0) / 40e0), 9) AS INTEGER) AS class, count(*) AS n
FROM ({TOTALS}) GROUP BY 1, 2""")
def rain_classes(spark, d):
    totals = gumbel.mean_annual_total(t.fine_daily(spark, d))
    return diagnostics.equal_width_classes(totals, "mean_ann", 50.0, 450.0, 10, ["product"])


@case("cell_stats", f"""
SELECT product, bias, {RC}, {q6('m')} AS AMD_mean, {q6('s')} AS AMD_std, n AS Nyears FROM v_stats""")
def cell_stats(spark, d):
    return rounded(gumbel.cell_stats(t.corrected_amax(spark, d), CELL), "AMD_mean", "AMD_std")


@case("gumbel_ks", f"""
SELECT t.product, t.bias, t.r AS "row", t.c AS col, {q6('m')} AS AMD_mean, {q6('s')} AS AMD_std, t.n AS Nyears,
       {q6('x.d')} AS KS_D, {q6('x.p')} AS KS_p, CASE WHEN x.p < 0.05 THEN 1 ELSE 0 END AS KS_reject
FROM v_stats t LEFT JOIN v_ksp x USING (product, bias, r, c)""")
def gumbel_ks(spark, d):
    return rounded(gumbel.gumbel_ks(t.corrected_amax(spark, d), CELL), "AMD_mean", "AMD_std", "KS_D", "KS_p")


@case("gumbel_quantiles", f"SELECT product, bias, {RC}, t AS T, {q6('q')} AS Q FROM v_quant")
def gumbel_quantiles(spark, d):
    return rounded(gumbel.gumbel_quantiles(gumbel.cell_stats(t.corrected_amax(spark, d), CELL), CELL), "Q")


@case("design_intensities", f"""
SELECT product, bias, {RC}, t AS T, d AS duration_min, {q6('q * f / (d / 60e0)', 5)} AS intensity
FROM v_quant, {DUR_SQL}""")
def design_intensities(spark, d):
    """Every cell, return period and duration under the fixed ratios."""
    q = gumbel.gumbel_quantiles(gumbel.cell_stats(t.corrected_amax(spark, d), CELL), CELL)
    ratios = disaggregation.cetesb(spark).select(F.explode(F.array(*[F.lit(b) for b in ("RAW", "BC")])).alias("bias"), "ratio")
    return rounded(sherman.intensity_table(q, ratios, ["bias"], CELL), "intensity", digits=5)


# disaggregation -----------------------------------------------------------------------------------
@case("station_disaggregation", f"""
SELECT n.r AS "row", n.c AS col, n.code AS station, u.d AS duration_min, {q6('u.ratio')} AS ratio
FROM v_near_station n JOIN v_usable u USING (code)""")
def station_disaggregation(spark, d):
    usable = disaggregation.usable_stations(t.station_table(spark, d))
    near = disaggregation.station_ratios(usable, _located(spark, d))
    return _opened(near, "row", "col", "station")


def _opened(df, *keys):
    minutes = F.array(*[F.lit(x) for x in disaggregation.DURATIONS_MIN])
    return df.select(*keys, F.explode(F.arrays_zip(minutes.alias("d"), F.col("ratio").alias("v"))).alias("i")).select(
        *keys, F.col("i.d").alias("duration_min"), r6("i.v").alias("ratio")
    )


@case("ratio_repair", f"""
SELECT r AS "row", c AS col, d AS duration_min, {q6('ratio')} AS ratio, violations, {q6('magnitude')} AS magnitude, problem
FROM v_repaired JOIN v_verdict USING (r, c)""")
def ratio_repair(spark, d):
    fixed = disaggregation.repaired_ratios(disaggregation.ratio_vectors(t.ratio_cells(spark, d)))
    return rounded(_opened(fixed, "row", "col", "violations", "magnitude", "problem"), "magnitude")


@case("ratio_repair_summary", f"""
SELECT count(*) AS n_cells, {q6('avg(CASE WHEN violations > 0 THEN 1e0 ELSE 0e0 END)')} AS repaired_share,
       CAST(sum(violations) AS BIGINT) AS lifts, {q6('sum(magnitude)', 4)} AS lift_sum,
       {q6('coalesce((SELECT median(lift) FROM v_repaired WHERE lifted), 0e0)')} AS lift_median FROM v_verdict""")
def ratio_repair_summary(spark, d):
    s = disaggregation.repair_summary(disaggregation.ratio_vectors(t.ratio_cells(spark, d)))
    return rounded(rounded(s, "repaired_share", "lift_median"), "lift_sum", digits=4)


@case("raster_disaggregation", f"""
SELECT s.r AS "row", s.c AS col, f.d AS duration_min, {q6('f.ratio')} AS ratio, violations, {q6('magnitude')} AS magnitude,
       problem, sr AS src_row, sc AS src_col, {q6('dist')} AS src_dist
FROM v_source s JOIN v_filled f USING (r, c)""")
def raster_disaggregation(spark, d):
    filled = disaggregation.raster_ratios(disaggregation.ratio_vectors(t.ratio_cells(spark, d)))
    keys = ["row", "col", "violations", "magnitude", "problem", "src_row", "src_col", "src_dist"]
    return rounded(_opened(filled, *keys), "magnitude", "src_dist")


# fits -----------------------------------------------------------------------------------------------
PARAM_SQL = ", ".join(
    f"{q6(sql, digits)} AS {name}" for name, sql, digits in (
        ("K", "k", 3), ("a", "a", 6), ("b", "b", 4), ("c", "cc", 6), ("R2", "r2", 6), ("RMSE", "rmse", 5), ("MSE", "mse", 4),
    )
)


def _param_round(df):
    for names, digits in ((["K"], 3), (["a", "c", "R2"], 6), (["b", "MSE"], 4), (["RMSE"], 5)):
        df = rounded(df, *names, digits=digits)
    return df


@case("duration_fits", f"""
SELECT disagg, {RC}, {q6('f.b', 4)} AS b, {q6('f.c')} AS c, {q6('xm')} AS xm, {q6('zm')} AS zm
FROM (SELECT disagg, v.r, v.c AS col0, vid FROM v_cell_vec v) v JOIN v_fit_bc f USING (vid)""".replace(
    f"{RC}", 'v.r AS "row", v.col0 AS col'))
def duration_fits(spark, d):
    vectors = disaggregation.ratio_vectors(t.ratio_cells(spark, d))
    fits = idf_fit.duration_fits(_located(spark, d), t.station_table(spark, d), vectors)
    return fits.select(
        "disagg", "row", "col", r6("dur.b", 4).alias("b"), r6("dur.c").alias("c"),
        r6("dur.xm").alias("xm"), r6("dur.zm").alias("zm"),
    )


@case("sherman_fit", f"""
SELECT product, bias, {RC}, {PARAM_SQL}
FROM v_params WHERE disagg = 'CETESB' AND k IS NOT NULL""")
def sherman_fit(spark, d):
    fits = idf_fit.duration_fits(t.fine_cells(spark, d))
    fitted = idf_fit.fit_parameters(t.corrected_amax(spark, d), fits).filter("K IS NOT NULL")
    return _param_round(fitted.select(*CELL, *idf_fit.FITTED))


def _all_params(spark, d):
    return idf_fit.parameter_table(
        t.corrected_amax(spark, d), _located(spark, d), t.station_table(spark, d),
        disaggregation.ratio_vectors(t.ratio_cells(spark, d)),
    )


@case("parameter_table", f"""
SELECT product, bias, disagg, {RC}, {PARAM_SQL}, {q6('ks_d')} AS KS_D, {q6('ks_p')} AS KS_p, ks_reject AS KS_reject,
       {q6('m')} AS AMD_mean, {q6('s')} AS AMD_std, n AS Nyears FROM v_final""")
def parameter_table(spark, d):
    """Four products, raw and corrected, three modes, filled: the complete run."""
    table = _all_params(spark, d).select("product", "bias", "disagg", "row", "col", *PARAMETER_BANDS)
    return _param_round(rounded(table, "KS_D", "KS_p", "AMD_mean", "AMD_std"))


def _from_gauges(spark, d, method, k):
    return gauges_to_idf.parameters_from_gauges(
        t.gauge_daily(spark, d), t.stations(spark, d), t.product_daily(spark, d), t.COARSE,
        t.fine_amax(spark, d), _located(spark, d), t.FINE, t.dated_products(spark), method=method, k=k,
        boundary=t.domain(spark, d), station_ratios=t.station_table(spark, d),
        vectors=disaggregation.ratio_vectors(t.ratio_cells(spark, d)),
    ).select("product", "bias", "disagg", "row", "col", *PARAMETER_BANDS)


@case("idf_from_gauges", f"""
SELECT product, bias, disagg, {RC}, {PARAM_SQL}, {q6('ks_d')} AS KS_D, {q6('ks_p')} AS KS_p, ks_reject AS KS_reject,
       {q6('m')} AS AMD_mean, {q6('s')} AS AMD_std, n AS Nyears FROM v_final_gauges""")
def idf_from_gauges(spark, d):
    """Gauges to factors, masked surface, corrected maxima and parameters, in the years of each product."""
    return _param_round(rounded(_from_gauges(spark, d, "idw", 8), "KS_D", "KS_p", "AMD_mean", "AMD_std"))


@case("idf_from_gauges_kriged")
def idf_from_gauges_kriged(spark, d):
    """The same with ordinary kriging. No SQL: a linear system per cell; see the chain's tests."""
    return _from_gauges(spark, d, "ok", 8)


@case("parameter_bands_by_position", f"""
SELECT product, bias, {RC}, {q6('k', 3)} AS K, {q6('a')} AS a, {q6('b', 4)} AS b, {q6('cc')} AS c
FROM v_params WHERE disagg = 'CETESB' AND k IS NOT NULL""")
def parameter_bands_by_position(spark, d):
    """A stack whose band names were lost is read by band order."""
    fits = idf_fit.duration_fits(t.fine_cells(spark, d))
    fitted = idf_fit.fit_parameters(t.corrected_amax(spark, d), fits).filter("K IS NOT NULL")
    unnamed = fitted.select(
        *CELL, *[F.col(b).alias(f"band_{i + 1}") for i, b in enumerate(PARAMETER_BANDS)]
    )
    stack = rasters.compact_stack(unnamed, CELL).select(*CELL, "K", "a", "b", "c")
    return rounded(rounded(rounded(stack, "a", "c"), "K", digits=3), "b", digits=4)


# quantile mapping and flows ------------------------------------------------------------------------
PROBS = (0.8, 0.9, 0.95, 0.98, 1.0)
KNOTS_SQL = "SELECT code, " + ", ".join(
    f"quantile_cont(pr_p, {p}) AS p{i}, quantile_cont(pr_g, {p}) AS g{i}" for i, p in enumerate(PROBS)
) + " FROM v_station_daily WHERE pr_p IS NOT NULL GROUP BY code HAVING count(*) >= 30 AND code <> '00000007'"


def _models(spark, d):
    """Models as the JSON text they come in: one object per station."""
    daily = t.station_pairs_daily(spark, d).filter("pr_p IS NOT NULL")
    probs = F.array(*[F.lit(p) for p in PROBS])
    knots = daily.groupBy("code").agg(
        F.count("*").alias("n"), F.percentile("pr_p", probs).alias("p_q"), F.percentile("pr_g", probs).alias("g_q")
    ).filter("n >= 30 AND code <> '00000007'")
    text = F.to_json(F.create_map("code", F.struct(F.lit(0.8).alias("q0"), "p_q", "g_q")))
    return mapping.parse_models(knots.select(text.alias("value")))


@case("paired_annual_max", """
SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_p) AS prod_ams, max(pr_g) AS gauge_ams
FROM v_station_daily GROUP BY 1, 2""")
def paired_annual_max(spark, d):
    return mapping.paired_annual_max(t.station_pairs_daily(spark, d))


@case("ecdf_position", f"""
SELECT q.code, q.year, q.gauge_ams AS v, CASE WHEN n = 0 THEN NULL WHEN v <= lo THEN 0e0 WHEN v >= hi THEN 1e0
  ELSE {q6('(le - 1 + CASE WHEN x1 > x0 THEN (v - x0) / (x1 - x0) ELSE 0e0 END) / (n - 1)')} END AS u
FROM (SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_g) AS gauge_ams, max(pr_g) AS v FROM v_station_daily GROUP BY 1, 2) q
JOIN (SELECT q.code, q.year, count(s.pr_p) AS n, min(s.pr_p) AS lo, max(s.pr_p) AS hi,
             count(s.pr_p) FILTER (s.pr_p <= q.v) AS le, max(s.pr_p) FILTER (s.pr_p <= q.v) AS x0, min(s.pr_p) FILTER (s.pr_p > q.v) AS x1
      FROM (SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_g) AS v FROM v_station_daily GROUP BY 1, 2) q
      JOIN v_station_daily s USING (code) GROUP BY 1, 2) x USING (code, year)""")
def ecdf_position(spark, d):
    """Gauge maxima placed in the record of the product."""
    daily = t.station_pairs_daily(spark, d)
    queries = mapping.paired_annual_max(daily).select("code", "year", F.col("gauge_ams").alias("v"))
    placed = mapping.ecdf_position(daily.select("code", F.col("pr_p").alias("v")), queries)
    return rounded(placed, "u")


def _pchip_sql() -> str:
    """Monotone cubic written out for five knots."""
    n = len(PROBS)
    h = [f"(p{i + 1} - p{i})" for i in range(n - 1)]
    m = [f"((g{i + 1} - g{i}) / (p{i + 1} - p{i}))" for i in range(n - 1)]

    def edge(h0, h1, m0, m1):
        e = f"((2e0 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1})"
        return (
            f"CASE WHEN sign({e}) <> sign({m0}) THEN 0e0 WHEN sign({m0}) <> sign({m1}) AND abs({e}) > 3e0 * abs({m0}) "
            f"THEN 3e0 * {m0} ELSE {e} END"
        )

    slopes = [edge(h[0], h[1], m[0], m[1])]
    for i in range(1, n - 1):
        slopes.append(
            f"CASE WHEN {m[i - 1]} * {m[i]} <= 0 THEN 0e0 ELSE (3e0 * ({h[i - 1]} + {h[i]})) / "
            f"((2e0 * {h[i]} + {h[i - 1]}) / {m[i - 1]} + ({h[i]} + 2e0 * {h[i - 1]}) / {m[i]}) END"
        )
    slopes.append(edge(h[-1], h[-2], m[-1], m[-2]))
    knots = f"SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(slopes))} FROM ({KNOTS_SQL})"
    pieces = []
    for i in range(n - 1):
        w = f"((x - p{i}) / {h[i]})"
        value = (
            f"(2e0 * pow({w}, 3) - 3e0 * pow({w}, 2) + 1e0) * g{i} + (pow({w}, 3) - 2e0 * pow({w}, 2) + {w}) * {h[i]} * s{i} "
            f"+ (3e0 * pow({w}, 2) - 2e0 * pow({w}, 3)) * g{i + 1} + (pow({w}, 3) - pow({w}, 2)) * {h[i]} * s{i + 1}"
        )
        pieces.append(f"WHEN x <= p{i + 1} THEN {value}")
    curve = (
        f"CASE WHEN x < p0 THEN g0 + {m[0]} * (x - p0) {' '.join(pieces)} "
        f"ELSE g{n - 1} + {m[-1]} * (x - p{n - 1}) END"
    )
    return f"""
SELECT a.code, a.year, a.x AS prod_ams, {q6(f'CASE WHEN k.code IS NULL OR x IS NULL THEN NULL WHEN u < 0.8 THEN x ELSE {curve} END')} AS prod_ams_qm, gauge_ams
FROM (SELECT q.*, CASE WHEN n <= 1 THEN 0e0 ELSE (le - 1) / (n - 1) END AS u FROM (
        SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_p) AS x, max(pr_g) AS gauge_ams FROM v_station_daily GROUP BY 1, 2) q
      LEFT JOIN (SELECT q.code, q.year, count(s.pr_p) AS n, count(s.pr_p) FILTER (s.pr_p <= q.x) AS le
                 FROM (SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_p) AS x FROM v_station_daily GROUP BY 1, 2) q
                 JOIN v_station_daily s USING (code) GROUP BY 1, 2) c USING (code, year)) a
LEFT JOIN ({knots}) k ON k.code = a.code"""


@case("tail_mapping", _pchip_sql())
def tail_mapping(spark, d):
    return rounded(mapping.tail_mapping(t.station_pairs_daily(spark, d), _models(spark, d)), "prod_ams_qm")


@case("flow_duration_curve", f"""
SELECT user_id AS code, date, {q6('q')} AS q, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k DESC, date) AS INTEGER) AS rank,
       {q6('row_number() OVER (PARTITION BY user_id ORDER BY k DESC, date) / (count(*) OVER (PARTITION BY user_id) + 1e0)')} AS exceedance
FROM (SELECT user_id, CAST(ts AS DATE) AS date, sum(CAST(round(value * 100) AS BIGINT)) AS k,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS q FROM events GROUP BY 1, 2)""")
def flow_duration_curve(spark, d):
    """Daily event totals as flows; sums of cents keep equal flows equal."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100.0
    flows = t.table(spark, d, "events").groupBy(
        F.col("user_id").alias("code"), F.col("ts").cast("date").alias("date")
    ).agg(cents.alias("q"))
    return rounded(mapping.flow_duration(flows), "q", "exceedance")


# serving ----------------------------------------------------------------------------------------------
INTENSITY = "k * pow({t}, a) / pow(b + {d}, cc)"


def _cetesb_params(spark, d):
    fits = idf_fit.duration_fits(t.fine_cells(spark, d))
    return idf_fit.fit_parameters(t.corrected_amax(spark, d), fits)


@case("idf_curve", f"""
SELECT code, product, bias, disagg, d AS duration_min, {", ".join(
    f"{q6(INTENSITY.format(t=f'{p}e0', d='d'), 4)} AS rp_{p}" for p in CURVE_RETURN_PERIODS)}
FROM v_stations s JOIN v_params p ON p.r = floor((5e0 - s.lat) / 0.19e0) AND p.c = floor((s.lon + 73e0) / 0.38e0),
  (SELECT unnest({list(CURVE_DURATIONS_MIN)}) AS d)
WHERE disagg = 'CETESB' AND k IS NOT NULL""")
def idf_curve(spark, d):
    """Curves at every station that lies on the grid."""
    at = raster.sample_raster(
        t.stations(spark, d).select("code", "lat", "lon"), _cetesb_params(spark, d), t.FINE,
        ["K", "a", "b", "c"], serving.COMBO,
    )
    curves = serving.idf_curve(at, ["code", *serving.COMBO])
    return rounded(curves, *[f"rp_{p}" for p in CURVE_RETURN_PERIODS], digits=4)


@case("idf_rows", f"""
SELECT product, bias, {RC}, d AS duration_min, t AS T, {q6(INTENSITY.format(t='t', d='d'), 4)} AS intensity
FROM v_params, (SELECT unnest({list(CURVE_DURATIONS_MIN)}) AS d), (SELECT unnest({list(CURVE_RETURN_PERIODS)}) AS t)
WHERE disagg = 'CETESB' AND k IS NOT NULL""")
def idf_rows(spark, d):
    """Curves of every cell of every product."""
    return rounded(serving.idf_rows(_cetesb_params(spark, d), CELL), "intensity", digits=4)


@case("idf_curve_all_modes", f"""
SELECT code, product, bias, disagg, d AS duration_min, {", ".join(
    f"{q6(INTENSITY.format(t=f'{p}e0', d='d'), 4)} AS rp_{p}" for p in CURVE_RETURN_PERIODS)}
FROM v_stations s JOIN v_final p ON p.r = floor((5e0 - s.lat) / 0.19e0) AND p.c = floor((s.lon + 73e0) / 0.38e0),
  (SELECT unnest({list(CURVE_DURATIONS_MIN)}) AS d)
WHERE k IS NOT NULL""")
def idf_curve_all_modes(spark, d):
    """Curves at every station, from the complete parameter table."""
    at = raster.sample_raster(
        t.stations(spark, d).select("code", "lat", "lon"), _all_params(spark, d), t.FINE,
        ["K", "a", "b", "c"], serving.COMBO,
    )
    curves = serving.idf_curve(at, ["code", *serving.COMBO])
    return rounded(curves, *[f"rp_{p}" for p in CURVE_RETURN_PERIODS], digits=4)


@case("idf_rows_all_modes", f"""
SELECT product, bias, disagg, {RC}, d AS duration_min, t AS T, {q6(INTENSITY.format(t='t', d='d'), 4)} AS intensity
FROM v_final, (SELECT unnest({list(CURVE_DURATIONS_MIN)}) AS d), (SELECT unnest({list(CURVE_RETURN_PERIODS)}) AS t)
WHERE k IS NOT NULL""")
def idf_rows_all_modes(spark, d):
    """Curves of every cell of every product and mode."""
    return rounded(serving.idf_rows(_all_params(spark, d), [*CELL[:2], "disagg", *CELL[2:]]), "intensity", digits=4)


@case("compare_design", f"""
SELECT code, T, duration_min, bias, disagg, {", ".join(
    f"{q6(f'max(i) FILTER (product = {chr(39)}{p}{chr(39)})', 4)} AS {chr(34)}{p}{chr(34)}" for p, _ in t.FACTORS)}
FROM (SELECT s.code, x.T, x.duration_min, f.bias, f.disagg, f.product, k * pow(x.T, a) / pow(b + x.duration_min, cc) AS i
      FROM v_stations s JOIN v_final f ON f.r = floor((5e0 - s.lat) / 0.19e0) AND f.c = floor((s.lon + 73e0) / 0.38e0),
           (VALUES {", ".join(str(x) for x in DESIGN_POINTS)}) x(T, duration_min))
GROUP BY code, T, duration_min, bias, disagg""")
def compare_design(spark, d):
    """Design intensities at the stations: six bias/mode groups by four products."""
    at = raster.sample_raster(
        t.stations(spark, d).select("code", "lat", "lon"), _all_params(spark, d), t.FINE,
        ["K", "a", "b", "c"], serving.COMBO,
    ).filter("product IS NOT NULL")
    products = [p for p, _ in t.FACTORS]
    return rounded(serving.compare_design(at, ["code"], products), *products, digits=4)


@case("sample_points", f"""
SELECT s.code, coalesce(a.adm2, '—') AS place, coalesce(a.adm2 || ', ' || a.adm1 || ', ' || a.adm0, '—') AS place_full, e.elev_m,
       p.product, p.bias, p.disagg, {q6('p.k', 3)} AS K, {q6('p.a')} AS a, {q6('p.b', 4)} AS b, {q6('p.cc')} AS c,
       p.k IS NULL AS missing
FROM v_stations s LEFT JOIN v_areas a ON {INSIDE}
LEFT JOIN v_cells e ON e.r = floor((5e0 - s.lat) / 0.19e0) AND e.c = floor((s.lon + 73e0) / 0.38e0)
LEFT JOIN (SELECT * FROM v_params WHERE disagg = 'CETESB') p ON p.r = floor((5e0 - s.lat) / 0.19e0) AND p.c = floor((s.lon + 73e0) / 0.38e0)""")
def sample_points(spark, d):
    sampled = serving.sample_points(
        t.stations(spark, d).select("code", "lat", "lon"), _cetesb_params(spark, d), t.FINE,
        t.areas(spark, d), t.elevation(spark, d), tile=2.0,
    )
    out = sampled.select("code", "place", "place_full", "elev_m", *serving.COMBO, "K", "a", "b", "c", "missing")
    return rounded(rounded(rounded(out, "a", "c"), "K", digits=3), "b", digits=4)


@case("sample_points_all_modes", f"""
SELECT s.code, coalesce(a.adm2, '—') AS place, coalesce(a.adm2 || ', ' || a.adm1 || ', ' || a.adm0, '—') AS place_full, e.elev_m,
       p.product, p.bias, p.disagg, {q6('p.k', 3)} AS K, {q6('p.a')} AS a, {q6('p.b', 4)} AS b, {q6('p.cc')} AS c,
       p.k IS NULL AS missing
FROM v_stations s LEFT JOIN v_areas a ON {INSIDE}
LEFT JOIN v_cells e ON e.r = floor((5e0 - s.lat) / 0.19e0) AND e.c = floor((s.lon + 73e0) / 0.38e0)
LEFT JOIN v_final p ON p.r = floor((5e0 - s.lat) / 0.19e0) AND p.c = floor((s.lon + 73e0) / 0.38e0)""")
def sample_points_all_modes(spark, d):
    """Points read from the complete parameter table."""
    sampled = serving.sample_points(
        t.stations(spark, d).select("code", "lat", "lon"), _all_params(spark, d), t.FINE,
        t.areas(spark, d), t.elevation(spark, d), tile=2.0,
    )
    out = sampled.select("code", "place", "place_full", "elev_m", *serving.COMBO, "K", "a", "b", "c", "missing")
    return rounded(rounded(rounded(out, "a", "c"), "K", digits=3), "b", digits=4)


@case("sample_points_from_store", f"""
SELECT s.code, p.product, p.bias, p.disagg, {q6('p.k', 3)} AS K, {q6('p.a')} AS a, {q6('p.b', 4)} AS b, {q6('p.cc')} AS c
FROM v_stations s LEFT JOIN v_final p ON p.r = floor((5e0 - s.lat) / 0.19e0) AND p.c = floor((s.lon + 73e0) / 0.38e0)""")
def sample_points_from_store(spark, d):
    """Points read from the complete parameter table on disk, which holds a folder for each tile of 8 by 8 cells."""
    path = f"{shared_folder(spark)}/parameters-{uuid.uuid4().hex}"
    parameter_store.write_store(_all_params(spark, d), path, 8)
    points = t.stations(spark, d).select("code", "lat", "lon")
    bands = ("K", "a", "b", "c")
    out = parameter_store.sample_store(points, parameter_store.read_store(spark, path), t.FINE, bands, serving.COMBO, 8)
    return rounded(rounded(rounded(out.select("code", *serving.COMBO, *bands), "a", "c"), "K", digits=3), "b", digits=4)
