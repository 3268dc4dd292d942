"""Extremes, pairs, bias factors and their diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import case, r6, rounded
from checks.sql_views import r6 as q6
from rainspark.operators import bias, describe, diagnostics, extremes
from rainspark.operators.raster import sample_raster
from rainspark.plans import bias_correction
from rainspark.session import materialise, shared_folder
from rainspark.sources import columns, inventory, pairs as pair_files

ZETA_SQL = f"""
SELECT product, station_id, {{}} AS zeta, n_pairs, {q6('ratio_median')} AS ratio_median, {q6('ratio_mean')} AS ratio_mean,
       {q6('ratio_p10')} AS ratio_p10, {q6('ratio_p90')} AS ratio_p90, lat, lon FROM v_zeta"""


def _pairs(spark, d):
    return extremes.event_pairs(
        extremes.extremes(t.gauge_daily(spark, d)), t.stations(spark, d), t.product_daily(spark, d), t.COARSE
    )


def _zetas(spark, d, method="mean"):
    return bias_correction.station_zetas(
        t.gauge_daily(spark, d), t.stations(spark, d), t.product_daily(spark, d), t.COARSE, method
    )


def _pairs_with_zeta(spark, d):
    # the pair table is an output of its own, written once and read by both sides
    pairs = materialise(_pairs(spark, d), "pairs")
    return bias.with_zeta(pairs, bias.zeta(pairs))


@case("zeta_with_repeated_stations", f"SELECT product, station_id, {q6('zeta')} AS zeta, n_pairs, lat, lon FROM v_zeta")
def zeta_with_repeated_stations(spark, d):
    """Every station is listed again, later and farther south and west: the first listing counts."""
    st = t.stations(spark, d).withColumn("ordinal", F.col("s_suppkey"))
    again = st.withColumns({"lat": F.col("lat") - 12.0, "lon": F.col("lon") - 3.0, "ordinal": F.col("ordinal") + 1_000_000_000})
    zetas = bias_correction.station_zetas(
        t.gauge_daily(spark, d), again.unionByName(st), t.product_daily(spark, d), t.COARSE, order=["ordinal"]
    )
    return zetas.select("product", "station_id", r6("zeta").alias("zeta"), "n_pairs", "lat", "lon")


@case("exceedances", f"SELECT code, y AS year, date, pr_g, {q6('thr')} AS threshold FROM v_exceed")
def exceedances(spark, d):
    return rounded(extremes.exceedances(t.gauge_daily(spark, d)), "threshold")


@case("declustered_extremes", "SELECT code, y AS year, date, pr_g FROM v_kept")
def declustered_extremes(spark, d):
    return extremes.extremes(t.gauge_daily(spark, d))


@case("declustered_dense", "SELECT code, y AS year, date, pr_g FROM v_dense_walk WHERE keep")
def declustered_dense(spark, d):
    """Twenty stations with nearly daily records, so that many exceedances are too close."""
    merged = t.table(spark, d, "lineitem").groupBy(
        (F.col("l_suppkey") % 20).cast("string").alias("code"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(F.max(F.col("l_quantity") + F.col("l_extendedprice") / 1000.0).alias("pr_g"))
    return extremes.extremes(merged, pct=0.9)


@case("event_pairs", "SELECT product, station_id, lat, lon, date, pr_p, pr_g, ratio FROM v_pairs")
def event_pairs(spark, d):
    return _pairs(spark, d)


@case("product_at_events", f"""
SELECT k.code, k.date, p.product, coalesce(x.pr_p, 0e0) AS pr_p
FROM v_kept k JOIN v_stations s ON s.code = k.code CROSS JOIN (SELECT DISTINCT product FROM v_products) p
LEFT JOIN v_products x ON x.product = p.product AND x.date = k.date
  AND x.r = floor((5e0 - s.lat) / 9.5e0) AND x.c = floor((s.lon + 73e0) / 9.5e0)""")
def product_at_events(spark, d):
    cells = extremes.station_cells(t.stations(spark, d), t.COARSE)
    events = extremes.extremes(t.gauge_daily(spark, d)).join(cells.select("code", "row", "col"), "code")
    sampled = extremes.sample_product(events, t.product_daily(spark, d), [p for p, _ in t.FACTORS])
    return sampled.select("code", "date", "product", "pr_p")


@case("pairs_roundtrip", f"""
SELECT product, CAST(year(date) AS INTEGER) AS year, count(*) AS n, {q6("sum(ratio)", 4)} AS ratio_sum
FROM v_pairs GROUP BY 1, 2""")
def pairs_roundtrip(spark, d):
    """Partitioned by product and year on disk, read back by folder."""
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    pair_files.write_pairs(_pairs(spark, d), path)
    back = pair_files.read_pairs(spark, path)
    return back.groupBy("product", "year").agg(
        F.count("*").alias("n"), r6(F.sum("ratio"), 4).alias("ratio_sum")
    )


@case("pairs_added_by_run", f"""
SELECT product, CAST(year(date) AS INTEGER) AS year, CASE WHEN year(date) < 1998 THEN 1 ELSE 2 END AS run, count(*) AS n,
       {q6("sum(ratio)", 4)} AS ratio_sum
FROM v_pairs GROUP BY 1, 2, 3""")
def pairs_added_by_run(spark, d):
    """Three runs over a growing table: the first years, all years, all years again; every product-year is written once."""
    path, pairs = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}", materialise(_pairs(spark, d), "pairs")
    tables = (pairs.filter(F.year("date") < 1998), pairs, pairs)
    runs = [pair_files.write_missing_pairs(table, path).withColumn("run", F.lit(i)) for i, table in enumerate(tables, 1)]
    back = pair_files.read_pairs(spark, path).groupBy("product", "year").agg(
        F.count("*").alias("n"), r6(F.sum("ratio"), 4).alias("ratio_sum")
    )
    return back.join(runs[0].union(runs[1]).union(runs[2]), ["product", "year"], "full").select("product", "year", "run", "n", "ratio_sum")


@case("pair_columns_normalised", f"""
SELECT CASE product WHEN 'PERS' THEN 'PERSIANN' WHEN 'XAVIER' THEN 'BR-DWGD' ELSE product END AS product,
       count(*) AS n, {q6("sum(pr_p)", 4)} AS total FROM v_pairs GROUP BY 1""")
def pair_columns_normalised(spark, d):
    """Each product's files with a column name of their own, brought to one."""
    names = {"XAVIER": "xavier_pr_mm", "IMERG": "imerg_mm", "CHIRPS": "chirps_mm", "PERS": "persiann_mm"}
    folder, pairs = f"{shared_folder(spark)}/pair-files-{uuid.uuid4().hex}", _pairs(spark, d)
    for product, name in names.items():
        own = pairs.filter(F.col("product") == product).drop("product").withColumnRenamed("pr_p", name)
        own.write.option("header", True).csv(f"{folder}/{product}")
    out = pair_files.read_pair_csv(spark, [f"{folder}/{product}" for product in names])
    return out.groupBy("product").agg(F.count("*").alias("n"), r6(F.sum("pr_p"), 4).alias("total"))


@case("pair_qc", """
SELECT product, count(*) FILTER (pr_g BETWEEN 1 AND 350 AND pr_p BETWEEN 1 AND 350 AND ratio BETWEEN 0.25 AND 5) AS n_zeta,
       count(*) FILTER (pr_g >= 1 AND pr_p >= 1 AND ratio BETWEEN 0.1 AND 10) AS n_plot FROM v_pairs GROUP BY 1""")
def pair_qc(spark, d):
    pairs = _pairs(spark, d)
    n = [
        f(pairs).groupBy("product").agg(F.count("*").alias(c))
        for f, c in ((bias.pair_qc, "n_zeta"), (bias.plot_qc, "n_plot"))
    ]
    return n[0].join(n[1], "product")


def _zeta_query(method):
    def query(spark, d):
        return rounded(
            _zetas(spark, d, method), "zeta", "ratio_median", "ratio_mean", "ratio_p10", "ratio_p90"
        )
    return query


case("zeta_mean", ZETA_SQL.format(q6("zeta")))(_zeta_query("mean"))
case("zeta_median", ZETA_SQL.format(q6("zeta_median")))(_zeta_query("median"))
case("zeta_slope0", ZETA_SQL.format(q6("zeta_slope0")))(_zeta_query("slope0"))


@case("interpolation_points", f"""
SELECT product, station_id, {q6('zeta')} AS zeta, lat, lon FROM v_zeta WHERE n_pairs >= 10 AND zeta BETWEEN 0.05 AND 10""")
def interpolation_points(spark, d):
    return rounded(bias.interpolation_points(_zetas(spark, d)).select("product", "station_id", "zeta", "lat", "lon"), "zeta")


@case("pairs_with_zeta", f"SELECT product, station_id, date, pr_g, {q6('pr_cor')} AS pr_cor FROM v_pz")
def pairs_with_zeta(spark, d):
    return rounded(_pairs_with_zeta(spark, d).select("product", "station_id", "date", "pr_g", "pr_cor"), "pr_cor")


FIT = "sum({y} * pr_g) / sum(pr_g * pr_g)"


@case("origin_fit_by_product", f"""
SELECT product, stage, count(*) AS n, {q6('any_value(a)')} AS slope,
       {q6('1e0 - sum((v - a * pr_g) * (v - a * pr_g)) / sum(v * v)')} AS r2
FROM (SELECT *, sum(v * pr_g) OVER w / sum(pr_g * pr_g) OVER w AS a FROM (
        SELECT product, 'raw' AS stage, pr_g, pr_p AS v FROM v_pq
        UNION ALL SELECT product, 'corrected', pr_g, pr_cor FROM v_pq)
      WINDOW w AS (PARTITION BY product, stage)) GROUP BY 1, 2""")
def origin_fit_by_product(spark, d):
    """All products in one job, before and after correction."""
    stages = F.explode(F.array(
        F.struct(F.lit("raw").alias("stage"), F.col("pr_p").alias("v")),
        F.struct(F.lit("corrected").alias("stage"), F.col("pr_cor").alias("v")),
    )).alias("s")
    both = bias.plot_qc(_pairs_with_zeta(spark, d)).select("product", "pr_g", stages).select("product", "pr_g", "s.*")
    return rounded(diagnostics.origin_fit(both, ["product", "stage"], "pr_g", "v"), "slope", "r2")


def _box_sql(source: str) -> str:
    names = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    picks = ", ".join(f"{q6(f'quantile_cont(bias, {p})')} AS {n}" for n, p in names.items())
    return f"SELECT product, stage, count(*) AS n, {picks} FROM ({source}) GROUP BY 1, 2"


def _staged(raw: str, cor: str, source: str) -> str:
    return (
        f"SELECT product, 'raw' AS stage, {raw} AS bias FROM {source} "
        f"UNION ALL SELECT product, 'corrected', {cor} FROM {source}"
    )


def _box(df):
    return rounded(diagnostics.box_stats(df), *diagnostics.BOX)


@case("box_events", _box_sql(
    "SELECT * FROM (" + _staged("pr_p / pr_g", "pr_cor / pr_g", "v_pq") + ") WHERE bias BETWEEN 0.1 AND 10"))
def box_events(spark, d):
    return _box(diagnostics.event_bias(_pairs_with_zeta(spark, d)))


for _centre, _agg in (("mean", "avg"), ("median", "median")):
    _src = (
        f"(SELECT product, station_id, {_agg}(pr_g) AS g, {_agg}(pr_p) AS p, any_value(zeta) AS z "
        "FROM v_pq GROUP BY 1, 2 HAVING g >= 1 AND p >= 1)"
    )

    def _query(spark, d, centre=_centre):
        return _box(diagnostics.station_bias(_pairs_with_zeta(spark, d), centre))

    case(f"box_station_{_centre}", _box_sql(
        f"SELECT * FROM ({_staged('p / g', 'p * z / g', _src)}) WHERE bias BETWEEN 0.01 AND 20"))(_query)


@case("box_station_relative", _box_sql(_staged(
    "(p - g) / g", "(z * p - g) / g",
    "(SELECT product, station_id, avg(pr_g) AS g, avg(pr_p) AS p, any_value(zeta) AS z FROM v_pq GROUP BY 1, 2 HAVING g >= 1)")))
def box_station_relative(spark, d):
    return _box(diagnostics.station_relative_bias(_pairs_with_zeta(spark, d)))


@case("axis_limit", f"""
SELECT pct, {q6('greatest(10e0, lim)')} AS lim FROM (
  SELECT 99.5 AS pct, quantile_cont(v, 0.995) AS lim FROM (SELECT unnest([pr_g, pr_p, pr_cor]) AS v FROM v_pq) HAVING count(*) > 0
  UNION ALL SELECT 95.0, quantile_cont(v, 0.95) FROM (SELECT unnest([pr_g, pr_p, pr_cor]) AS v FROM v_pq) HAVING count(*) > 0)""".replace(
    "99.5 AS", "99.5e0 AS").replace("95.0,", "95e0,"))
def axis_limit(spark, d):
    pairs = bias.plot_qc(_pairs_with_zeta(spark, d))
    limits = diagnostics.axis_limits(pairs, [0.995, 0.95])
    return limits.select(F.round(F.col("prob") * 100, 1).alias("pct"), r6("lim").alias("lim"))


BIN = "CAST(least(floor({0} / 4e0), 49) AS INTEGER)"


@case("density_bins", f"""
SELECT product, {BIN.format('pr_g')} AS ix, {BIN.format('pr_p')} AS iy, count(*) AS n FROM v_pq
WHERE pr_g BETWEEN 0 AND 200 AND pr_p BETWEEN 0 AND 200 GROUP BY 1, 2, 3""")
def density_bins(spark, d):
    span = (F.lit(0.0), F.lit(200.0))
    return diagnostics.histogram2d(
        bias.plot_qc(_pairs_with_zeta(spark, d)), "pr_g", "pr_p", 50, span, span, ["product"]
    )


@case("density_of_points", f"""
SELECT p.product, p.station_id, p.date, coalesce(b.n, 0) AS density,
       coalesce(max(b.n) OVER (PARTITION BY p.product), 0) AS top
FROM v_pq p LEFT JOIN (
  SELECT product, CAST(least(floor(pr_g / 1.6e0), 49) AS INTEGER) AS ix, CAST(least(floor(pr_p / 1.6e0), 49) AS INTEGER) AS iy, count(*) AS n
  FROM v_pq WHERE pr_g BETWEEN 0 AND 80 AND pr_p BETWEEN 0 AND 80 GROUP BY 1, 2, 3) b
ON b.product = p.product AND b.ix = CAST(least(floor(p.pr_g / 1.6e0), 49) AS INTEGER) AND b.iy = CAST(least(floor(p.pr_p / 1.6e0), 49) AS INTEGER)""")
def density_of_points(spark, d):
    """Points beyond 80 mm look at the edge bins."""
    span = (F.lit(0.0), F.lit(80.0))
    dense = diagnostics.density_of_points(
        bias.plot_qc(_pairs_with_zeta(spark, d)), "pr_g", "pr_p", 50, span, span, ["product"]
    )
    top = dense.groupBy("product").agg(F.max("density").alias("top"))
    return dense.join(top, "product").select("product", "station_id", "date", "density", "top")


@case("density_ranges", f"""
SELECT product, {q6('greatest(xl - 0.02e0 * (xh - xl + 1e-9), 0e0)')} AS x_lo, {q6('xh + 0.02e0 * (xh - xl + 1e-9)')} AS x_hi,
       {q6('greatest(yl - 0.02e0 * (yh - yl + 1e-9), 0e0)')} AS y_lo, {q6('yh + 0.02e0 * (yh - yl + 1e-9)')} AS y_hi
FROM (SELECT product, min(pr_g) AS xl, quantile_cont(pr_g, 0.995) AS xh, min(ratio) AS yl, quantile_cont(ratio, 0.995) AS yh
      FROM v_pq GROUP BY 1)""")
def density_ranges(spark, d):
    ranges = diagnostics.density_ranges(bias.plot_qc(_pairs_with_zeta(spark, d)), "pr_g", "ratio", ["product"])
    return rounded(ranges, "x_lo", "x_hi", "y_lo", "y_hi")


ELEV_SQL = """
SELECT p.product, k.elev_m / 1000e0 AS h, least(greatest(p.ratio, 0.5e0), 3.5e0) AS z
FROM v_pq p JOIN v_stations s ON s.code = p.station_id
JOIN v_cells k ON k.r = floor((5e0 - s.lat) / 0.19e0) AND k.c = floor((s.lon + 73e0) / 0.38e0)"""


@case("zeta_vs_elevation", f"""
SELECT product, count(*) AS n, CASE WHEN count(*) >= 3 THEN {q6('any_value(a)', 5)} END AS a, CASE WHEN count(*) >= 3 THEN {q6('any_value(b)', 5)} END AS b,
       CASE WHEN count(*) >= 3 THEN {q6('1e0 - sum((z - a * exp(b * h)) * (z - a * exp(b * h))) / sum((z - zm) * (z - zm))', 5)} END AS r2
FROM (SELECT e.*, f.a, f.b, f.zm FROM ({ELEV_SQL}) e JOIN (
        SELECT product, exp(regr_intercept(ln(z), h)) AS a, regr_slope(ln(z), h) AS b, avg(z) AS zm FROM ({ELEV_SQL}) GROUP BY 1) f
      USING (product)) GROUP BY 1""")
def zeta_vs_elevation(spark, d):
    """Event ratios against the height of their station; one pair in seven lost its coordinates."""
    pairs = bias.plot_qc(_pairs_with_zeta(spark, d)).withColumn("zeta", F.col("ratio"))
    known = F.dayofmonth("date") % 7 != 0
    holey = pairs.withColumn("lat", F.when(known, F.col("lat"))).withColumn("lon", F.when(known, F.col("lon")))
    given = t.stations(spark, d).select(F.col("code").alias("station_id"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    # a station whose every pair lost them falls back on the station list
    filled = diagnostics.fill_coordinates(holey).join(given, "station_id").withColumn(
        "lat", F.coalesce("lat", "slat")).withColumn("lon", F.coalesce("lon", "slon"))
    places = inventory.first_row_per(filled.select("station_id", "lat", "lon"), ["station_id"], ["lat", "lon"])
    heights = sample_raster(places, t.elevation(spark, d), t.FINE, ["elev_m"]).dropna(subset=["elev_m"])
    rows = filled.select("product", "station_id", "zeta").join(heights.select("station_id", "elev_m"), "station_id")
    return rounded(diagnostics.exponential_fit(rows, ["product"]), "a", "b", "r2", digits=5)


# inventory description ----------------------------------------------------------------------
LONG_SQL = 'SELECT unnest([\'NYD\', \'MD\', \'N_YWOMD\', \'YWMD\']) AS "column", unnest([NYD, MD, N_YWOMD, YWMD]) AS v FROM v_inventory'


@case("describe_inventory", f"""
SELECT "column", count(*) AS n, {q6('avg(v)')} AS mean, {q6('stddev_samp(v)')} AS std, min(v) AS min,
       {q6('quantile_cont(v, 0.05)')} AS p05, {q6('quantile_cont(v, 0.5)')} AS p50, {q6('quantile_cont(v, 0.95)')} AS p95, max(v) AS max
FROM ({LONG_SQL}) WHERE v IS NOT NULL GROUP BY 1""")
def describe_inventory(spark, d):
    return rounded(describe.describe(t.inventory(spark, d)), "mean", "std", "p05", "p50", "p95")


def _histogram_sql(source: str) -> str:
    """`source` gives ("column", v)."""
    return f"""
SELECT h."column", CAST(b AS INTEGER) AS bin, {q6('lo + b * step')} AS "left", {q6('lo + (b + 1) * step')} AS "right",
       count(s.v) FILTER (v >= lo + b * step AND (v < lo + (b + 1) * step OR b = bins - 1)) AS n
FROM (SELECT "column", lo, bins, (hi - lo) / bins AS step, unnest(range(bins)) AS b FROM (
        SELECT "column", CASE WHEN hi = lo THEN lo - 0.5e0 ELSE lo END AS lo, CASE WHEN hi = lo THEN hi + 0.5e0 ELSE hi END AS hi,
               CASE WHEN hi = lo THEN 1 ELSE CAST(ceil((hi - lo) / CASE WHEN iqr > 0 THEN least(2 * iqr / pow(n, 1e0 / 3e0), (hi - lo) / (log2(n) + 1))
                                                  ELSE (hi - lo) / (log2(n) + 1) END) AS BIGINT) END AS bins
        FROM (SELECT "column", CAST(count(*) AS DOUBLE) AS n, min(v) AS lo, max(v) AS hi,
                     quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM ({source}) WHERE v IS NOT NULL GROUP BY 1))) h
JOIN ({source}) s ON s."column" = h."column" GROUP BY h."column", b, lo, step, bins"""


@case("inventory_histograms", _histogram_sql(LONG_SQL))
def inventory_histograms(spark, d):
    values = describe.stacked(t.inventory(spark, d), describe.NUMERIC)
    return rounded(describe.histogram(values, ["column"], "value"), "left", "right")


YEARS_SQL = """SELECT unnest(['start', 'end', 'length']) AS "column",
  unnest([CAST(y_start AS DOUBLE), CAST(y_end AS DOUBLE), CASE WHEN y_end >= y_start THEN CAST(y_end - y_start AS DOUBLE) END]) AS v FROM v_inventory"""


@case("record_length_histograms", _histogram_sql(YEARS_SQL))
def record_length_histograms(spark, d):
    inv = t.inventory(spark, d)
    start, end = columns.guess_year(inv, "start"), columns.guess_year(inv, "end")
    years = inv.select(start.alias("start"), end.alias("end"), describe.record_length(start, end).alias("length"))
    values = describe.stacked(years, ("start", "end", "length"))
    return rounded(describe.histogram(values, ["column"], "value"), "left", "right")


@case("nyd_classes", "SELECT CAST(NYD AS INTEGER) AS k, count(*) AS n FROM v_inventory GROUP BY 1")
def nyd_classes(spark, d):
    inv = t.inventory(spark, d)
    return diagnostics.integer_classes(inv.withColumn("v", F.col(columns.guess_column(inv, "nyd")).cast("double")), "v")
