"""The same tables, and the longer derivations, as DuckDB views; written apart from the library."""

from __future__ import annotations

import re

from checks.tables import FACTORS, STATE_NAMES
from rainspark.grid import CETESB_FACTORS, DURATIONS_MIN, RETURN_PERIODS
from rainspark.operators.sherman import COARSE, FINE, passes

REFINE = passes()
PRODUCTS_SQL = "(VALUES " + ", ".join(f"('{p}', {f}e0)" for p, f in FACTORS) + ") p(product, f)"
STATES_SQL = "[" + ", ".join(f"'{s}'" for s in STATE_NAMES) + "]"
DUR_SQL = "(VALUES " + ", ".join(
    f"({j}, {d}, {CETESB_FACTORS[j]}e0 / 1.14e0)" for j, d in enumerate(DURATIONS_MIN)
) + ") d(j, d, f)"
PERIODS_SQL = "(VALUES " + ", ".join(f"({t}e0)" for t in RETURN_PERIODS) + ") t(t)"


def r6(x: str, digits: int = 6) -> str:
    s = f"1e{digits}"
    return f"(floor(({x}) * {s} + 0.5001e0) / {s})"


VIEWS: dict[str, str] = {}

VIEWS["v_stations"] = """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code, s_suppkey, s_name AS name, n_name AS state,
       -33e0 + 38e0 * (CAST((s_suppkey * 37) % 101 AS DOUBLE) + 0.5e0) / 101e0 AS lat,
       -73e0 + 38e0 * CAST((s_suppkey * 53) % 97 AS DOUBLE) / 97e0 AS lon
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["v_gauge"] = """
SELECT lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS code, CAST(l_shipdate AS DATE) AS date,
       max(l_extendedprice) / 1000e0 AS pr_g
FROM lineitem GROUP BY 1, 2"""

VIEWS["v_products"] = f"""
SELECT product, r, c, date, pr_p * f AS pr_p FROM (
  SELECT CAST((l_partkey % 16) // 4 AS INTEGER) AS r, CAST((l_partkey % 16) % 4 AS INTEGER) AS c,
         CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100000e0) AS pr_p
  FROM lineitem GROUP BY 1, 2, 3), {PRODUCTS_SQL}"""

VIEWS["v_cells"] = """
SELECT CAST(p_partkey // 100 AS INTEGER) AS r, CAST(p_partkey % 100 AS INTEGER) AS c,
       p_retailprice + p_size * 10e0 AS elev_m,
       5e0 - (p_partkey // 100 + 0.5e0) * 0.19e0 AS lat,
       -73e0 + (p_partkey % 100 + 0.5e0) * 0.38e0 AS lon
FROM part"""

VIEWS["v_fine_daily"] = f"""
SELECT product, r, c, date, pr_p * f AS pr_p FROM (
  SELECT CAST(l_partkey // 100 AS INTEGER) AS r, CAST(l_partkey % 100 AS INTEGER) AS c,
         CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) / 1000e0 AS pr_p
  FROM lineitem GROUP BY 1, 2, 3), {PRODUCTS_SQL}"""

VIEWS["v_amax"] = f"""
SELECT product, r, c, y, mm * f AS mm FROM (
  SELECT CAST(l_partkey // 100 AS INTEGER) AS r, CAST(l_partkey % 100 AS INTEGER) AS c,
         CAST(year(l_shipdate) AS INTEGER) AS y, max(l_extendedprice) / 1000e0 AS mm
  FROM lineitem GROUP BY 1, 2, 3), {PRODUCTS_SQL}"""

VIEWS["v_zeta_cells"] = f"""
SELECT product, r, c, (0.1e0 + CAST((r * 7 + c) % 60 AS DOUBLE) / 10e0) * f AS zeta
FROM v_cells, {PRODUCTS_SQL}"""

VIEWS["v_amax_both"] = """
SELECT product, 'RAW' AS bias, r, c, y, mm FROM v_amax
UNION ALL
SELECT product, 'BC', r, c, y, mm * (0.8e0 + CAST((r * 7 + c) % 10 AS DOUBLE) / 20e0) FROM v_amax"""

VIEWS["v_areas"] = """
SELECT n_nationkey AS poly_id, n_name AS adm2, 'zone ' || r_name AS adm1, r_name AS adm0,
       -73e0 + (n_nationkey % 5) * 7.6e0 AS x1, -33e0 + (n_nationkey // 5) * 7.6e0 AS y1,
       -73e0 + (n_nationkey % 5) * 7.6e0 + 7.6e0 AS x2, -33e0 + (n_nationkey // 5) * 7.6e0 + 7.6e0 AS y2
FROM nation JOIN region ON n_regionkey = r_regionkey"""

VIEWS["v_inventory0"] = f"""
SELECT CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN ' ' || s_suppkey || '.0'
            ELSE lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS Code,
       lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS Code8,
       s_name AS Name, {STATES_SQL}[s_nationkey + 1] AS State,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(s_suppkey % 60 - 30 AS DOUBLE) END AS lat,
       CAST(s_suppkey % 90 - 80 AS DOUBLE) AS lon,
       s_suppkey % 20 + 1960 AS y_start, s_suppkey % 45 + 1970 AS y_end,
       CAST(s_suppkey % 40 AS DOUBLE) AS NYD,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(s_suppkey * s_suppkey % 1009 AS DOUBLE) END AS MD,
       CAST(s_suppkey * 7 % 31 AS DOUBLE) AS N_YWOMD, CAST(s_suppkey * 11 % 97 AS DOUBLE) AS YWMD,
       CASE WHEN s_suppkey % 5 = 0 THEN 'ana' WHEN s_suppkey % 5 = 3 THEN 'OTHER'
            WHEN s_suppkey % 5 < 3 THEN 'ANA' END AS Responsible,
       CASE s_suppkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 3 THEN '2.0' END AS Type,
       s_suppkey AS ordinal
FROM supplier"""

VIEWS["v_inventory"] = """
SELECT * FROM v_inventory0
UNION ALL
SELECT * REPLACE (Code8 AS Code, 0e0 AS lon, ordinal + 1000000000000 AS ordinal) FROM v_inventory0"""

# gauge extremes ---------------------------------------------------------------------------
VIEWS["v_exceed"] = """
SELECT code, y, date, pr_g, thr FROM (
  SELECT code, CAST(year(date) AS INTEGER) AS y, date, pr_g,
         quantile_cont(pr_g, 0.98) OVER (PARTITION BY code, year(date)) AS thr,
         count(*) OVER (PARTITION BY code, year(date)) AS n
  FROM v_gauge WHERE pr_g BETWEEN 0 AND 500)
WHERE n >= 30 AND pr_g > thr"""

VIEWS["v_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY code, y ORDER BY date) AS rn FROM v_exceed"""

VIEWS["v_walk"] = """
SELECT code, y, rn, date, pr_g, date AS last, true AS keep FROM v_ranked WHERE rn = 1
UNION ALL
SELECT n.code, n.y, n.rn, n.date, n.pr_g,
       CASE WHEN date_diff('day', w.last, n.date) >= 3 THEN n.date ELSE w.last END,
       date_diff('day', w.last, n.date) >= 3
FROM v_walk w JOIN v_ranked n ON n.code = w.code AND n.y = w.y AND n.rn = w.rn + 1"""

VIEWS["v_dense"] = """
SELECT CAST(l_suppkey % 20 AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date,
       max(l_quantity + l_extendedprice / 1000e0) AS pr_g FROM lineitem GROUP BY 1, 2"""

VIEWS["v_dense_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY code, y ORDER BY date) AS rn FROM (
  SELECT code, CAST(year(date) AS INTEGER) AS y, date, pr_g,
         quantile_cont(pr_g, 0.9) OVER (PARTITION BY code, year(date)) AS thr,
         count(*) OVER (PARTITION BY code, year(date)) AS n FROM v_dense)
WHERE n >= 30 AND pr_g > thr"""

VIEWS["v_dense_walk"] = """
SELECT code, y, rn, date, pr_g, date AS last, true AS keep FROM v_dense_ranked WHERE rn = 1
UNION ALL
SELECT n.code, n.y, n.rn, n.date, n.pr_g,
       CASE WHEN date_diff('day', w.last, n.date) >= 3 THEN n.date ELSE w.last END,
       date_diff('day', w.last, n.date) >= 3
FROM v_dense_walk w JOIN v_dense_ranked n ON n.code = w.code AND n.y = w.y AND n.rn = w.rn + 1"""

VIEWS["v_kept"] = "SELECT code, y, date, pr_g FROM v_walk WHERE keep AND pr_g > 1"

VIEWS["v_pairs"] = """
SELECT p.product, k.code AS station_id, s.lat, s.lon, k.date, p.pr_p, k.pr_g, k.pr_g / p.pr_p AS ratio
FROM v_kept k JOIN v_stations s ON s.code = k.code
JOIN v_products p ON p.date = k.date AND p.r = floor((5e0 - s.lat) / 9.5e0) AND p.c = floor((s.lon + 73e0) / 9.5e0)
WHERE p.pr_p > 1 AND k.pr_g > 1"""

VIEWS["v_zeta"] = """
SELECT product, station_id, avg(ratio) AS zeta, median(ratio) AS zeta_median,
       sum(pr_p * pr_g) / sum(pr_p * pr_p) AS zeta_slope0, count(*) AS n_pairs,
       quantile_cont(ratio, 0.5) AS ratio_median, avg(ratio) AS ratio_mean,
       quantile_cont(ratio, 0.1) AS ratio_p10, quantile_cont(ratio, 0.9) AS ratio_p90,
       any_value(lat) AS lat, any_value(lon) AS lon
FROM v_pairs
WHERE pr_g BETWEEN 1 AND 350 AND pr_p BETWEEN 1 AND 350 AND ratio BETWEEN 0.25 AND 5
GROUP BY product, station_id HAVING count(*) >= 10"""

VIEWS["v_pz"] = """
SELECT p.*, z.zeta, p.pr_p * z.zeta AS pr_cor FROM v_pairs p JOIN v_zeta z USING (product, station_id)"""

VIEWS["v_pq"] = "SELECT * FROM v_pz WHERE pr_g >= 1 AND pr_p >= 1 AND ratio BETWEEN 0.1 AND 10"

VIEWS["v_station_daily"] = """
SELECT g.code, g.date, p.pr_p, g.pr_g
FROM v_gauge g JOIN v_stations s ON s.code = g.code
LEFT JOIN v_products p ON p.product = 'IMERG' AND p.date = g.date
  AND p.r = floor((5e0 - s.lat) / 9.5e0) AND p.c = floor((s.lon + 73e0) / 9.5e0)"""

# cell statistics and goodness of fit --------------------------------------------------------
VIEWS["v_stats"] = """
SELECT product, bias, r, c, CASE WHEN count(*) >= 5 THEN avg(mm) END AS m,
       CASE WHEN count(*) >= 5 THEN stddev_samp(mm) END AS s, count(*) AS n
FROM v_amax_both GROUP BY ALL"""

VIEWS["v_ks"] = """
SELECT product, bias, r, c, max(abs((i - 0.5e0) / n - exp(-exp(-(mm - mu) / beta)))) AS d, any_value(n) AS n
FROM (SELECT *, m - 0.5772156649015329e0 * beta AS mu FROM (
  SELECT a.*, t.n, t.m, t.s * sqrt(6e0) / pi() AS beta,
         row_number() OVER (PARTITION BY a.product, a.bias, a.r, a.c ORDER BY mm) AS i
  FROM v_amax_both a JOIN v_stats t USING (product, bias, r, c) WHERE t.s > 0))
GROUP BY product, bias, r, c"""

VIEWS["v_ksp"] = """
SELECT product, bias, r, c, d, least(greatest(2 * p, 0), 1) AS p FROM (
  SELECT product, bias, r, c, d,
         sum((CASE WHEN j % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * j * j * lam * lam)) AS p
  FROM (SELECT *, (sqrt(n) + 0.12e0 + 0.11e0 / sqrt(n)) * d AS lam FROM v_ks), range(1, 101) t(j)
  GROUP BY product, bias, r, c, d)"""

# ratio vectors --------------------------------------------------------------------------------
VIEWS["v_vec_cetesb"] = f"SELECT 0 AS vid, j, d, f AS ratio FROM {DUR_SQL}"

VIEWS["v_ratio_cells"] = f"""
SELECT r, c, j, d,
       CASE WHEN j = 11 THEN 1e0 WHEN (r * 100 + c) % 5 = 0 AND j = (r * 100 + c) % 11 THEN NULL
            ELSE f * (1e0 - 0.002e0 * CAST((r * 100 + c) % 10 AS DOUBLE))
                 * (CASE WHEN (r * 100 + c) % 6 = 0 AND j = 5 THEN 0.5e0 ELSE 1e0 END) END AS ratio
FROM v_cells, {DUR_SQL}"""

VIEWS["v_repaired"] = """
SELECT r, c, j, d, CASE WHEN ratio IS NOT NULL THEN greatest(ratio, coalesce(m, 0)) END AS ratio,
       ratio IS NULL AS gap, coalesce(m > ratio + 1e-6, false) AS lifted, m - ratio AS lift
FROM (SELECT *, max(ratio) OVER (PARTITION BY r, c ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
      FROM (SELECT * REPLACE (least(greatest(ratio, 0), 1) AS ratio) FROM v_ratio_cells WHERE ratio IS NOT NULL
            UNION ALL SELECT * FROM v_ratio_cells WHERE ratio IS NULL))"""

VIEWS["v_verdict"] = """
SELECT r, c, CAST(sum(CAST(lifted AS INTEGER)) AS INTEGER) AS violations,
       coalesce(sum(lift) FILTER (lifted), 0e0) AS magnitude, bool_or(gap OR lifted) AS problem
FROM v_repaired GROUP BY r, c"""

VIEWS["v_source"] = """
SELECT r, c, violations, magnitude, problem, CAST(NULL AS INTEGER) AS sr, CAST(NULL AS INTEGER) AS sc, 0e0 AS dist
FROM v_verdict WHERE NOT problem
UNION ALL
SELECT r, c, violations, magnitude, problem, sr, sc, sqrt(d2) FROM (
  SELECT b.*, g.r AS sr, g.c AS sc, CAST((b.r - g.r) * (b.r - g.r) + (b.c - g.c) * (b.c - g.c) AS DOUBLE) AS d2,
         row_number() OVER (PARTITION BY b.r, b.c
           ORDER BY (b.r - g.r) * (b.r - g.r) + (b.c - g.c) * (b.c - g.c), g.r, g.c) AS rn
  FROM v_verdict b, v_verdict g WHERE b.problem AND NOT g.problem) WHERE rn = 1"""

VIEWS["v_filled"] = """
SELECT s.r, s.c, p.j, p.d, p.ratio
FROM v_source s JOIN v_repaired p ON p.r = coalesce(s.sr, s.r) AND p.c = coalesce(s.sc, s.c)"""

VIEWS["v_usable"] = f"""
SELECT code, lat, lon, j, d,
       least(1e0, max(ratio) OVER (PARTITION BY code ORDER BY j)) AS ratio
FROM (SELECT code, lat, lon, j, d,
             CASE WHEN j = 11 THEN 1e0 ELSE f * (1e0 - 0.002e0 * CAST(s_suppkey % 10 AS DOUBLE))
               * (CASE WHEN j = 5 AND s_suppkey % 11 = 0 THEN 0.5e0 ELSE 1e0 END) END AS ratio
      FROM v_stations, {DUR_SQL} WHERE s_suppkey % 7 <> 0)"""

VIEWS["v_near_station"] = """
SELECT r, c, code FROM (
  SELECT r, c, code, row_number() OVER (PARTITION BY r, c ORDER BY
    (k.lon - s.lon) * (k.lon - s.lon) + (k.lat - s.lat) * (k.lat - s.lat), code) AS rn
  FROM v_cells k, (SELECT DISTINCT code, lat, lon FROM v_usable) s) WHERE rn = 1"""

# every distinct vector of the three modes, numbered, and the vector of each cell
VIEWS["v_mode_vectors"] = """
SELECT 'CETESB' AS disagg, r, c, (SELECT list(ratio ORDER BY j) FROM v_vec_cetesb) AS vec FROM v_cells
UNION ALL
SELECT 'STATION', n.r, n.c, u.vec FROM v_near_station n
JOIN (SELECT code, list(ratio ORDER BY j) AS vec FROM v_usable GROUP BY code) u USING (code)
UNION ALL
SELECT 'RASTER', r, c, list(ratio ORDER BY j) FROM v_filled GROUP BY r, c"""

VIEWS["v_vectors"] = """
SELECT row_number() OVER () AS vid, vec FROM (SELECT DISTINCT vec FROM v_mode_vectors)"""

VIEWS["v_scale"] = f"""
SELECT vid, d, vec[j + 1] / (d / 60e0) AS s, log10(vec[j + 1] / (d / 60e0)) AS z
FROM v_vectors, {DUR_SQL} WHERE vec[j + 1] > 0"""

VIEWS["v_range"] = "SELECT vid, 5e0 * max(d) AS bmax, pow(5e0 * max(d) / 0.05e0, 1e0 / 39e0) AS step FROM v_scale GROUP BY vid"


def _scored(candidates: str) -> str:
    """(vid, b) of least sum of squares among the candidates (vid, b)."""
    return f"""
SELECT vid, arg_min(b, sse) AS b FROM (
  SELECT vid, b, vz + 2 * c * cov + c * c * vx AS sse FROM (
    SELECT *, least(greatest(-cov / vx, 2.220446049250313e-16), 5e0) AS c FROM (
      SELECT vid, b, var_pop(log10(b + d)) * count(*) AS vx, var_pop(z) * count(*) AS vz,
             covar_pop(log10(b + d), z) * count(*) AS cov
      FROM ({candidates}) JOIN v_scale USING (vid) GROUP BY vid, b))) GROUP BY vid"""


VIEWS["v_pass0"] = _scored(
    f"SELECT vid, CASE WHEN i = 0 THEN 0e0 ELSE 0.05e0 * pow(bmax / 0.05e0, (i - 1) / {COARSE - 1}e0) END AS b "
    f"FROM v_range, range({COARSE + 1}) t(i)"
)
VIEWS["v_window0"] = """
SELECT vid, bmax, CASE WHEN b <= 0.05e0 THEN 0e0 ELSE b / step END AS lo,
       least(greatest(b, 0.05e0) * step, bmax) AS hi
FROM v_pass0 JOIN v_range USING (vid)"""
for _k in range(1, REFINE + 1):
    VIEWS[f"v_pass{_k}"] = _scored(
        f"SELECT vid, lo + i * ((hi - lo) / {FINE}e0) AS b FROM v_window{_k - 1}, range({FINE + 1}) t(i)"
    )
    VIEWS[f"v_window{_k}"] = f"""
SELECT vid, w.bmax, greatest(b - (hi - lo) / {FINE}e0, 0e0) AS lo, least(b + (hi - lo) / {FINE}e0, w.bmax) AS hi
FROM v_pass{_k} JOIN v_window{_k - 1} w USING (vid)"""

VIEWS["v_fit_bc"] = f"""
SELECT vid, b, -regr_slope(z, log10(b + d)) AS c, avg(log10(b + d)) AS xm, avg(z) AS zm
FROM v_pass{REFINE} JOIN v_scale USING (vid) GROUP BY vid, b"""

VIEWS["v_quant"] = f"""
SELECT product, bias, r, c, t, m + s * (-ln(ln(t / (t - 1e0))) / 1.282e0 - 0.450047e0) AS q
FROM v_stats, {PERIODS_SQL} WHERE s > 0"""

VIEWS["v_slope"] = """
SELECT product, bias, r, c, least(greatest(regr_slope(log10(q), log10(t)), -1e0), 1e0) AS a,
       avg(log10(q)) AS ym, avg(log10(t)) AS tm
FROM v_quant GROUP BY ALL"""

VIEWS["v_cell_vec"] = "SELECT disagg, r, c, vid FROM v_mode_vectors JOIN v_vectors USING (vec)"

VIEWS["v_params0"] = """
SELECT product, bias, disagg, r, c, vid, s.a, f.b, f.c AS cc, pow(10e0, ym + zm - s.a * tm + f.c * xm) AS k
FROM v_slope s JOIN v_cell_vec v USING (r, c) JOIN v_fit_bc f USING (vid)"""

VIEWS["v_quality"] = """
SELECT product, bias, disagg, r, c, avg((i - h) * (i - h)) AS mse,
       1e0 - sum((i - h) * (i - h)) / (var_pop(i) * count(*)) AS r2
FROM (SELECT p.product, p.bias, p.disagg, p.r, p.c, q.q * s.s AS i, p.k * pow(q.t, p.a) / pow(p.b + s.d, p.cc) AS h
      FROM v_params0 p JOIN v_quant q USING (product, bias, r, c) JOIN v_scale s USING (vid))
GROUP BY ALL"""

VIEWS["v_params"] = """
SELECT t.product, t.bias, v.disagg, t.r, t.c, p.k, p.a, p.b, p.cc, q.r2, sqrt(q.mse) AS rmse, q.mse,
       x.d AS ks_d, x.p AS ks_p, CASE WHEN x.p < 0.05 THEN 1 ELSE 0 END AS ks_reject, t.m, t.s, t.n
FROM v_stats t JOIN v_cell_vec v USING (r, c)
LEFT JOIN v_params0 p USING (product, bias, disagg, r, c)
LEFT JOIN v_quality q USING (product, bias, disagg, r, c)
LEFT JOIN v_ksp x USING (product, bias, r, c)"""

VIEWS["v_good"] = "SELECT * FROM v_params WHERE k IS NOT NULL AND r2 IS NOT NULL AND m > 0"

VIEWS["v_borrow"] = """
SELECT product, bias, disagg, r, c, sr, sc FROM (
  SELECT b.product, b.bias, b.disagg, b.r, b.c, g.r AS sr, g.c AS sc,
         row_number() OVER (PARTITION BY b.product, b.bias, b.disagg, b.r, b.c ORDER BY
           (b.r - g.r) * (b.r - g.r) + (b.c - g.c) * (b.c - g.c), g.r, g.c) AS rn
  FROM v_params b JOIN v_good g USING (product, bias, disagg)
  WHERE b.m > 0 AND (b.k IS NULL OR b.r2 IS NULL)) WHERE rn = 1"""

VIEWS["v_final"] = """
SELECT product, bias, disagg, r, c, k, a, b, cc, r2, rmse, mse, ks_d, ks_p, ks_reject, m, s, n FROM v_good
UNION ALL
SELECT x.product, x.bias, x.disagg, x.r, x.c, g.k, g.a, g.b, g.cc, g.r2, g.rmse, g.mse,
       x.ks_d, x.ks_p, x.ks_reject, x.m, x.s, x.n
FROM v_params x LEFT JOIN v_borrow w USING (product, bias, disagg, r, c)
LEFT JOIN v_good g ON g.product = w.product AND g.bias = w.bias AND g.disagg = w.disagg AND g.r = w.sr AND g.c = w.sc
WHERE NOT coalesce(x.k IS NOT NULL AND x.r2 IS NOT NULL AND x.m > 0, false)"""

VIEWS["v_surface"] = """
SELECT product, r, c, least(greatest(sum(w * zeta) / sum(w), 0.25e0), 10e0) AS zeta FROM (
  SELECT z.product, k.r, k.c, z.zeta,
         pow(greatest(sqrt((k.lon - z.lon) * (k.lon - z.lon) + (k.lat - z.lat) * (k.lat - z.lat)), 1e-12), -2e0) AS w,
         row_number() OVER (PARTITION BY z.product, k.r, k.c ORDER BY
           (k.lon - z.lon) * (k.lon - z.lon) + (k.lat - z.lat) * (k.lat - z.lat), z.station_id) AS rank
  FROM v_cells k, v_zeta z) WHERE rank <= 8 GROUP BY product, r, c"""


# from gauges to the fit: the years and bias options of each product, factors inside every other area ------------
VIEWS["v_windowed"] = """
SELECT product, r, c, y, mm FROM v_amax JOIN (VALUES ('XAVIER', 1990), ('IMERG', 1996), ('CHIRPS', 1990), ('PERS', 1990)) w(product, y0)
USING (product) WHERE y BETWEEN y0 AND 2000"""

VIEWS["v_amax_both_gauges"] = """
SELECT product, 'RAW' AS bias, r, c, y, mm FROM v_windowed
UNION ALL
SELECT a.product, 'BC', a.r, a.c, a.y, least(a.mm * least(greatest(z.zeta, 0.25e0), 5e0), 500e0)
FROM v_windowed a JOIN v_surface z ON z.product = a.product AND z.r = a.r AND z.c = a.c
JOIN v_cells k ON k.r = a.r AND k.c = a.c
WHERE a.product <> 'PERS' AND EXISTS (
  SELECT 1 FROM v_areas s WHERE s.poly_id % 2 = 0 AND k.lon >= s.x1 AND k.lon < s.x2 AND k.lat >= s.y1 AND k.lat < s.y2)"""

_CHAIN = ("v_stats", "v_ks", "v_ksp", "v_quant", "v_slope", "v_params0", "v_quality", "v_params", "v_good", "v_borrow", "v_final")
for _name in _CHAIN:
    VIEWS[f"{_name}_gauges"] = re.sub(rf"\b({'|'.join(('v_amax_both', *_CHAIN))})\b", r"\1_gauges", VIEWS[_name])
