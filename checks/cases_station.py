"""Inventory, daily series and calendar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import case, r6, rounded
from checks.sql_views import PRODUCTS_SQL, STATES_SQL, r6 as q6
from rainspark.functions import text
from rainspark.operators import calendar, extremes
from rainspark.session import shared_folder
from rainspark.sources import daily, inventory, products, rasters, sinks

FIRST, LAST = 1995, 2001  # years of the given tables, as columns of the SQL

CLEAN_SQL = """
SELECT Code8, Responsible, Type, NYD, lat AS Latitude, lon AS Longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY Code8 ORDER BY ordinal) AS rn FROM v_inventory
  WHERE lat IS NOT NULL AND (upper(Responsible) = 'ANA' OR Responsible IS NULL)
    AND (CAST(CAST(Type AS DOUBLE) AS INTEGER) = 2 OR Type IS NULL)) WHERE rn = 1"""


def _clean(raw):
    out = inventory.clean_inventory(raw.withColumn("ordinal", F.col("ordinal").cast("long")), ["ordinal"])
    return out.select(
        "Code8", "Responsible", "Type", F.col("NYD").cast("double").alias("NYD"), "Latitude", "Longitude"
    )


@case("inventory_clean", CLEAN_SQL)
def inventory_clean(spark, d):
    return _clean(t.inventory(spark, d))


@case("inventory_csv_roundtrip", CLEAN_SQL)
def inventory_csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}"
    # codes with a leading blank are quoted by the writer, so the text survives unchanged
    listed = t.inventory(spark, d)
    sinks.write_csv(listed.filter("ordinal % 3 <> 0"), path)
    # a third of the rows lies in latin-1 files of the same folder
    listed.filter("ordinal % 3 = 0").write.mode("append").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return _clean(inventory.read_inventory(spark, path))


@case("code_match_ignoring_zeros", """
SELECT i.Code AS listed, count(*) AS n_days
FROM v_inventory i JOIN v_gauge g
  ON ltrim(regexp_replace(trim(i.Code), '\\.0$', ''), '0') = ltrim(g.code, '0')
GROUP BY i.Code""")
def code_match_ignoring_zeros(spark, d):
    listed = t.inventory(spark, d).select(
        F.col("Code").alias("listed"),
        text.strip_leading_zeros(text.normalise_code8(F.col("Code"))).alias("bare"),
    )
    days = t.gauge_daily(spark, d).groupBy("code").agg(F.count("*").alias("n"))
    bare = days.select(text.strip_leading_zeros(F.col("code")).alias("bare"), "n")
    return listed.join(bare, "bare").groupBy("listed").agg(F.sum("n").alias("n_days"))


@case("stations_by_owner", """
SELECT coalesce(Responsible, 'Unknown') AS Responsible, count(*) AS n FROM v_inventory GROUP BY 1""")
def stations_by_owner(spark, d):
    return calendar.count_by(t.inventory(spark, d), "Responsible")


@case("stations_by_state_code", f"""
SELECT coalesce(s.abbr, State) AS STATE_ABBR, count(*) AS n
FROM v_inventory LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in text.STATE_CODES.items())}) s(plain, abbr)
  ON s.plain = regexp_replace(lower(strip_accents(State)), '\\s+', ' ', 'g')
GROUP BY 1""")
def stations_by_state_code(spark, d):
    return calendar.count_by(inventory.with_state_code(t.inventory(spark, d)), "STATE_ABBR")


@case("region_first_covered_station", """
SELECT s.code, s.name, count(*) AS n_days FROM v_stations s JOIN v_gauge g USING (code)
WHERE s.state = (SELECT min(state) FROM v_stations) AND g.date BETWEEN DATE '1995-02-01' AND DATE '2001-11-30'
GROUP BY s.code, s.name, s.s_suppkey HAVING count(*) >= CAST(floor(1.3 * 365) AS INTEGER)
ORDER BY s.s_suppkey LIMIT 1""")
def region_first_covered_station(spark, d):
    st = t.stations(spark, d).withColumnRenamed("state", "State")
    local = inventory.select_region(st, state=st.agg(F.min("State")).first()[0])
    return calendar.first_with_coverage(
        local, t.gauge_daily(spark, d), "1995-02-01", "2001-11-30", 1.3, ["s_suppkey"]
    ).select("code", "name", "n_days")


@case("coverage_by_window", """
SELECT code, count(*) AS n_days FROM v_gauge WHERE date BETWEEN DATE '1995-02-01' AND DATE '2001-11-30'
GROUP BY code HAVING count(*) >= 474""")
def coverage_by_window(spark, d):
    return calendar.coverage(t.gauge_daily(spark, d), "1995-02-01", "2001-11-30", 1.3)


@case("annual_max", """
SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_g) AS max_mm, arg_min(date, struct_pack(a := -pr_g, b := date)) AS date_of_max
FROM v_gauge GROUP BY 1, 2""")
def annual_max(spark, d):
    return calendar.annual_max(t.gauge_daily(spark, d))


@case("annual_max_of_covered_stations", """
SELECT code, CAST(year(date) AS INTEGER) AS year, max(pr_g) AS max_mm FROM v_gauge
WHERE date BETWEEN DATE '1995-02-01' AND DATE '2001-11-30' AND code IN (
  SELECT code FROM v_gauge WHERE date BETWEEN DATE '1995-02-01' AND DATE '2001-11-30'
  GROUP BY code HAVING count(*) >= 474) GROUP BY 1, 2""")
def annual_max_of_covered_stations(spark, d):
    found = calendar.covered_annual_max(t.gauge_daily(spark, d), "1995-02-01", "2001-11-30", 1.3)
    return found.drop("date_of_max", "n_days")


@case("annual_max_grid", """
SELECT code, CAST(y AS INTEGER) AS year, m.max_mm
FROM (SELECT DISTINCT code FROM v_gauge), range(1993, 2004) s(y)
LEFT JOIN (SELECT code AS k, year(date) AS yy, max(pr_g) AS max_mm FROM v_gauge GROUP BY 1, 2) m ON k = code AND yy = y""")
def annual_max_grid(spark, d):
    return calendar.annual_max_grid(calendar.annual_max(t.gauge_daily(spark, d)), 1993, 2003)


@case("wide_annual", "SELECT s.code, s.name, " + ", ".join(
    f"max(pr_g) FILTER (year(date) = {y}) AS \"{y}\"" for y in range(FIRST, LAST + 1)
) + " FROM v_stations s JOIN v_gauge g USING (code) GROUP BY s.code, s.name")
def wide_annual(spark, d):
    annual = calendar.annual_max(t.gauge_daily(spark, d))
    first, last = annual.agg(F.min("year"), F.max("year")).first()
    return calendar.export_wide_annual(annual, t.stations(spark, d).select("code", "name"), first, last)


@case("wide_daily_roundtrip", "SELECT code, date, pr_g FROM v_gauge")
def wide_daily_roundtrip(spark, d):
    """All years out as one wide CSV table and back to long rows."""
    gauge, stations = t.gauge_daily(spark, d), t.stations(spark, d).select("code", "name")
    first, last = gauge.agg(F.min("date"), F.max("date")).first()
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    daily.write_wide_daily(gauge, stations, path, first, last)
    return daily.read_wide_daily(spark, path, ["code"]).filter("pr_g IS NOT NULL")


@case("year_slice", "SELECT code, date, pr_g FROM v_gauge WHERE year(date) BETWEEN 1997 AND 1999")
def year_slice(spark, d):
    return daily.year_slice(t.gauge_daily(spark, d), 1997, 1999)


@case("missing_stations", """
SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code FROM customer
WHERE lpad(CAST(c_custkey AS VARCHAR), 8, '0') NOT IN (SELECT code FROM v_gauge)""")
def missing_stations(spark, d):
    requested = t.table(spark, d, "customer").select(t.code_of("c_custkey").alias("code"))
    return daily.missing_stations(requested, t.gauge_daily(spark, d))


@case("gauge_qc", f"""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_days,
       count(CASE WHEN v BETWEEN 0 AND 500 THEN 1 END) AS n_valid,
       count(CASE WHEN v >= 0 THEN 1 END) AS n_not_negative,
       {q6("sum(greatest(v, 0e0))", 3)} AS clipped_sum
FROM (SELECT *, (l_extendedprice / 1000e0 - 10e0) * 6e0 AS v FROM lineitem) GROUP BY 1""")
def gauge_qc(spark, d):
    raw = t.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        ((F.col("l_extendedprice") / 1000.0 - 10.0) * 6.0).alias("v"),
    ).select("date", F.col("v").alias("valid"), F.col("v").alias("open"), F.col("v").alias("clipped"))
    checked = extremes.gauge_qc(raw, 500.0, "valid")
    checked = extremes.gauge_qc(checked, None, "open")
    checked = extremes.non_negative(checked, "clipped")
    return checked.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("n_days"), F.count("valid").alias("n_valid"),
        F.count("open").alias("n_not_negative"), r6(F.sum("clipped"), 3).alias("clipped_sum"),
    )


@case("annual_table_text", """
SELECT code, y AS Year, (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS MaxDaily_mm, shown
FROM (SELECT lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS code, CAST(year(l_shipdate) AS INTEGER) AS y,
             (CAST(round(max(l_extendedprice) * 100) AS BIGINT) + 500) // 1000 AS h,
             rtrim(rtrim(printf('%.2f', max(l_quantity)), '0'), '.') AS shown
      FROM lineitem GROUP BY 1, 2)""")
def annual_table_text(spark, d):
    annual = calendar.annual_max(t.gauge_daily(spark, d))
    quantity = t.table(spark, d, "lineitem").groupBy(
        t.code_of("l_suppkey").alias("code"), F.year("l_shipdate").alias("Year")
    ).agg(text.trim_number(F.max("l_quantity")).alias("shown"))
    return sinks.annual_table(annual).drop("DateOfMax").join(quantity, ["code", "Year"])


@case("date_from_image_index", """
SELECT CAST(l_shipdate AS DATE) + CASE WHEN l_linenumber % 3 = 2 THEN 1 ELSE 0 END AS date, count(*) AS n
FROM lineitem GROUP BY 1""")
def date_from_image_index(spark, d):
    """Images named pr_YYYYMMDD or YYYYMMDD, and unnamed ones that carry the date themselves."""
    k = F.col("l_linenumber") % 3
    stamp = F.date_format("l_shipdate", "yyyyMMdd")
    images = t.table(spark, d, "lineitem").select(
        F.when(k == 0, F.concat(F.lit("pr_"), stamp)).when(k == 1, stamp).otherwise("image").alias("idx"),
        F.date_add(F.col("l_shipdate").cast("date"), 1).alias("own"),
    )
    found = images.select(daily.date_from_image_index(F.col("idx"), F.col("own")).alias("date"))
    return found.groupBy("date").agg(F.count("*").alias("n"))


FILES_SQL = f"""
SELECT DISTINCT product, product || '_max_v' || (l_linenumber % 2) || '_' || CAST(year(l_shipdate) AS VARCHAR) || '.tif' AS name
FROM lineitem, {PRODUCTS_SQL}"""


def _files(spark, d):
    items = F.array(*[F.lit(p) for p, _ in t.FACTORS])
    version = F.concat(F.lit("_max_v"), (F.col("l_linenumber") % 2).cast("string"), F.lit("_"))
    return (
        t.table(spark, d, "lineitem")
        .select(version.alias("v"), F.year("l_shipdate").cast("string").alias("y")).distinct()
        .withColumn("product", F.explode(items))
        .select("product", F.concat("product", "v", "y", F.lit(".tif")).alias("name"))
    )


@case("raster_catalogue", f"""
SELECT product, y AS year, min(name) AS name FROM (
  SELECT product, name, CAST(regexp_extract(name, '_(\\d{{4}})\\.tif$', 1) AS INTEGER) AS y FROM ({FILES_SQL}))
WHERE y BETWEEN 1996 AND 2000 GROUP BY 1, 2""")
def raster_catalogue(spark, d):
    return rasters.raster_catalogue(_files(spark, d), 1996, 2000, keys=("product",)).select("product", "year", "name")


@case("outputs_still_to_write", f"""
SELECT DISTINCT product, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem, {PRODUCTS_SQL}
WHERE NOT (product = 'IMERG' AND year(l_shipdate) IN (SELECT year(o_orderdate) FROM orders WHERE o_orderstatus = 'F'))""")
def outputs_still_to_write(spark, d):
    wanted = rasters.raster_catalogue(_files(spark, d), 1900, 2100, keys=("product",)).select("product", "year")
    done = t.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.lit("IMERG").alias("product"), F.year("o_orderdate").alias("year")
    ).distinct()
    return rasters.new_only(wanted, done, ["product", "year"])


@case("nodata_and_scale", f"""
SELECT l_linenumber, count(mm) AS n_valid, {q6("sum(mm)", 3)} AS total, {q6("sum(greatest(mm, 0e0))", 3)} AS total0
FROM (SELECT l_linenumber, CASE WHEN l_discount <> 0 AND abs(l_extendedprice) <= 100000
                                THEN l_extendedprice * 0.006866665e0 + -225e0 END AS mm FROM lineitem)
GROUP BY 1""")
def nodata_and_scale(spark, d):
    from rainspark.functions.numeric import decode_scale_offset, mask_nodata

    raw = F.when(F.col("l_discount") == 0, -32768.0).otherwise(F.col("l_extendedprice"))
    clean = mask_nodata(raw, -32768.0, huge=100000.0)
    mm = t.table(spark, d, "lineitem").select(
        "l_linenumber", decode_scale_offset(clean, 0.006866665, -225.0).alias("mm"),
        decode_scale_offset(clean, 0.006866665, -225.0, floor0=True).alias("mm0"),
    )
    return mm.groupBy("l_linenumber").agg(
        F.count("mm").alias("n_valid"), r6(F.sum("mm"), 3).alias("total"), r6(F.sum("mm0"), 3).alias("total0")
    )


@case("product_availability", """
SELECT product, label, years, 'RAW, BC' AS bias_options, n_days
FROM (VALUES ('XAVIER', 'BR-DWGD', '1994-2024', 1994), ('IMERG', 'IMERG', '2000-2024', 2000),
             ('CHIRPS', 'CHIRPS', '1994-2024', 1994), ('PERS', 'PERSIANN', '1994-2024', 1994)) a(product, label, years, y0)
JOIN (SELECT product AS p, count(DISTINCT date) AS n_days FROM v_products
      WHERE year(date) >= CASE WHEN product = 'IMERG' THEN 2000 ELSE 1994 END GROUP BY 1) ON p = product""")
def product_availability(spark, d):
    config = products.product_config(spark)
    images = t.product_daily(spark, d).join(config.select("product", "first_year", "last_year"), "product")
    inside = images.filter(F.year("date").between(F.col("first_year"), F.col("last_year")))
    # days first, so that the distinct count is an ordinary sum of rows
    days = inside.groupBy("product", "date").agg(F.lit(1).alias("one")).groupBy("product").agg(
        F.count("*").alias("n_days")
    )
    return products.availability(config).join(days, "product")
