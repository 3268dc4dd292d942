import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from rainspark.functions import series, text
from rainspark.operators import calendar
from rainspark.sources import columns, daily, inventory, pairs, rasters


def test_inventory_keeps_zeros_and_reads_latin1(spark, tmp_path):
    path = tmp_path / "inv.csv"
    path.write_bytes("Code,Name,State,Latitude,Longitude\n00047002,São João,São Paulo,-22.5,-47\n".encode("latin-1"))
    row = inventory.read_inventory(spark, str(path), "ISO-8859-1").first()
    assert (row.Code, row.Name, row.Latitude) == ("00047002", "São João", "-22.5")


def test_inventory_needs_its_columns(spark, tmp_path):
    path = tmp_path / "inv.csv"
    path.write_text("Code,Latitude\n1,2\n")
    with pytest.raises(ValueError, match="Longitude"):
        inventory.read_inventory(spark, str(path))


def test_owner_type_filter_keeps_unknown(spark):
    rows = [("1", "ANA", "2"), ("2", "ana", "2.0"), ("3", "X", "2"), ("4", None, None), ("5", "ANA", "x"), ("6", "ANA", "1")]
    df = spark.createDataFrame(rows, "Code string, Responsible string, Type string")
    kept = {r.Code for r in inventory.filter_owner_type(df).collect()}
    assert kept == {"1", "2", "4"}


def test_codes(spark):
    from rainspark.functions.text import normalise_code8

    rows = [("47002.0", "00047002"), (" 12 ", "00000012"), ("123456789", "123456789"), ("10.05", "00010.05")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.filter(normalise_code8(F.col("x")) != F.col("y")).count() == 0


def test_metadata_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Extra int, NYD int, Code int")
    assert inventory.reorder_metadata(df).columns == ["Code", "NYD", "Extra"]


def test_state_codes_stay_when_most_are_codes(spark):
    df = spark.createDataFrame([("SP",)] * 9 + [("Bahia",)], "State string")
    assert {r.STATE_ABBR for r in inventory.with_state_code(df).collect()} == {"SP", "Bahia"}
    df = spark.createDataFrame([("SP",)] * 5 + [("São  PAULO",)] * 5 + [("Nowhere",)], "State string")
    assert {r.STATE_ABBR for r in inventory.with_state_code(df).collect()} == {"SP", "Nowhere"}


def test_wide_file_to_long(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Code,Latitude,12/31/1999,1/1/2000,1/2/2000\na,1,0.5,,7\nb,2,x,3.25,-1\n")
    wide = spark.read.option("header", True).csv(str(path))
    assert daily.file_years(wide) == (1999, 2000)
    rows = {(r.Code, r.date): r.pr_g for r in daily.wide_to_long(wide, ["Code"]).collect()}
    assert rows == {
        ("a", dt.date(1999, 12, 31)): 0.5, ("a", dt.date(2000, 1, 1)): None, ("a", dt.date(2000, 1, 2)): 7.0,
        ("b", dt.date(1999, 12, 31)): None, ("b", dt.date(2000, 1, 1)): 3.25, ("b", dt.date(2000, 1, 2)): -1.0,
    }
    only = daily.wide_to_long(wide, ["Code"], 2000, 2005)
    assert only.agg(F.min("date")).first()[0] == dt.date(2000, 1, 1)
    with pytest.raises(ValueError, match="1999-2000"):
        daily.wide_to_long(wide, ["Code"], 2001, 2005)
    with pytest.raises(ValueError, match="no daily columns"):
        daily.file_years(spark.createDataFrame([(1,)], "Code int"))


def test_wide_export_lists_every_day(spark):
    long = spark.createDataFrame([("a", dt.date(2000, 2, 29), 4.0)], "code string, date date, pr_g double")
    meta = spark.createDataFrame([("a", "A"), ("b", "B")], "code string, name string")
    wide = daily.export_wide_daily(long, meta, dt.date(2000, 2, 28), dt.date(2000, 3, 1))
    assert wide.columns == ["code", "name", "2/28/2000", "2/29/2000", "3/1/2000"]
    assert sorted(map(tuple, wide.collect())) == [("a", "A", None, 4.0, None), ("b", "B", None, None, None)]


def scans(df):
    return str(df._jdf.queryExecution().executedPlan()).count("FileScan")


def test_wide_files_by_lines(spark, tmp_path):
    """Two files of one header are one scan, another header is a second; quotes, short lines, no numbers."""
    (tmp_path / "a.csv").write_text('Code,Name,12/31/1999,1/1/2000,1/2/2000\n007,"Rio, ""A""",0.5,,7\nb,B,x,"3.25",-1\n\n')
    (tmp_path / "b.csv").write_text("Code,Name,12/31/1999,1/1/2000,1/2/2000\r\nc,,1\r\n")
    (tmp_path / "c.csv").write_text("\ufeff1/3/2000,Code,note,Name\n4,007,q,R\n")
    got = daily.read_wide_daily(spark, str(tmp_path), ["Code", "Name"])
    d = [dt.date(1999, 12, 31), dt.date(2000, 1, 1), dt.date(2000, 1, 2), dt.date(2000, 1, 3)]
    assert scans(got) == 2
    assert {(r.Code, r.Name, r.date): r.pr_g for r in got.collect()} == {
        ("007", 'Rio, "A"', d[0]): 0.5, ("007", 'Rio, "A"', d[1]): None, ("007", 'Rio, "A"', d[2]): 7.0,
        ("b", "B", d[0]): None, ("b", "B", d[1]): 3.25, ("b", "B", d[2]): -1.0,
        ("c", "", d[0]): 1.0, ("c", "", d[1]): None, ("c", "", d[2]): None, ("007", "R", d[3]): 4.0,
    }
    only = daily.read_wide_daily(spark, str(tmp_path / "a.csv"), ["Code"], 2000, 2005)
    assert only.agg(F.min("date"), F.count("*")).first()[:] == (d[1], 4)
    with pytest.raises(ValueError, match="1999-2000"):
        daily.read_wide_daily(spark, str(tmp_path / "a.csv"), ["Code"], 2001, 2005)
    with pytest.raises(ValueError, match="City"):
        daily.read_wide_daily(spark, str(tmp_path / "a.csv"), ["City"])
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("Code\n1\n")
    with pytest.raises(ValueError, match="no daily columns"):
        daily.read_wide_daily(spark, str(tmp_path / "none"), ["Code"])


def test_thirty_years_as_one_wide_table(spark, tmp_path):
    start, end = dt.date(1990, 1, 1), dt.date(2019, 12, 31)
    rows = [("a", start, 4.0), ("a", start, 9.0), ("a", dt.date(2000, 2, 29), 0.1), ("a", end, 1e-7), ("b", dt.date(2001, 5, 5), 2.5)]
    rows += [("b", dt.date(2002, 1, 1), None), ("b", dt.date(2020, 1, 1), 3.0), ("c", dt.date(1989, 12, 31), 3.0), ("other", start, 1.0)]
    long = spark.createDataFrame(rows, "code string, date date, pr_g double")
    meta = spark.createDataFrame([("a", 'A, "x"'), ("b", "B"), ("c", None)], "code string, name string")
    daily.write_wide_daily(long, meta, str(tmp_path / "wide"), start, end)
    lines = [x for f in (tmp_path / "wide").glob("part-*") for x in f.read_text().splitlines()]
    assert {x.count(",") - x.count(", ") for x in lines} == {10957 + 1}
    back = daily.read_wide_daily(spark, str(tmp_path / "wide"), ["code", "name"])
    # beside the dates themselves, which are literals, nothing in the plan is per day
    plan = re.sub(r"[0-9/,\s-]+", "", str(back._jdf.queryExecution().executedPlan()))
    assert scans(back) == 1 and len(plan) < 5000
    assert back.count() == 3 * 10957
    assert {(r.code, r.name, r.date, r.pr_g) for r in back.filter("pr_g IS NOT NULL").collect()} == {
        ("a", 'A, "x"', start, 4.0), ("a", 'A, "x"', dt.date(2000, 2, 29), 0.1), ("a", 'A, "x"', end, 1e-7),
        ("b", "B", dt.date(2001, 5, 5), 2.5),
    }


def test_pair_files_are_scanned_once_per_header(spark, tmp_path):
    for y in range(2000, 2006):
        name = "imerg_mm" if y < 2003 else "imerg"
        (tmp_path / f"p_{y}.csv").write_text(f"station_id,date,{name},pr_g\n00000007,{y}-01-05,10,20\n")
    got = pairs.read_pair_csv(spark, [str(f) for f in sorted(tmp_path.glob("p_*.csv"))])
    assert scans(got) == 2
    assert sorted((r.date.year, r["product"], r.pr_p, r.ratio) for r in got.collect()) == [(y, "IMERG", 10.0, 2.0) for y in range(2000, 2006)]


def test_pair_files_of_two_layouts(spark, tmp_path):
    one, two = tmp_path / "p_2000.csv", tmp_path / "p_2001.csv"
    one.write_text("station_id,lat,lon,date,chirps_mm,pr_g,ratio\n00000007,1,2,2000-01-05,10,20,2\n")
    two.write_text("station_id,date,chirps_mm,pr_g\n7.0,2001-01-05,8,4\n")
    got = pairs.read_pair_csv(spark, [str(one), str(two)]).orderBy("date").collect()
    assert [(r.station_id, r.product, r.pr_p, r.ratio) for r in got] == [
        ("00000007", "CHIRPS", 10.0, 2.0), ("00000007", "CHIRPS", 8.0, 0.5)
    ]
    assert got[1].lat is None
    with pytest.raises(FileNotFoundError):
        pairs.read_pair_csv(spark, [])


def test_column_guessing(spark):
    df = spark.createDataFrame([("1/15/1980", "2003-12-01 00:00:00", 3)], "StartDate string, EndDate string, NYD int")
    got = df.select(columns.guess_year(df, "start").alias("s"), columns.guess_year(df, "end").alias("e")).first()
    assert tuple(got) == (1980, 2003)
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "start_year int, Latitude double, LONG double, UF string")
    assert [columns.guess_column(df, r) for r in ("lat", "lon", "state")] == ["Latitude", "LONG", "UF"]
    with pytest.raises(ValueError):
        columns.guess_column(df, "nyd")


def test_raster_catalogue_takes_first_of_year(spark):
    names = ["b_2001.tif", "a_2001.tif", "a_1999_v2.tif", "x.tif", "a_1990.tif"]
    got = rasters.raster_catalogue(spark.createDataFrame([(n,) for n in names], "name string"), 1994, 2024)
    assert [(r.year, r.name) for r in got.collect()] == [(2001, "a_2001.tif")]


def test_golden_series(spark):
    """Known maxima and their first dates, with a tie added."""
    days = {
        dt.date(1995, 1, 8): 115.0, dt.date(1995, 6, 1): 115.0, dt.date(1995, 7, 1): 20.0,
        dt.date(1996, 2, 9): 58.2, dt.date(1996, 2, 10): 58.1, dt.date(1997, 3, 6): 71.8, dt.date(1997, 1, 1): None,
    }
    df = spark.createDataFrame([("02549017", d, v) for d, v in days.items()], "code string, date date, pr_g double")
    got = sorted((r.year, r.max_mm, r.date_of_max) for r in calendar.annual_max(df).collect())
    assert got == [
        (1995, 115.0, dt.date(1995, 1, 8)), (1996, 58.2, dt.date(1996, 2, 9)), (1997, 71.8, dt.date(1997, 3, 6)),
    ]


def test_text_outputs(spark):
    from rainspark.functions import text
    from rainspark.sources import sinks

    df = spark.createDataFrame([(1.5, "BR-DWGD (Xavier) x"), (2.0, "a"), (None, None), (100.0, "b")], "v double, s string")
    assert [r[0] for r in df.select(text.trim_number(F.col("v"))).collect()] == ["1.5", "2", "", "100"]
    assert df.select(text.safe_name(F.col("s"))).first()[0] == "BR_DWGD_Xavier_x"
    day = spark.createDataFrame([("a", dt.date(2000, 1, 9), 3.0)], "code string, date date, pr_g double")
    assert day.select(text.us_date_label(F.col("date"))).first()[0] == "1/9/2000"
    assert sinks.daily_table(day).first().Rain_mm_day == "3.00"


def test_bands_by_name_or_position(spark):
    from rainspark.grid import PARAMETER_BANDS

    named = spark.createDataFrame([(7, *[float(i) for i in range(13)])], "cell int, " + ", ".join(f"{b} double" for b in reversed(PARAMETER_BANDS)))
    assert rasters.parameter_stack(named, ["cell"]).first().K == 12.0
    plain = named.toDF("cell", *[f"b{i}" for i in range(13)])
    stack = rasters.parameter_stack(plain, ["cell"]).first()
    assert (stack.K, stack.Nyears) == (0.0, 12.0)
    with pytest.raises(ValueError, match="Nyears"):
        rasters.band(plain.drop("b12"), "Nyears", keys=1)


def test_state_column_is_optional_and_in_order(spark):
    names = lambda *c: spark.createDataFrame([tuple("x" for _ in c)], list(c))
    assert columns.guess_column(names("UF", "State"), "state") == "UF"
    assert [columns.guess_column(names(c), "state") for c in ("ST", "Region", "Province", "admin1")] == ["ST", "Region", "Province", "admin1"]
    assert columns.guess_column(names("Code", "Lat"), "state") is None


def test_year_is_taken_from_one_column(spark):
    df = spark.createDataFrame([(None, "1/15/1980"), ("1990", "2/1/1970")], "start_year string, StartDate string")
    assert [r[0] for r in df.select(columns.guess_year(df, "start")).collect()] == [None, 1990]
    empty = df.withColumn("start_year", F.lit("n/a"))
    assert sorted(r[0] for r in empty.select(columns.guess_year(empty, "start")).collect()) == [1970, 1980]


def test_accents_of_their_own_are_folded(spark):
    df = spark.createDataFrame([("Sa\u0303o Paulo",), ("S\u00e3o Paulo",), ("Ceara\u0301",)], "s string")
    assert [r[0] for r in df.select(text.state_code(F.col("s"))).collect()] == ["SP", "SP", "CE"]


def test_knots_at_one_place_give_null(spark):
    df = spark.createDataFrame([([1.0, 1.0, 2.0], [1.0, 2.0, 3.0], 1.5), ([1.0, 2.0], [1.0, 3.0], 1.5)], "p array<double>, g array<double>, x double")
    got = df.select(series.hermite_with_linear_tails(F.col("x"), F.col("p"), F.col("g"), series.pchip_slopes(F.col("p"), F.col("g"))))
    assert [r[0] for r in got.collect()] == [None, 2.0]


def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    rows = "Code,Name,Latitude,Longitude\n00012,São José,-1.5,-50\n"
    (tmp_path / "a b.csv").write_bytes(rows.encode("latin-1"))
    (tmp_path / "c%41.csv").write_bytes(("\ufeff" + rows.replace("00012", "00013").replace("José", "João")).encode())
    (tmp_path / "plain.csv").write_bytes(b"Code,Name,Latitude,Longitude\n00014,Ipe,0,-49\n")
    kinds = {r.file.rsplit("/", 1)[1]: r.encoding for r in inventory.file_encodings(spark, str(tmp_path)).collect()}
    assert sorted(kinds.values()) == ["ISO-8859-1", "UTF-8", "UTF-8"]
    got = {(r.Code, r.Name) for r in inventory.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {("00012", "São José"), ("00013", "São João"), ("00014", "Ipe")}
