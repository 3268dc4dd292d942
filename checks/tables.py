"""The rainfall tables as Spark views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainspark.grid import CETESB_FACTORS, DURATIONS_MIN, Grid
from rainspark.operators.polygons import rectangle
from rainspark.session import materialise
from rainspark.sources.products import product_config

COARSE = Grid(-73.0, 5.0, 9.5, 9.5, 4, 4)
FINE = Grid(-73.0, 5.0, 0.38, 0.19, None, 100)
TARGET = Grid(-72.9, 4.9, 0.5, 0.25, None, 75)
FACTORS = (("XAVIER", 1.1), ("IMERG", 1.0), ("CHIRPS", 0.9), ("PERS", 0.8))
STATE_NAMES = (
    "São Paulo", "Goiás", "Pará", "ACRE", "Minas  Gerais", "Ceará", "Rio de Janeiro", "Bahia",
    "Paraná", "Maranhão", "Piauí", "Amapá", "Espírito Santo", "Rondônia", "Tocantins", "Sergipe",
    "Roraima", "Alagoas", "Amazonas", "Paraíba", "Pernambuco", "Santa Catarina", "Mato Grosso",
    "Distrito Federal", "Elsewhere",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: str) -> Column:
    s = F.col(key).cast("string")
    return F.when(F.length(s) < 8, F.lpad(s, 8, "0")).otherwise(s)


def day_of(column: str) -> Column:
    return F.col(column).cast("date")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, s_suppkey, name, state, lat, lon."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            code_of("s_suppkey").alias("code"), "s_suppkey", F.col("s_name").alias("name"),
            F.col("n_name").alias("state"),
            (F.lit(-33.0) + F.lit(38.0) * ((k * 37) % 101 + 0.5) / F.lit(101.0)).alias("lat"),
            (F.lit(-73.0) + F.lit(38.0) * ((k * 53) % 97) / F.lit(97.0)).alias("lon"),
        )
    )


def gauge_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, pr_g: one value per station and day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", day_of("l_shipdate").alias("date"))
        .agg((F.max("l_extendedprice") / 1000.0).alias("pr_g"))
        .select(code_of("l_suppkey").alias("code"), "date", "pr_g")
    )


def _by_product(df: DataFrame, value: str) -> DataFrame:
    items = F.array(*[
        F.struct(F.lit(p).alias("product"), F.lit(f).alias("f")) for p, f in FACTORS
    ])
    return df.withColumn("i", F.explode(items)).select(
        F.col("i.product").alias("product"), *[c for c in df.columns if c != value],
        (F.col(value) * F.col("i.f")).alias(value),
    )


def product_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, row, col, date, pr_p on the coarse grid; exact sums of cents."""
    cell = F.col("l_partkey") % 16
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    mean = F.sum(cents).cast("double") / (F.count("*") * F.lit(100000.0))
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.floor(cell / 4).cast("int").alias("row"), (cell % 4).cast("int").alias("col"),
            day_of("l_shipdate").alias("date"),
        )
        .agg(mean.alias("pr_p"))
    )
    return _by_product(daily, "pr_p")


def _lines_by_cell(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """row, col and `columns` of every line; all lines of a cell are in one of a fixed number of tasks.

    Whatever is grouped by cell and more afterwards moves no further, and no task is merged with others by the
    bytes it reads, of which each becomes many for the products and bias options.
    """
    k = F.col("l_partkey")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "lineitem").select(
        F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"), *columns, "l_extendedprice"
    ).repartition(tasks, "row", "col")


def fine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col of the fine grid, one cell per part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col")
    )


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"),
        (F.col("p_retailprice") + F.col("p_size") * 10.0).alias("elev_m"),
    )


def fine_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, row, col, date, pr_p on the fine grid (sparse days)."""
    daily = _lines_by_cell(spark, sf_dir, day_of("l_shipdate").alias("date")).groupBy("row", "col", "date").agg((F.max("l_extendedprice") / 1000.0).alias("pr_p"))
    return _by_product(daily, "pr_p")


def fine_amax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, row, col, year, mm."""
    amax = _lines_by_cell(spark, sf_dir, F.year("l_shipdate").alias("year")).groupBy("row", "col", "year").agg((F.max("l_extendedprice") / 1000.0).alias("mm"))
    return _by_product(amax, "mm")


def zeta_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, row, col, zeta from 0.1 to 6 on the fine grid."""
    z = F.lit(0.1) + ((F.col("row") * 7 + F.col("col")) % 60).cast("double") / F.lit(10.0)
    return _by_product(fine_cells(spark, sf_dir).withColumn("zeta", z), "zeta")


def corrected_amax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product, bias, row, col, year, mm: raw maxima and maxima times a mild factor."""
    raw = fine_amax(spark, sf_dir)
    z = F.lit(0.8) + ((F.col("row") * 7 + F.col("col")) % 10).cast("double") / F.lit(20.0)
    both = F.array(
        F.struct(F.lit("RAW").alias("bias"), F.col("mm").alias("mm")),
        F.struct(F.lit("BC").alias("bias"), (F.col("mm") * z).alias("mm")),
    )
    return raw.withColumn("i", F.explode(both)).select(
        "product", "i.bias", "row", "col", "year", "i.mm"
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rectangles: poly_id, rings, adm2 (nation), adm1 and adm0 (region)."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    k = F.col("n_nationkey")
    x1 = F.lit(-73.0) + (k % 5).cast("double") * 7.6
    y1 = F.lit(-33.0) + F.floor(k / 5).cast("double") * 7.6
    return (
        table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("poly_id"), F.col("n_name").alias("adm2"),
            F.concat(F.lit("zone "), F.col("r_name")).alias("adm1"), F.col("r_name").alias("adm0"),
            rectangle(x1, y1, x1 + 7.6, y1 + 7.6).alias("rings"),
        )
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inventory text with codes in several forms, unknowns and repeated stations."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    base = table(spark, sf_dir, "supplier").select(
        F.when(k % 3 == 0, text).when(k % 3 == 1, F.concat(F.lit(" "), text, F.lit(".0")))
        .otherwise(code_of("s_suppkey")).alias("Code"),
        F.col("s_name").alias("Name"),
        F.element_at(F.array(*[F.lit(s) for s in STATE_NAMES]), F.col("s_nationkey") + 1).alias("State"),
        F.when(k % 13 == 0, "n/a").otherwise((k % 60 - 30).cast("string")).alias("Latitude"),
        (k % 90 - 80).cast("string").alias("Longitude"),
        F.concat_ws("/", F.lit("1"), F.lit("15"), (k % 20 + 1960).cast("string")).alias("StartDate"),
        F.concat_ws("/", F.lit("12"), F.lit("3"), (k % 45 + 1970).cast("string")).alias("EndDate"),
        (k % 40).cast("string").alias("NYD"),
        F.when(k % 17 == 0, "x").otherwise((k * k % 1009).cast("string")).alias("MD"),
        (k * 7 % 31).cast("string").alias("N_YWOMD"),
        (k * 11 % 97).cast("string").alias("YWMD"),
        F.when(k % 5 == 0, "ana").when(k % 5 == 3, "OTHER").when(k % 5 < 3, "ANA").alias("Responsible"),
        F.when(k % 4 == 0, "2").when(k % 4 == 1, "1").when(k % 4 == 3, "2.0").alias("Type"),
        k.alias("ordinal"),
    )
    # a second listing of every station, later in the file and under its padded code
    again = base.withColumn("Code", F.lpad(F.regexp_extract("Code", r"(\d+)", 1), 8, "0")).withColumn(
        "ordinal", F.col("ordinal") + 1_000_000_000_000
    ).withColumn("Longitude", F.lit("0"))
    return base.unionByName(again)


def station_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station ratio columns with notes and deliberate dips: code, lat, lon, note, all_c5 ... .

    Written once, as such a table is a file: the optimizer would otherwise push filters on the
    twelve columns into their definitions and spend seconds on the combinations.
    """
    k = F.col("s_suppkey")
    scale = F.lit(1.0) - F.lit(0.002) * (k % 10).cast("double")
    columns = []
    for j, d in enumerate(DURATIONS_MIN):
        v = F.lit(CETESB_FACTORS[j]) / F.lit(1.14)
        v = v if d == 1440 else v * scale
        if j == 5:
            v = F.when(k % 11 == 0, v * 0.5).otherwise(v)
        columns.append(v.alias(f"all_c{d}"))
    note = F.when(k % 7 == 0, "poor fit").otherwise("fit OK").alias("note")
    return materialise(
        stations(spark, sf_dir).select("code", "s_suppkey", "lat", "lon").select(
            "code", "lat", "lon", note, *columns
        ),
        "stations",
    )


def ratio_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ratio rasters: row, col, duration_min, ratio, with gaps and dips."""
    cell = F.col("row") * 100 + F.col("col")
    scale = F.lit(1.0) - F.lit(0.002) * (cell % 10).cast("double")
    items = F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(d).alias("d"), (F.lit(CETESB_FACTORS[j]) / F.lit(1.14)).alias("f"))
        for j, d in enumerate(DURATIONS_MIN[:-1])
    ])
    gap = (cell % 5 == 0) & (F.col("i.j") == cell % 11)
    dip = F.when((cell % 6 == 0) & (F.col("i.j") == 5), 0.5).otherwise(1.0)
    return fine_cells(spark, sf_dir).withColumn("i", F.explode(items)).select(
        "row", "col", F.col("i.d").alias("duration_min"),
        F.when(~gap, F.col("i.f") * scale * dip).alias("ratio"),
    )


def station_pairs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, pr_p, pr_g of the IMERG product at each station's coarse cell."""
    st = stations(spark, sf_dir)
    row, col = COARSE.row_of(F.col("lat")), COARSE.col_of(F.col("lon"))
    placed = st.select("code", row.alias("row"), col.alias("col"))
    one = product_daily(spark, sf_dir).filter("product = 'IMERG'").drop("product")
    return gauge_daily(spark, sf_dir).join(placed, "code").join(
        one, ["date", "row", "col"], "left"
    ).select("code", "date", "pr_p", "pr_g")


def dated_products(spark: SparkSession) -> DataFrame:
    """The product configuration four years earlier and up to 2000, as the given tables cover 1995 to 2001; PERS raw only."""
    biases = F.when(F.col("product") == "PERS", F.array(F.lit("RAW"))).otherwise(F.col("biases"))
    return product_config(spark).select(
        "product", (F.col("first_year") - 4).alias("first_year"), (F.col("last_year") - 24).alias("last_year"), biases.alias("biases")
    )


def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other rectangle of the areas, as a boundary."""
    return areas(spark, sf_dir).filter("poly_id % 2 = 0")
