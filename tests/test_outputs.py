"""Incremental outputs and the parameter store."""

import datetime
import glob

from pyspark.sql import functions as F

from checks import tables as t
from rainspark.grid import Grid
from rainspark.operators.raster import sample_raster
from rainspark.sources import outputs, parameter_store

GRID = Grid(0.0, 40.0, 1.0, 1.0, 40, 40)


def files(path):
    return sorted(glob.glob(f"{path}/**/part-*", recursive=True))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_missing_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), (None, 1, 7.0)], "k string, y int, v double")
    more = spark.createDataFrame([("a", 1, 99.0), ("b", 1, 1.0), ("b", 1, 1.0), (None, 1, 98.0), ("", 1, 97.0), ("a", None, 3.0)], first.schema)
    assert rows_of(outputs.write_missing(first, path, ["k", "y"])) == rows_of(first.select("k", "y"))
    kept = files(path)
    added = outputs.write_missing(more, path, ["k", "y"])
    assert rows_of(added) == sorted([("b", 1), ("a", None)], key=str) and set(kept) < set(files(path))
    both = files(path)
    assert outputs.write_missing(first.union(more), path, ["k", "y"]).count() == 0 and files(path) == both
    got = spark.read.schema(first.schema).parquet(path)
    assert rows_of(got.select("k", "y", "v")) == sorted([("a", 1, 5.0), ("a", 2, 6.0), (None, 1, 7.0), ("b", 1, 1.0), ("b", 1, 1.0), ("a", None, 3.0)], key=str)
    wanted = spark.createDataFrame([("a", 1), ("c", 1)], "k string, y int")
    assert rows_of(outputs.still_to_write(wanted, path, first.schema, ["k", "y"])) == [("c", 1)]


def test_empty_tables_and_text_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("00000001", 1990, datetime.date(1990, 1, 2))], "code string, year int, date date")
    assert outputs.write_missing(rows.limit(0), path, ["year"], fmt="csv").count() == 0
    assert outputs.write_missing(rows, path, ["year"], fmt="csv").count() == 1
    assert outputs.write_missing(rows, path, ["year"], fmt="csv").count() == 0
    assert rows_of(spark.read.option("header", True).csv(path)) == [("00000001", "1990-01-02", 1990)]


def test_files_are_bounded_and_a_hot_partition_is_spread(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
        outputs.write_missing(rows, path, ["k"], ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks, keys = 8, rows.select("k").distinct().count()
    assert len(files(path)) <= tasks + keys and len(files(f"{path}/k=0")) >= tasks // 2


def parameters(spark):
    cells = spark.range(1600).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    return cells.withColumn("K", (F.col("row") * 100 + F.col("col")).cast("double")).withColumn("product", F.explode(F.array(F.lit("x"), F.lit("y"))))


def test_store_gives_what_the_table_gives(spark, tmp_path):
    path = str(tmp_path / "store")
    parameter_store.write_store(parameters(spark), path, 8)
    store = parameter_store.read_store(spark, path)
    assert len(glob.glob(f"{path}/*/*")) == 25
    points = spark.createDataFrame(
        [(1, 39.5, 0.5), (1, 39.5, 0.5), (2, 20.0, 20.0), (3, 0.1, 39.9), (4, 90.0, 0.0), (5, None, 3.0), (6, 3.0, -1.0)], "id int, lat double, lon double"
    )
    got = parameter_store.sample_store(points, store, GRID, ["K"], ["product"], 8)
    want = sample_raster(points, parameters(spark), GRID, ["K"], ["product"])
    columns = ["id", "lat", "lon", "row", "col", "product", "K"]
    assert rows_of(got.select(columns)) == rows_of(want.select(columns)) and got.count() == 11
    assert rows_of(parameter_store.sample_store(points.limit(0), store, GRID, ["K"], ["product"], 8)) == []


def test_points_read_their_tiles_only(spark, tmp_path):
    path = str(tmp_path / "store")
    parameter_store.write_store(parameters(spark), path, 8)
    points = spark.createDataFrame([(1, 39.5, 0.5), (2, 39.0, 1.0)], "id int, lat double, lon double")
    points.write.parquet(str(tmp_path / "points"))
    got = parameter_store.sample_store(spark.read.parquet(str(tmp_path / "points")), parameter_store.read_store(spark, path), GRID, ["K"], ["product"], 8)
    assert got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    # one pruning filter for each key of the folders
    assert plan.count("SubqueryAdaptiveBroadcast dynamicpruning") == 2
