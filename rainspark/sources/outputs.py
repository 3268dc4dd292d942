"""Outputs that grow: only the partitions that are not there yet are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rainspark.session import materialise
from rainspark.sources.rasters import new_only


def written_keys(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The partitions a folder holds, without reading a column; none if there is no folder yet."""
    kinds = T.StructType([schema[k] for k in keys])
    try:
        stored = spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)
    return stored.select(*keys).distinct()


def write_missing(table: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Writes the rows of `table` whose `keys` have no partition yet, and returns the keys written.

    Rows are dealt by ranges of (keys, order), so a partition that holds most rows is spread over many tasks and a
    task writes at most one file for each partition it meets: no more files than tasks and partitions together.
    A partition becomes visible as a whole when the job commits, so a run that ended early is repeated by
    running it again, and one that has nothing to add writes nothing. Rows whose key is NULL have a
    partition of their own; empty text is stored as NULL there, as folder names cannot tell them apart.
    """
    spark = table.sparkSession
    texts = [k for k in keys if isinstance(table.schema[k].dataType, T.StringType)]
    table = table.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in texts}) if texts else table
    done = written_keys(spark, path, table.schema, keys, fmt)
    # NULL keys must meet their partition, too
    pairs = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    lacking = table.alias("a").join(done.alias("b"), pairs, "left_anti")
    # the ranges are sampled before they are written, so the rows are computed once and kept
    todo = materialise(lacking, "missing")
    if not todo.isEmpty():
        ranged = todo.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        writer = ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return todo.select(*keys).distinct()


def still_to_write(wanted: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Wanted partitions that the folder does not hold."""
    return new_only(wanted, written_keys(wanted.sparkSession, path, schema, keys, fmt), list(keys))
