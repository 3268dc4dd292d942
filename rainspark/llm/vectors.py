"""Integer vectors from a table of embeddings, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def integers(df: DataFrame, scale: int, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """The kept columns and `v`, the vector as floor(scale * x) of each component x as a double.

    Vectors that are null or hold a null or non-finite component are left out. Integers beyond a long
    are held at its ends.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("v")).where("v is not null").where(~bad)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of longs as rows of doubles; shorter lists end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = rows.shape
    offsets = pa.array((np.arange(n + 1) * width).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1), kind))
