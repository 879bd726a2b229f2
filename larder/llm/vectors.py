"""What both vector searches share: clean vectors with one row per id, and merging of per-block results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id (long) and v (array of doubles): rows whose id, vector and components are all present and finite.

    An id that repeats keeps one vector, the smallest in order of components.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; short ones are filled with zeros."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best_of(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows, ties to the smaller vec_id."""
    score = "score" if ascending else "-score"
    ranked = found.withColumn("rank", F.expr(f"row_number() over (partition by query_id order by {score}, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
