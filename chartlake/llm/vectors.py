"""Helpers for searches over a table of vectors: cleaning, tiles of rows and queries, and ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (array of double) of usable rows: id and vector not null, no null or non-finite component.

    Rows that share an id are one vector, the least of them.
    """
    inf = float("inf")
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(ok, F.lit(False)))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def matrix(col, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat, off = np.asarray(col.flatten()), np.asarray(col.offsets)
    size = np.diff(off)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim).astype(kind)
    out = np.zeros((len(size), dim), kind)
    at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)
    out[at] = flat
    return out


def best_of(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best columns of each row of ``scores``, ties to the smaller id.

    ``ids`` ascend; excluded cells hold -inf (floats) or the least integer.
    """
    n = scores.shape[1]
    k = min(k, n)
    if not k or not len(query_ids):
        z = np.zeros(0, np.int64)
        return z, z, scores.reshape(-1)[:0]
    nothing = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    # every cell above the k-th score, then the first ones equal to it
    kth = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above = scores > kth
    equal = (scores == kth) & (scores != nothing)
    room = k - above.sum(1, keepdims=True)
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
    i, j = np.nonzero(chosen)
    return query_ids[i], ids[j], scores[i, j]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def spread(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n))
