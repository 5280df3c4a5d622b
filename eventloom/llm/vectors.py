"""What both vector searches share: which rows take part, Arrow to NumPy, and merging best lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold neither nulls nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as rows of doubles; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    at = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, within] = flat
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, best first, ties to the smaller id; -inf never counts."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero((scores >= kth) & (scores > -np.inf))
    else:
        pick = np.flatnonzero(scores > -np.inf)
    return pick[np.lexsort([ids[pick], -scores[pick]])[:k]]


def merge_best(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each query's partial lists (k from each block at most), ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_twentieth(vec_id: Column) -> Column:
    """The stated query set."""
    return F.coalesce(vec_id % 20 == 0, F.lit(False))


#: Whole-number components beyond this would let exact squared distances of long vectors leave 64 bits.
MOST_WHOLE = 2**27


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each double component as longs; an error, not a wrong number, beyond MOST_WHOLE."""
    one = lambda x: F.when(F.abs(scale * x) < MOST_WHOLE, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is too large for exact sums: {MOST_WHOLE} / {scale} at most")).cast("long"))
    return F.transform(vector.cast("array<double>"), one)


def whole_matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of longs, all of `dim` or fewer, as rows; shorter ones are padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == dim * len(column):
        return flat.reshape(-1, dim)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
