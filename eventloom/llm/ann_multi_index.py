"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised on its own to one of CENTROIDS, of more where there are more rows (k-means on a
bounded sample by id, FIT_ROWS, so that copies count in it as often as they are); a
pair of them is a cell, and every row is listed in its cell. A query walks the pairs of centroids by summed
nearness through a heap, until the cells read hold the share of rows that gave the wanted recall on the sample,
and all entries of those cells are reranked by the exact inner product in double precision.

Cells are packed, in order, to blocks of about BLOCK rows; a cell beyond that is dealt to several blocks, so no
task holds a hot cell whole. Vectors that are null, zero, hold null or non-finite components or have no id take no part. Queries
repeated under one id count once (the least vector); other rows are candidates each, but for rows that carry the
query's own id. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, every_twentieth, finite, matrix, merge_best

FIT_ROWS, CENTROIDS, MOST_CENTROIDS, BLOCK = 16_384, 64, 256, 8_192
RECALL = 0.95


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        which = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, which, x)
        n = np.bincount(which, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * x @ centres.T - (centres**2).sum(1)).argmax(1)


class MultiIndex:
    """The two codebooks; cells are numbered first * len(second book) + second."""

    def __init__(self, sample: np.ndarray, k: int, centroids: int = CENTROIDS, recall: float = RECALL):
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [k_means(half, centroids) for half in (sample[:, : self.cut], sample[:, self.cut :])] if len(sample) else []
        self.cells = len(self.books[0]) * len(self.books[1]) if self.books else 0
        self.share = self.calibrate(sample, k, recall) if self.books else 1.0

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.cut], self.books[0]) * len(self.books[1]) + nearest(x[:, self.cut :], self.books[1])

    def walk(self, query: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
        """Cells by summed nearness of their two centroids, until they hold `wanted` rows."""
        a, b = self.books[0] @ query[: self.cut], self.books[1] @ query[self.cut :]
        order_a, order_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b, wide = a[order_a].tolist(), b[order_b].tolist(), len(order_b)
        heap, out, held = [(-(a[0] + b[0]), 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = order_a[i] * wide + order_b[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if j + 1 < wide:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float) -> float:
        """The least share of rows, read in walking order, that finds `recall` of the sample's true neighbours."""
        cells = self.cell(sample)
        counts = np.bincount(cells, minlength=self.cells).tolist()
        asked = np.unique(np.linspace(0, len(sample) - 1, 200).astype(int))
        needed = []
        for q in asked:
            s = sample @ sample[q]
            s[q] = -np.inf
            best = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
            order = self.walk(sample[q], counts, float("inf"))
            held = dict(zip(order, np.cumsum([counts[c] for c in order])))
            needed += [held[c] / len(sample) for c in cells[best].tolist()]
        return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def approximate_top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", is_query=every_twentieth, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and exact score of each query's k nearest found."""
    import pyarrow as pa

    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT_ROWS).toArrow()  # FIT_ROWS rows at most
    dim = max([1, *sample["v"].combine_chunks().value_lengths().to_pylist()]) if len(sample) else 1
    longest, rows = own.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.count(F.lit(1))).first()
    dim = max(dim, longest, 2)
    centroids = min(MOST_CENTROIDS, max(CENTROIDS, math.isqrt(rows // CENTROIDS)))  # cells grow with the rows
    index = MultiIndex(matrix(sample["v"], dim), k, centroids, recall) if len(sample) else None
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)

    def list_rows(batches):
        for batch in batches:
            cells = shared.value.cell(matrix(batch.column(1), dim)) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int32())], names=["vec_id", "v", "cell"])

    listed = own.mapInArrow(list_rows, "vec_id long, v array<double>, cell int")
    counts = [0] * index.cells
    for r in listed.groupBy("cell").count().collect():  # at most centroids squared rows
        counts[r[0]] = r[1]
    # Cells in order are packed to blocks; one beyond BLOCK rows is dealt to `parts` blocks of its own.
    first, parts, block, held = [0] * index.cells, [1] * index.cells, 0, 0
    for c, n in enumerate(counts):
        if n > BLOCK:
            block += held > 0
            first[c], parts[c] = block, -(-n // BLOCK)
            block, held = block + parts[c], 0
        else:
            if held + n > BLOCK:
                block, held = block + 1, 0
            first[c], held = block, held + n
    total, layout = sum(counts), spark.sparkContext.broadcast((counts, first, parts))
    wanted = max(index.share * total, k + 1)

    def route(batches):
        own_counts, own_first, own_parts = layout.value
        for batch in batches:
            ids, blocks, cells, at = [], [], [], []
            x = matrix(batch.column(1), dim)
            for n, query in enumerate(x):
                by_block: dict[int, list[int]] = {}
                for c in shared.value.walk(query, own_counts, wanted):
                    for b in range(own_first[c], own_first[c] + own_parts[c]):
                        by_block.setdefault(b, []).append(c)
                for b, own_cells in by_block.items():
                    at.append(n)
                    blocks.append(b)
                    cells.append(own_cells)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(blocks, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "v", "block", "cells"])

    def place(batches):
        _, own_first, own_parts = layout.value
        base, many = np.array(own_first), np.array(own_parts)
        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy()
            blocks = base[cells] + ((ids * 2654435761) >> 7) % many[cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int32())], names=["vec_id", "v", "cell", "block"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(left) and len(right):
            ids, cell = right["vec_id"].to_numpy(), right["cell"].to_numpy()
            data = matrix(right["v"], dim)
            names, place_of = np.unique(cell, return_inverse=True)
            query_ids, read = left["vec_id"].to_numpy(), left["cells"].to_pylist()
            asked = matrix(left["v"], dim)
            for start in range(0, len(asked), 256):
                some = slice(start, start + 256)
                s = asked[some] @ data.T
                for n, q in enumerate(query_ids[some]):
                    row = np.where(np.isin(names, read[start + n])[place_of] & (ids != q), s[n], -np.inf)
                    best = best_of(row, ids, k)
                    out_q.append(np.full(len(best), q))
                    out_v.append(ids[best])
                    out_s.append(np.array([float(data[b] @ asked[start + n]) for b in best]))
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": join(out_q, pa.int64()), "vec_id": join(out_v, pa.int64()), "score": join(out_s, pa.float64())})

    asked = own.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    left = asked.mapInArrow(route, "vec_id long, v array<double>, block int, cells array<int>")
    right = listed.mapInArrow(place, "vec_id long, v array<double>, cell int, block int")
    parts_found = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    return merge_best(parts_found, k)
