"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the cover tree is shared: its centres are picked farthest first from a bounded sample, every vector
goes to the cell of its nearest centre, and each cell's covering radius is measured over all its rows. Queries are
grouped by the same cells. A query first searches its own cell, which gives each query group a worst kth score; pairs of
a query group and a cell whose closest corners, |q.c| + |q| rc + |c| rq + rq rc, stay below it never meet, and only the
rest is shuffled. A task indexes its queries and its data in cover trees (a node's children are centres far apart,
chosen farthest first until they cover it at half its radius; each node keeps its covering radius) and walks both trees
together under the same bound. Components are floor(64 x) of double x, products are whole numbers.

Vectors that are null, hold null or non-finite components or have no id take no part; shorter vectors count as padded with
zeros. Products are exact while the sum of their terms stays within 2^53. Queries
repeated under one id count once (the least vector); other rows are candidates each, but for rows
that carry the query's own id. Ties go to the smaller id. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import best_of, every_twentieth, finite, matrix, merge_best

DATA_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Rows of the sample that the cells' centres come from, rows a cell is meant for, and the most cells.
CELL_SAMPLE, CELL_ROWS, MOST_CELLS = 16_384, 8_192, 2_048
LEAF, FANOUT = 64, 16


class CoverTree:
    """Nodes in arrays: centre, covering radius, children; leaves own a slice of `order`."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centres, self.radius, self.children, self.slices = [], [], [], []
        self.order = np.arange(len(points))
        self.root = self.grow(0, len(points)) if len(points) else -1
        self.centres = np.array(self.centres).reshape(-1, points.shape[1])
        self.radius = np.array(self.radius)

    def grow(self, first: int, last: int) -> int:
        own = self.points[self.order[first:last]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        node, radius = len(self.radius), float(away.max())
        self.centres.append(centre)
        self.radius.append(radius * (1 + 1e-9))
        self.children.append([])
        self.slices.append((first, last))
        if last - first <= LEAF or radius == 0:
            return node
        # Centres farthest first: those chosen are farther apart than what they still leave uncovered.
        picked = [int(away.argmax())]
        near = np.sqrt(((own - own[picked[0]]) ** 2).sum(1))
        which = np.zeros(len(own), dtype=int)
        while len(picked) < FANOUT and near.max() > radius / 2:
            new = int(near.argmax())
            d = np.sqrt(((own - own[new]) ** 2).sum(1))
            which[d < near] = len(picked)
            near = np.minimum(near, d)
            picked.append(new)
        arranged = np.argsort(which, kind="stable")
        self.order[first:last] = self.order[first:last][arranged]
        at = first
        for n in np.bincount(which, minlength=len(picked)):
            if n == last - first:  # nothing was parted: equal or nearly equal points
                return node
            if n:
                self.children[node].append(self.grow(at, at + int(n)))
                at += int(n)
        return node


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best data rows of another id: (positions, scores), exact."""
    empty = (np.zeros(0, dtype=int), np.zeros(0))
    out = [empty] * len(queries)
    if not len(queries) or not len(data):
        return out
    qt, dt = CoverTree(queries), CoverTree(data)
    size = np.sqrt((dt.centres**2).sum(1))

    def look(q: np.ndarray, rows: np.ndarray) -> None:
        """Score some data rows against some queries and keep the best."""
        s = queries[q] @ data[rows].T
        s[query_ids[q][:, None] == ids[rows][None, :]] = -np.inf
        for n, query in enumerate(q):
            at, best = out[query]
            hit = np.flatnonzero(s[n] >= worst[query]) if len(best) >= k else np.arange(len(rows))
            if len(hit):
                at, best = np.concatenate([at, rows[hit]]), np.concatenate([best, s[n][hit]])
                keep = best_of(best, ids[at], k)
                out[query] = at[keep], best[keep]
                if len(keep) == k:
                    worst[query] = best[keep[-1]]

    def bounds(node: int, others: np.ndarray) -> np.ndarray:
        c, r = qt.centres[node], qt.radius[node]
        top = dt.centres[others] @ c + np.sqrt(c @ c) * dt.radius[others] + size[others] * r + r * dt.radius[others]
        return top + 1e-6 * (1 + np.abs(top))

    worst = np.full(len(queries), -np.inf)
    todo: list[tuple[int, np.ndarray]] = [(qt.root, np.array([dt.root]))]
    while todo:
        node, others = todo.pop()
        first, last = qt.slices[node]
        group = qt.order[first:last]
        least = worst[group].min()
        others = others[bounds(node, others) >= least]  # node pairs under the group's worst kth score go
        if qt.children[node]:
            below = [c for n in others for c in (dt.children[n] or [n])]
            todo += [(child, np.array(below, dtype=int)) for child in qt.children[node]]
            continue
        while len(inner := [n for n in others if dt.children[n]]):  # the query side is a leaf: open the data side
            flat = [n for n in others if not dt.children[n]] + [c for n in inner for c in dt.children[n]]
            others = np.array(flat, dtype=int)
            others = others[bounds(node, others) >= least]
        top = bounds(node, others)
        ranked = np.argsort(-top, kind="stable")
        at = 0
        while at < len(ranked) and top[ranked[at]] >= worst[group].min():
            take, rows = at, []
            while take < len(ranked) and sum(map(len, rows)) < 1024:
                a, b = dt.slices[others[ranked[take]]]
                rows.append(dt.order[a:b])
                take += 1
            look(group, np.concatenate(rows))
            at = take
    return out


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, farthest first."""
    picked = [0]
    near = ((points - points[0]) ** 2).sum(1)
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[picked[-1]]) ** 2).sum(1))
    return points[picked]


def exact_top_k(
    vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, is_query=every_twentieth, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """query_id, rank, vec_id and whole-number score of each query's k best rows."""
    import pyarrow as pa

    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    whole = whole.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    shape = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rows, dim = shape[0], max(1, shape[1])
    kinds = "query_id long, vec_id long, score long"
    if not rows:
        return merge_best(spark.createDataFrame([], kinds), k)
    sample = whole.orderBy(F.xxhash64("v", "vec_id")).select("v").limit(CELL_SAMPLE).toArrow()  # CELL_SAMPLE rows at most
    centres = far_apart(matrix(sample["v"], dim), max(1, min(MOST_CELLS, -(-rows // cell_rows))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        half = (shared.value**2).sum(1) / 2
        for batch in batches:
            x = matrix(batch.column(1), dim)
            cell = (x @ shared.value.T - half).argmax(1) if len(x) else np.zeros(0, int)
            away = np.sqrt(((x - shared.value[cell]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64())], names=["vec_id", "v", "cell", "away"])

    dealt = materialize(whole.mapInArrow(assign, "vec_id long, v array<double>, cell int, away double"), "cells")
    asked = dealt.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "away")).alias("q")).select("vec_id", "q.*")
    radius, parts, asked_radius, asked_parts = np.zeros(len(centres)), np.zeros(len(centres), int), np.zeros(len(centres)), np.zeros(len(centres), int)
    for table, far, many, size in ((dealt, radius, parts, DATA_BLOCK), (asked, asked_radius, asked_parts, QUERY_BLOCK)):
        for r in table.groupBy("cell").agg(F.max("away"), F.count(F.lit(1))).collect():  # MOST_CELLS rows at most
            far[r[0]], many[r[0]] = r[1], -(-r[2] // size)
    layout = spark.sparkContext.broadcast((radius, parts, asked_radius, asked_parts))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit([int(max(1, n)) for n in asked_parts]), F.col("cell") + 1)).cast("int"))
    data = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.element_at(F.lit([int(max(1, n)) for n in parts]), F.col("cell") + 1)).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        found = dual_search(matrix(left["v"], dim), query_ids, matrix(right["v"], dim), ids, k) if len(query_ids) and len(ids) else []
        sizes = [len(at) for at, _ in found]
        return pa.table({
            "query_id": pa.array(np.repeat(query_ids, sizes) if found else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([ids[at] for at, _ in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([s for _, s in found]).astype("int64") if found else [], pa.int64()),
        })

    def met(pairs: DataFrame) -> DataFrame:
        """What the queries of (cell, group) find in (other, part) of these pairs."""
        keys = ["cell", "group", "other", "part"]
        left = asked.join(pairs, ["cell", "group"]).select(*keys, "vec_id", "v").toDF(*keys, "vec_id", "v").groupBy(*keys)
        right = data.withColumnRenamed("cell", "other").join(pairs, ["other", "part"]).select(*keys, "vec_id", "v").toDF(*keys, "vec_id", "v").groupBy(*keys)
        return left.cogroup(right).applyInArrow(search, kinds)

    groups = spark.range(1).select(F.explode(F.lit([[c, g] for c, n in enumerate(asked_parts.tolist()) for g in range(n)] or [[-1, 0]])).alias("x")).select(F.col("x")[0].cast("int").alias("cell"), F.col("x")[1].cast("int").alias("group"))
    # A query's own cell first, or a part of it where it is large: any k scores are a bound.
    home = groups.where("cell >= 0").select("cell", "group", F.col("cell").alias("other"), F.lit(0).alias("part"))
    at_home = materialize(met(home), "at-home")
    kth = merge_best(at_home, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    worst = asked.select("vec_id", "cell", "group").join(kth, "vec_id", "left").groupBy("cell", "group").agg(F.min("kth").alias("kth"), F.count(F.lit(1)).alias("n"), F.count("kth").alias("known"))

    def open_cells(batches):
        far, many, asked_far, _ = layout.value
        size = np.sqrt((shared.value**2).sum(1))
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for cell, group, least, n, known in zip(*(c.to_pylist() for c in batch.columns)):
                c, r = shared.value[cell], asked_far[cell]
                top = shared.value @ c + np.sqrt(c @ c) * far + size * r + r * far
                top += 1e-6 * (1 + np.abs(top))
                hit = np.flatnonzero((many > 0) & ((top >= least) if known == n else True))
                out += [(cell, group, int(o), p) for o in hit for p in range(many[o]) if (o, p) != (cell, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int32()) for i in range(4)], names=["cell", "group", "other", "part"])

    pairs = materialize(worst.select("cell", "group", "kth", "n", "known").mapInArrow(open_cells, "cell int, group int, other int, part int"), "open-cells")
    return merge_best(at_home.unionByName(met(pairs)), k)
