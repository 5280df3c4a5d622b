"""Exact centroid clustering with Yinyang grouping.

Lloyd's rounds over whole numbers, without most of their distances. The centroids are put into groups once. A vector's
row holds its cluster, an upper bound of the distance to its centroid and, for each group, a lower bound of the distance
to every other centroid in it. When centroids move, the upper bound grows by its centroid's drift and a group's lower bound
falls by the group's largest drift. Then:

1. Globally: a vector whose upper bound is below all lower bounds keeps its cluster; one distance may tighten the bound.
2. By group: only groups whose lower bound the upper bound reaches are opened, and in them only centroids that their own
   drift could have brought near enough. These are scanned exactly, in integers; ties go to the smaller number.

Bounds are doubles, widened for rounding, and are only believed where they differ strictly, so that clusters, ties included,
are those of the plain rounds. Each round is one pass that writes the rows with their new bounds to the shared folder, and
with them the task's sums of the vectors that moved (all of them in the first round): centroids follow from running sums,
of which k rows reach the driver a round. Recovery from a lost executor repeats tasks of one round only.

Rows: vectors of another length than `dim`, null ones and those that hold null or non-finite components take no part. Rows
without an id take part, but are chosen as a first centroid last. Rows repeated under one id are rows each; for the first
centroids the least vector of an id stands first. With fewer than k rows there are as many centroids as rows. An empty table
gives an empty table. Other columns are not read. Components are bounded (vectors.MOST_WHOLE), beyond it is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import finite, whole_matrix, whole_numbers

#: Relative room for rounding in bounds.
ROOM = 1e-9
FAR = np.int64(2**62)


def groups_of(centroids: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """The group of each centroid: a few plain rounds over the centroids themselves, from centres far apart."""
    c = centroids.astype(float)
    picked, near = [0], ((c - c[0]) ** 2).sum(1)
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((c - c[picked[-1]]) ** 2).sum(1))
    centres = c[picked]
    for _ in range(rounds):
        which = ((c[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([c[which == g].mean(0) if (which == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(which, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def least_by_group(far: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.stack([far[:, group == g].min(1) for g in range(group.max() + 1)], 1) if len(far) else np.zeros((0, group.max() + 1))


def first_assignment(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by a full scan."""
    d = np.stack([squared(x, c) for c in centroids], 1)
    cluster, at = d.argmin(1), np.arange(len(x))
    far = np.sqrt(d) * (1 - ROOM)
    far[at, cluster] = np.inf
    return cluster, np.sqrt(d[at, cluster]) * (1 + ROOM), least_by_group(far, group)


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids moved from old to new, and how many distances were computed."""
    drift = np.sqrt(squared(new, old)) * (1 + ROOM)
    most = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    before = lower
    cluster, upper, lower = cluster.copy(), (upper + drift[cluster]) * (1 + ROOM), lower - most - ROOM * np.abs(np.where(np.isinf(lower), 0, lower))
    work = np.flatnonzero(upper >= lower.min(1))
    own = squared(x[work], new[cluster[work]])
    computed = len(work)
    upper[work] = np.sqrt(own) * (1 + ROOM)
    still = upper[work] >= lower[work].min(1)
    work, own = work[still], own[still]
    if not len(work):
        return cluster, upper, lower, computed
    at, mine, reach = np.arange(len(work)), cluster[work], upper[work][:, None]
    bound = np.maximum(lower[work][:, group], before[work][:, group] * (1 - ROOM) - drift)
    scan = (lower[work][:, group] <= reach) & (bound <= reach)
    scan[at, mine] = False
    d = np.full(scan.shape, FAR)
    d[at, mine] = own
    for j in range(len(new)):
        rows = np.flatnonzero(scan[:, j])
        d[rows, j] = squared(x[work[rows]], new[j])
        computed += len(rows)
    best = d.argmin(1)  # the first of equal ones
    far = np.where(d < FAR, np.sqrt(d) * (1 - ROOM), bound)
    far[at, best] = np.inf
    cluster[work], upper[work], lower[work] = best, np.sqrt(d[at, best]) * (1 + ROOM), least_by_group(far, group)
    return cluster, upper, lower, computed


def yinyang_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    groups: how many groups of centroids; a tenth of k, but two at least. seed: goes into the hash that chooses the first centroids.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")) & (F.size("v") == dim))
    rows = materialize(own.select("vec_id", whole_numbers(F.col("v"), scale).alias("v")), "whole-vectors")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(by_hash.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    if not first:
        return spark.createDataFrame([], kinds)
    centroids = np.array([r[0] for r in first], np.int64)
    group = groups_of(centroids, min(len(centroids), groups or max(2, k // 10)))
    many = len(centroids)
    fields = ["vec_id", "v", "cluster", "upper", "lower", "changed", "n", "sums"]
    schema = "vec_id long, v array<long>, cluster int, upper double, lower array<double>, changed int, n long, sums array<long>"

    def assign(old: np.ndarray | None, new: np.ndarray):
        """A pass: rows with their bounds, and at its end a row for each cluster with the task's sums of what came and went."""

        def run(batches):
            sums, n = np.zeros((many, dim), np.int64), np.zeros(many, np.int64)
            for batch in batches:
                size, x = len(batch), whole_matrix(batch.column(1), dim)
                if not size:
                    continue
                if old is None:
                    cluster, upper, lower = first_assignment(x, new, group)
                    moved = np.arange(size)
                else:
                    was = batch.column(2).to_numpy()
                    lower = batch.column(4).flatten().to_numpy().reshape(size, -1)
                    cluster, upper, lower, _ = reassigned(x, was, batch.column(3).to_numpy(), lower, old, new, group)
                    moved = np.flatnonzero(cluster != was)
                    np.subtract.at(sums, was[moved], x[moved])
                    n -= np.bincount(was[moved], minlength=many)
                np.add.at(sums, cluster[moved], x[moved])
                n += np.bincount(cluster[moved], minlength=many)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * lower.shape[1], pa.int32()), pa.array(np.ascontiguousarray(lower).ravel()))
                none = [pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), listed, *none], names=fields)
            some = np.flatnonzero(n | sums.any(1))
            if len(some):
                empty = [pa.nulls(len(some), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=fields)

        return run

    sums, n, state, old = [[0] * dim for _ in range(many)], [0] * many, rows, None
    for _ in range(rounds):
        held, state = state, materialize(state.mapInArrow(assign(old, centroids), schema), "bounds")
        discard(held)
        changes = state.where("changed IS NOT NULL").groupBy("changed").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(dim)])
        for j, more, *parts in changes.collect():  # a row a cluster
            n[j] += more
            sums[j] = [a + int(b) for a, b in zip(sums[j], parts)]
        old = centroids
        centroids = np.array([[s // n[j] for s in sums[j]] if n[j] else old[j] for j in range(many)], np.int64)
        state = state.where("changed IS NULL")
    final = centroids

    def measure(batches):
        for batch in batches:
            size, x = len(batch), whole_matrix(batch.column(1), dim)
            if not size:
                continue
            if old is None:
                cluster = first_assignment(x, final, group)[0]
            else:
                cluster = reassigned(x, batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy().reshape(size, -1), old, final, group)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(squared(x, final[cluster]))], names=["vec_id", "cluster", "distance"])

    done = materialize(state.mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r[0]: int(r[1]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return done.select(
        "vec_id", "cluster", "distance", of([inertia.get(j, 0) for j in range(many)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"),
    )
