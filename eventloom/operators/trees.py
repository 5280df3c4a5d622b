"""Boosted trees grown from histograms of gradients (M6).

Values are binned once, by quantile edges of each feature. A tree grows level by level: one aggregation adds gradients and
curvatures by open node, feature and bin, combined before the shuffle; what reaches the driver is at most
nodes x features x bins rows, whatever the number of rows of the table. Missing values have a bin of their own and go to the
side that gains more. After each tree the rows' margins are written anew to the shared folder, next to their bins, so that
plans stay short and a lost task costs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch


@dataclass
class Split:
    """Rows whose bin of the feature is at most `upto`, or missing ones where `missing_left`, go left."""

    feature: int
    upto: int
    missing_left: bool
    left: Split | float = 0.0
    right: Split | float = 0.0


@dataclass
class Trees:
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list = field(default_factory=list)

    def _tree(self, node, at) -> Column:
        """A tree as an expression; at: a feature's bin number, 0 where missing."""
        if not isinstance(node, Split):
            return F.lit(float(node))
        b = at(node.feature)
        return F.when(F.when(b == 0, F.lit(node.missing_left)).otherwise(b <= node.upto), self._tree(node.left, at)).otherwise(self._tree(node.right, at))

    def margin(self) -> Column:
        """The sum over all trees, of the features' own columns."""
        bins = [bin_of(F.col(f), e) for f, e in zip(self.features, self.edges)]
        return reduce(lambda a, t: a + self._tree(t, bins.__getitem__), self.trees, F.lit(self.base))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def bin_of(value: Column, edges: list[float]) -> Column:
    """0 where missing (null or NaN), else one more than how many edges are below the value."""
    x = value.cast("double")
    above = reduce(lambda a, e: a + F.when(x > e, 1).otherwise(0), edges, F.lit(1))
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(above).cast("int")


def quantile_edges(df: DataFrame, features: list[str], bins: int, accuracy: int = 100_000) -> list[list[float]]:
    """Distinct inner quantiles of each feature; one aggregation, features x bins numbers."""
    shares = [n / bins for n in range(1, bins)]
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    row = df.agg(*[F.percentile_approx(c, shares, accuracy) for c in clean]).first()
    return [sorted(set(r or [])) for r in row]


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least: int) -> tuple[float, int, int, bool] | None:
    """Gain, feature, last left bin and side of missing values, of histograms (feature, bin); bin 0 is missing.

    Of equal gains (to nine digits) the first by feature, bin and missing values on the left.
    """
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + ridge)
    best = None
    for feature in range(len(g)):
        for upto in range(1, g.shape[1] - 1):
            for missing_left in (True, False):
                first = 0 if missing_left else 1
                if not missing_left and n[feature, 0] == 0:
                    continue
                left_g, left_h, left_n = (x[feature, first : upto + 1].sum() for x in (g, h, n))
                if min(left_n, n[feature].sum() - left_n) < least:
                    continue
                gain = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, feature, upto, missing_left
    return best


def fit_trees(
    df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, ridge: float = 1.0, least: int = 20, weight: str | None = None, edges: list[list[float]] | None = None
) -> Trees:
    """Trees for a label of 0 and 1 by Newton's steps on the logistic loss; rows without a label take no part.

    least: the fewest rows of a leaf. Without rows, or with one label only, there is no tree but a smoothed base rate.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull())
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    n, positive = rows.agg(F.coalesce(F.sum(own), F.lit(0.0)), F.coalesce(F.sum(own * F.col(label)), F.lit(0.0))).first()
    model = Trees(features, edges or quantile_edges(rows, features, bins), float(np.log((positive + 0.5) / (n - positive + 0.5))))
    if not n or positive in (0, n):
        return model
    width = 2 + max(map(len, model.edges), default=0)
    binned = rows.select(F.array(*[bin_of(F.col(f), e) for f, e in zip(features, model.edges)]).alias("b"), F.col(label).cast("double").alias("y"), own.alias("w"), F.lit(model.base).alias("m"))
    at = lambda i: F.get("b", F.lit(i))
    for _ in range(trees):
        path = scratch(spark, "margins")
        binned.write.parquet(path)
        binned = spark.read.schema("b array<int>, y double, w double, m double").parquet(path)
        p = 1 / (1 + F.exp(-F.col("m")))
        sums = binned.select("b", (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        open_nodes: dict[int, tuple[Split | None, str]] = {1: (None, "")}  # number: where the node hangs; a node's children are 2n and 2n + 1
        root: Split | float = 0.0
        places: dict[int, Split] = {}
        for level in range(depth + 1):
            number = F.lit(1)
            for k in sorted(places):  # from the root down: each split sends its rows on
                s = places[k]
                left = F.when(at(s.feature) == 0, F.lit(s.missing_left)).otherwise(at(s.feature) <= s.upto)
                number = F.when(number == k, F.when(left, 2 * k).otherwise(2 * k + 1)).otherwise(number)
            here = sums.withColumn("node", number).where(F.col("node").isin(*open_nodes))
            each = here.select("node", "g", "h", F.posexplode("b").alias("feature", "bin"))
            found = each.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.count(F.lit(1))).collect()  # nodes x features x bins at most
            grids = {k: np.zeros((3, len(features), width)) for k in open_nodes}
            for node, feature, b, g, h, count in found:
                grids[node][:, feature, b] = g, h, count
            following: dict[int, tuple[Split | None, str]] = {}
            for k, (parent, side) in open_nodes.items():
                g, h, count = grids[k]
                split = best_split(g, h, count, ridge, least) if level < depth else None
                if split:
                    child: Split | float = Split(*split[1:])
                    places[k] = child
                    following[2 * k], following[2 * k + 1] = (child, "left"), (child, "right")
                else:
                    child = float(rate * g[0].sum() / (h[0].sum() + ridge))
                if parent is None:
                    root = child
                else:
                    setattr(parent, side, child)
            open_nodes = following
            if not open_nodes:
                break
        model.trees.append(root)
        binned = binned.withColumn("m", F.col("m") + model._tree(root, at))
    return model
