"""Logistic models fitted by sums over rows, walked forward over folds, and kept as sealed artifacts."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


def _linear(weights: np.ndarray, features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for w, f in zip(weights[1:], features)], F.lit(float(weights[0])))


def fit_logistic(df: DataFrame, features: list[str], label: str, ridge: float = 1.0, rounds: int = 12, weight: str | None = None) -> np.ndarray:
    """Intercept and weights by Newton's steps: each is one aggregation of (k + 1)(k + 4) / 2 sums, solved on the driver.

    The intercept isn't penalized; null features count as 0. Without rows, or with one label only, the answer is a
    smoothed base rate.
    """
    df = kept(df.select(*dict.fromkeys([*features, label, *([weight] if weight else [])])), "model-rows")  # features are worked out once, not in each step
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    size, own = len(x), F.col(weight) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    n, positive = df.agg(F.coalesce(F.sum(own), F.lit(0.0)), F.coalesce(F.sum(own * y), F.lit(0.0))).first()
    w = np.zeros(size)
    w[0] = np.log((positive + 0.5) / (n - positive + 0.5))
    if not n or positive in (0, n):
        return w
    penalty = np.diag([0.0] + [ridge] * (size - 1))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_linear(w, features)))
        slope = [F.sum(own * (y - p) * v) for v in x]
        bend = [F.sum(own * p * (1 - p) * x[i] * x[j]) for i in range(size) for j in range(i + 1)]
        sums = np.array(df.agg(*slope, *bend).first(), dtype=float)
        hessian = np.zeros((size, size))
        hessian[np.tril_indices(size)] = sums[size:]
        hessian = hessian + np.tril(hessian, -1).T + penalty
        step = np.linalg.solve(hessian + 1e-9 * np.eye(size), sums[:size] - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def score_logistic(df: DataFrame, weights: np.ndarray, features: list[str], out: str = "p") -> DataFrame:
    return df.withColumn(out, 1 / (1 + F.exp(-_linear(weights, features))))


def walk_forward(df: DataFrame, time: str, known: str, edges: list, models: dict[str, list[str]], label: str) -> DataFrame:
    """M5: rows of each fold scored by each model, fitted on labels that were known before the fold begins.

    edges: the folds' beginnings, and the end of the last. A row whose label came later than a fold's beginning is no
    part of its training (purged), whatever its own time.
    """
    out = []
    for begin, end in zip(edges[:-1], edges[1:]):
        past = df.where((F.col(known) < F.lit(begin)) & F.col(label).isNotNull()).cache()
        now = df.where((F.col(time) >= F.lit(begin)) & (F.col(time) < F.lit(end)))
        for name, features in models.items():
            scored = score_logistic(now, fit_logistic(past, features, label), features)
            out.append(scored.withColumns({"fold": F.lit(begin), "model": F.lit(name)}))
        past.unpersist()
    return reduce(DataFrame.unionByName, out)


SCHEMA = "linear-model/1"


def seal(model: dict) -> str:
    """A model as JSON with the sha256 of its payload."""
    payload = json.dumps(model, sort_keys=True, separators=(",", ":"))
    return json.dumps({"schema": SCHEMA, "sha256": hashlib.sha256(payload.encode()).hexdigest(), "payload": model}, sort_keys=True)


def unseal(text: str, features: list[str] | None = None) -> dict:
    """The model of an artifact; ValueError where schema, digest, keys, numbers or the feature list aren't as declared."""
    raw = json.loads(text)
    if set(raw) != {"schema", "sha256", "payload"} or raw["schema"] != SCHEMA:
        raise ValueError("not an artifact of this schema")
    model = raw["payload"]
    if json.loads(seal(model))["sha256"] != raw["sha256"]:
        raise ValueError("the payload does not match its digest")
    if set(model) != {"features", "weights", "trained_through"} or len(model["weights"]) != len(model["features"]) + 1 or not np.isfinite(model["weights"]).all():
        raise ValueError("the payload is no linear model")
    if features is not None and model["features"] != features:
        raise ValueError("the features differ")
    return model


def check_partitions(df: DataFrame, part: str, key: str, time: str) -> DataFrame:
    """What keeps a fit from being clean: keys in several partitions, and partitions that begin before the one they follow ends.

    Partitions are named in their order of time.
    """
    shared = df.groupBy(key).agg(F.count_distinct(part).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("shared_keys").alias("check"), "violations")
    spans = df.groupBy(part).agg(F.min(time).alias("a"), F.max(time).alias("b"))  # one row a partition
    both = spans.alias("x").join(spans.alias("y"), F.col(f"x.{part}") < F.col(f"y.{part}"))
    order = both.where("y.a <= x.b").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("time_order").alias("check"), "violations")
    return shared.unionByName(order)
