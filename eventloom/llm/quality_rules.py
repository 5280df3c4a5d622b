"""Document quality by a sparse ensemble of rules.

Statistics of the whole text are Spark columns. Small trees are grown on a bounded sample of labelled rows
(FIT_ROWS); each path from a root is a conjunctive rule; a logistic model with a lasso penalty keeps few of
them; and the rules left are compiled to one Spark column expression, so scoring runs inside the JVM.

Nulls: a null text counts as empty, and an empty text is scored like any other. With no labelled row, or
labels of one kind only, the score is the smoothed share of label 1. Empty tables give empty tables. A repeated row gets
its score each time; an id with several texts or labels teaches with each pair of them. Ties don't arise: a score
depends on the text alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

FIT_ROWS = 20_000
TREES, DEPTH, LEAF = 60, 3, 8
PENALTY = 0.0015


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts; all finite for the empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    words = F.split(t, r"\s+")
    lines = F.split(t, "\n")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "chars": F.char_length(t).cast("double"),
        "upper": count("[A-ZÀ-Þ]") / n,
        "symbols": count("[#$%&*@~^_=+<>{}\\\\]") / n,
        "marks": count("[!?]") / n,
        "bars": count("[|]") / n,
        "digits": count("[0-9]") / n,
        "stops": count("[.,;:]") / n,
        "word_chars": n / F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double") / F.size(words).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines).cast("double"),
        "line_chars": n / F.size(lines).cast("double"),
    }


def grow(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rng: np.random.Generator, depth: int, path: tuple) -> list[tuple]:
    """The rules of one tree: each a tuple of (feature, is_greater, threshold)."""
    if depth == 0 or len(y) < 2 * LEAF or y.var() < 1e-9:
        return []
    best = None
    for f in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        if not len(edges[f]):
            continue
        order = np.argsort(x[:, f], kind="stable")
        total = np.concatenate([[0.0], np.cumsum(y[order])])
        at = np.searchsorted(x[order, f], edges[f], side="right")
        good = (at >= LEAF) & (at <= len(y) - LEAF)
        if not good.any():
            continue
        at, cut = at[good], edges[f][good]
        left, right = total[at], total[-1] - total[at]
        gain = left**2 / at + right**2 / (len(y) - at)
        n = int(gain.argmax())
        if best is None or gain[n] > best[0]:
            best = (gain[n], int(f), float(cut[n]))
    if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-12:
        return []
    _, f, cut = best
    out = []
    for greater in (False, True):
        own = x[:, f] > cut if greater else x[:, f] <= cut
        rule = path + ((f, greater, cut),)
        out += [rule, *grow(x[own], y[own], edges, rng, depth - 1, rule)]
    return out


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    return reduce(np.logical_and, [x[:, f] > cut if greater else x[:, f] <= cut for f, greater, cut in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; classes weigh alike in the loss by half."""
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    own = 0.5 * share + 0.5
    own /= own.sum()
    step = 4.0 / (np.sqrt((own[:, None] * z * z).sum(0)).sum() ** 2 / max(1, z.shape[1]) + 1 + np.linalg.norm(np.sqrt(own)[:, None] * z, 2) ** 2)
    w, b = np.zeros(z.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        gap = own * (1 / (1 + np.exp(-(z @ v + c))) - y)
        new = v - step * (z.T @ gap)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * gap.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, penalty: float = PENALTY, seed: int = 7) -> tuple[list[tuple[tuple, float]], float]:
    """(rule, weight) pairs and the intercept."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    if len(y) < 4 * LEAF or y.min() == y.max():
        return [], base
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.005, 0.995, 100), method="inverted_cdf")) for f in range(x.shape[1])]
    found: dict[bytes, tuple] = {}
    minor, major = np.flatnonzero(y == (y.mean() < 0.5)), np.flatnonzero(y != (y.mean() < 0.5))
    for _ in range(trees):  # a tree sees the rarer label and as many others twice over, so paths to it are found
        pick = np.concatenate([rng.choice(minor, len(minor)), rng.choice(major, min(len(major), max(2 * len(minor), 200)))])
        for rule in grow(x[pick], y[pick].astype(float), edges, rng, DEPTH, ()):
            own = holds(x, rule)
            if 0 < own.sum() < len(y):
                found.setdefault(np.packbits(own).tobytes(), rule)
    rules = sorted(found.values())
    z = np.stack([holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    w, b = lasso_logistic(z, y.astype(float), penalty)
    return [(r, float(v)) for r, v in zip(rules, w) if v], float(b)


def compile_rules(rules: list[tuple[tuple, float]], intercept: float, names: list[str]) -> Column:
    """The ensemble as a probability column over columns of these names."""
    total = F.lit(intercept)
    for rule, weight in rules:
        true = reduce(lambda a, b: a & b, [F.col(names[f]) > cut if greater else F.col(names[f]) <= cut for f, greater, cut in rule])
        total = total + F.when(true, weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality_scores(
    docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; labels of training_docs (docs by default) teach."""
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    own = own.where(F.col("__y").isin(0, 1) & ~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__y").limit(fit_rows)
    source = (training_docs if training_docs is not None else docs).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    stats = statistics(F.col("__t"))
    seen = source.join(F.broadcast(own), "__id").select(F.xxhash64("__id").alias("__h"), "__y", *[c.alias(n) for n, c in stats.items()])
    seen = seen.orderBy("__h", "__y", *stats).drop("__h").limit(fit_rows)  # ids may be repeated: at most fit_rows rows only now
    rows = np.array([tuple(r) for r in seen.collect()], dtype=float).reshape(-1, 1 + len(stats))
    rows = rows[np.lexsort(rows.T[::-1])]
    rules, intercept = fit_rules(rows[:, 1:], rows[:, 0].astype(int))
    used = {f for rule, _ in rules for f, _, _ in rule}
    names = list(stats)
    measured = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        *[statistics(F.col(text_col).cast("string"))[n].alias(f"__{n}") for k, n in enumerate(names) if k in used],
    )
    score = compile_rules(rules, intercept, [f"__{n}" for n in names])
    return measured.select("doc_id", "held_out", score.alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
