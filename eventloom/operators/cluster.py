"""Order-dependent clustering of titled events, by blocks that clusters never leave.

Rows stream through a block in order of time; what is held is what the time window can still reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alike(a: set, b: set, least: float) -> bool:
    """Both sets have tokens, and share so much of the smaller one."""
    return bool(a and b) and len(a & b) >= least * min(len(a), len(b))


class Leaders:
    """K4, K5, K7: a row joins the first leader in the window that shares enough tokens, or leads."""

    def __init__(self, window_s: float, least: float):
        self.window_s, self.least, self.held = window_s, least, []

    def add(self, name, t: float, words: set, marks: set, weight: float) -> Iterator[tuple]:
        self.held = [x for x in self.held if t - x[1] <= self.window_s]
        hit = next((x[0] for x in self.held if alike(words, x[2], self.least)), None)
        if hit is None:
            self.held.append((name, t, words))
            hit = name
        yield name, hit

    def end(self) -> Iterator[tuple]:
        yield from ()


class Representatives(Leaders):
    """K1: a row joins the first group whose present representative it matches; a heavier row takes its place.

    The group keeps the name and time of its first row.
    """

    def add(self, name, t: float, words: set, marks: set, weight: float) -> Iterator[tuple]:
        self.held = [x for x in self.held if t - x[1] <= self.window_s]
        n = next((n for n, x in enumerate(self.held) if alike(words, x[2], self.least)), None)
        if n is None:
            self.held.append((name, t, words, weight))
            yield name, name
        else:
            first = self.held[n]
            if weight > first[3]:
                self.held[n] = (first[0], first[1], words, weight)
            yield name, first[0]


class Components:
    """K2: a row joins all groups it matches, unless two-sided marks conflict with any member of the merged group."""

    def __init__(self, window_s: float, least: float):
        self.window_s, self.least, self.groups = window_s, least, []

    def add(self, name, t: float, words: set, marks: set, weight: float) -> Iterator[tuple]:
        old = [g for g in self.groups if all(t - m[1] > self.window_s for m in g)]
        self.groups = [g for g in self.groups if not all(t - m[1] > self.window_s for m in g)]
        joined = [(name, t, words, marks)]
        match = lambda m: t - m[1] <= self.window_s and (words == m[2] or alike(words, m[2], self.least))
        fits = lambda a, b: not (a[3] - b[3] and b[3] - a[3])
        for g in list(self.groups):
            if any(match(m) for m in g) and all(fits(a, b) for a in joined for b in g):
                joined = g + joined
                self.groups.remove(g)
        self.groups.append(joined)
        for g in old:
            yield from self._named(g)

    def _named(self, group: list) -> Iterator[tuple]:
        first = min(group, key=lambda m: (m[1], m[0]))[0]
        for m in group:
            yield m[0], first

    def end(self) -> Iterator[tuple]:
        for g in self.groups:
            yield from self._named(g)


def _labels(state, times: list[float], tokens: list[set], marks: list[set]) -> list[int]:
    out = {}
    for n, (t, w, m) in enumerate(zip(times, tokens, marks)):
        out.update(state.add(n, t, w, m, 0.0))
    out.update(state.end())
    return [out[n] for n in range(len(times))]


def leader_labels(times: list[float], tokens: list[set], window_s: float, least: float) -> list[int]:
    """Each row's leader, by place; rows are in order of time."""
    return _labels(Leaders(window_s, least), times, tokens, [set()] * len(times))


def component_labels(times: list[float], tokens: list[set], marks: list[set], window_s: float, least: float) -> list[int]:
    """Each row's first group member, by place; rows are in order of time."""
    return _labels(Components(window_s, least), times, tokens, marks)


def clusters(
    df: DataFrame, block: str, time: str, row_id: str, tokens: str, kind: Callable = Leaders, window_s: float = 172_800,
    least: float = 0.6, marks: str | None = None, weight: str | None = None,
) -> DataFrame:
    """row_id and leader_id of every row. Time is in seconds; a null time or block counts as 0 or its own block."""
    rows = df.select(
        F.coalesce(F.col(block).cast("string"), F.lit("")).alias("b"), F.coalesce(F.col(time).cast("double"), F.lit(0.0)).alias("t"), F.col(row_id).alias("n"),
        F.coalesce(tokens, F.array().cast("array<string>")).alias("w"),
        (F.coalesce(marks, F.array().cast("array<string>")) if marks else F.array().cast("array<string>")).alias("m"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)).alias("x"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for pdf in batches:
            out: list[tuple] = []
            for b, t, n, w, m, x, part in pdf.itertuples(index=False, name=None):
                if state is None or (b, part) != now:
                    out += state.end() if state else ()
                    state, now = kind(window_s, least), (b, part)
                out += state.add(n, t, set(w), set(m), x)
            yield pd.DataFrame(out, columns=[row_id, "leader_id"])
        if state:
            yield pd.DataFrame(list(state.end()), columns=[row_id, "leader_id"])

    # Nothing reaches across a gap longer than the window: a block is cut where a bucket of that length is empty.
    bucket = F.floor(F.col("t") / window_s)
    used = rows.select("b", bucket.alias("u")).distinct()
    before = Window.partitionBy("b").orderBy("u")
    runs = used.withColumn("new", F.when(F.col("u") - F.lag("u").over(before) > 1, 1).otherwise(0)).select("b", "u", F.sum("new").over(before).alias("run"))
    cut = rows.withColumn("u", bucket).join(runs, ["b", "u"]).select("b", "t", "n", "w", "m", "x", "run")
    return cut.repartition("b", "run").sortWithinPartitions("b", "run", "t", "n").mapInPandas(run, f"{row_id} long, leader_id long")


def leader_clusters(df: DataFrame, block: str, time: str, row_id: str, tokens: str, window_s: float = 172_800, least: float = 0.6) -> DataFrame:
    """row_id and leader_id by leader clustering."""
    return clusters(df, block, time, row_id, tokens, Leaders, window_s, least)
