"""Logistic models over sparse rows: learned one-hot vocabularies, hashed TF-IDF, fits by L-BFGS over aggregates (M2, M6).

A sparse row is (i array<int>, v array<double>). A fit asks Spark for a loss and a gradient at a point; each task adds up its
rows' parts by feature and emits those that aren't zero, a grouped sum merges them, and the driver gets a number for each
feature and class: its memory grows with the features, which a parameter bounds, never with the rows. Newton's matrix is not
formed. Rows are written once to the shared folder, so that a step reads them and nothing behind them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

SPARSE = "i array<int>, v array<double>"


def pieces(batch, column: int, most: int = 1 << 18):
    """A batch in runs of rows of `most` entries of a list column at most, or one row: long texts would fill memory by their arrays."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def group_weights(df: DataFrame, group: str, out: str = "w") -> DataFrame:
    """Each group counts as one, scaled so that weights are 1 on average; a null group is a group.

    Sizes are counted before the shuffle and come back by a null-safe join, so that a hot group is many tasks.
    """
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n"))
    n, groups = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    return df.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).withColumn(out, F.lit(n / max(groups, 1)) / F.col("__n")).drop("__group", "__n")


@dataclass
class RowEncoder:
    """Numeric columns over their deviation, without centring, each with a flag for missing values; categories one-hot.

    Features stand in the order numeric, flags, categories by column and value. A null category, and one that training hasn't
    seen, has no feature.
    """

    numeric: list[str]
    categorical: list[str]
    scales: list[float] = field(default_factory=list)
    vocabulary: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"missing_{n}" for n in self.numeric), *(f"{c}={v}" for c in self.categorical for v in self.vocabulary[c])]

    def fit(self, df: DataFrame, most: int = 100_000) -> RowEncoder:
        """Learn deviations and values; ValueError where a column has more than `most` values."""
        missing = [self._missing(n).cast("double") for n in self.numeric]
        values = [F.when(self._missing(n), 0.0).otherwise(F.col(n).cast("double")) for n in self.numeric]
        spread = df.agg(F.lit(0.0), *[F.stddev_pop(x) for x in (*values, *missing)]).first()[1:]
        self.scales = [float(s) if s else 1.0 for s in spread]
        for c in self.categorical:
            found = [r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(most + 1).collect()]  # most + 1 rows
            if len(found) > most:
                raise ValueError(f"{c} has over {most} values: hash it")
            self.vocabulary[c] = sorted(found)
        return self

    @staticmethod
    def _missing(name: str) -> Column:
        x = F.col(name).cast("double")
        return x.isNull() | F.isnan(x)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with i and v."""
        spark, at = df.sparkSession, 2 * len(self.numeric)
        entry = lambda i, v: F.struct(F.lit(i).alias("i"), v.alias("v"))
        flags = [self._missing(n) for n in self.numeric]
        parts = [entry(k, F.when(m, 0.0).otherwise(F.col(n).cast("double")) / self.scales[k]) for k, (n, m) in enumerate(zip(self.numeric, flags))]
        parts += [entry(len(flags) + k, m.cast("double") / self.scales[len(flags) + k]) for k, m in enumerate(flags)]
        out = df
        for c in self.categorical:
            known = spark.createDataFrame([(v, at + k) for k, v in enumerate(self.vocabulary[c])], f"`__v_{c}` string, `__i_{c}` int")  # Spark broadcasts it where it is small
            out = out.join(known, F.col(c).cast("string") == F.col(f"__v_{c}"), "left")
            parts.append(F.when(F.col(f"__i_{c}").isNotNull(), F.struct(F.col(f"__i_{c}").alias("i"), F.lit(1.0).alias("v"))))
            at += len(self.vocabulary[c])
        x = F.filter(F.array(*parts), lambda e: e.isNotNull() & (e["v"] != 0)) if parts else F.expr("array()")
        return out.withColumn("__x", x).select(*[F.col(f"`{c}`") for c in df.columns], F.col("__x.i").alias("i"), F.col("__x.v").alias("v"))


@dataclass
class TextEncoder:
    """Hashed TF-IDF of words and pairs of words: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows of length 1.

    Features in fewer than `least` or more than `most_share` of the texts are left out. Words are letters, digits, _ and -,
    two at least, in lower case; different words may share a feature of the `dims`.
    """

    dims: int = 1 << 18
    pairs: bool = True
    least: int = 3
    most_share: float = 0.98
    idf: np.ndarray | None = None

    def hashed(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_-]{2,}"), F.lit(0))
        grams = F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))) if self.pairs else words
        return F.transform(grams, lambda t: F.pmod(F.xxhash64(t), F.lit(self.dims)).cast("int"))

    def fit(self, df: DataFrame, text: str) -> TextEncoder:
        """Count documents by feature: `dims` numbers at most reach the driver."""
        each = df.select(F.array_distinct(self.hashed(F.col(text))).alias("h"))
        n = each.count()
        self.idf = np.zeros(self.dims)
        for i, c in each.select(F.explode("h").alias("i")).groupBy("i").count().collect():
            if self.least <= c <= self.most_share * n:
                self.idf[i] = np.log((1 + n) / (1 + c)) + 1
        return self

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        """df with i and v."""
        import pyarrow as pa

        shared = df.sparkSession.sparkContext.broadcast(self.idf)  # dims numbers
        dims = self.dims

        def run(batches):
            idf = shared.value
            for batch in (part for whole in batches for part in pieces(whole, whole.num_columns - 1)):
                hashes = batch.column(batch.num_columns - 1)
                sizes = hashes.value_lengths().fill_null(0).to_numpy()
                key = np.repeat(np.arange(len(sizes)), sizes) * dims + hashes.flatten().to_numpy()
                key, tf = np.unique(key, return_counts=True)
                row, i = key // dims, key % dims
                v = (1 + np.log(tf)) * idf[i]
                row, i, v = row[v > 0], i[v > 0], v[v > 0]
                length = np.sqrt(np.bincount(row, v * v, len(sizes)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (i.astype(np.int32), v / length[row])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "i", "v"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.withColumn("__h", self.hashed(F.col(text))).mapInArrow(run, f"{fields}, {SPARSE}")


def minimized(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, rounds: int, memory: int = 12) -> np.ndarray:
    """A smooth convex function's minimum by L-BFGS with backtracking; each call is a pass over the rows."""
    x, pairs = start, []
    f, g = value_and_slope(x)
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        step, used = -g, []
        for s, y in reversed(pairs):
            a = (s @ step) / (s @ y)
            step = step - a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            step = step * ((s @ y) / (y @ y))
        else:
            step = step / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(used)):
            step = step + s * (a - (y @ step) / (s @ y))
        rate, slope = 1.0, g @ step
        while True:
            new_f, new_g = value_and_slope(x + rate * step)
            if new_f <= f + 1e-4 * rate * slope + 1e-12 * abs(f) or rate < 1e-10:
                break
            rate /= 2
        s, y = rate * step, new_g - g
        if s @ y > 1e-14 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        x, f, g = x + s, new_f, new_g
        if rate < 1e-10:
            break
    return x


def fit_sparse(rows: DataFrame, dims: int, classes: int = 2, c: float = 1.0, penalize_intercept: bool = False, tolerance: float = 1e-7, rounds: int = 200, label: str = "y", weight: str | None = None) -> np.ndarray:
    """Weights (1, or classes) x (dims + 1), the intercept last: the minimum of |w|^2 / 2 + c x the weighted log loss.

    Two classes: one row, of the log odds of label 1. More: softmax. Rows with a null label take no part.
    """
    import pyarrow as pa

    spark, width = rows.sparkSession, 1 if classes == 2 else classes
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = kept(rows.where(F.col(label).isNotNull()).select("i", "v", F.col(label).cast("int").alias("y"), own.alias("w")), "sparse-rows")

    def value_and_slope(point: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(point.reshape(width, dims + 1))

        def run(batches):
            weights, loss, slope = shared.value, 0.0, np.zeros((width, dims + 1))
            for batch in (part for whole in batches for part in pieces(whole, 0)):
                z, i, row, v = margins(batch.column(0), batch.column(1), weights)
                y, w = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                if width == 1:
                    signed = np.where(y == 1, -z[:, 0], z[:, 0])
                    loss += w @ np.logaddexp(0, signed)
                    off = (w * (1 / (1 + np.exp(-z[:, 0])) - y))[:, None]
                else:
                    top = z.max(1, keepdims=True)
                    e = np.exp(z - top)
                    loss += w @ (np.log(e.sum(1)) + top[:, 0] - z[np.arange(len(y)), y])
                    off = e / e.sum(1, keepdims=True)
                    off[np.arange(len(y)), y] -= 1
                    off = off * w[:, None]
                for k in range(width):
                    slope[k, :dims] += np.bincount(i, off[row, k] * v, dims)
                slope[:, dims] += off.sum(0)
            k, i = np.nonzero(slope)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(i, 0).astype(np.int32)), pa.array(np.append(slope[k, i], loss))], names=["k", "i", "g"]
            )

        slope, loss = np.zeros((width, dims + 1)), 0.0
        for k, i, g in data.mapInArrow(run, "k int, i int, g double").groupBy("k", "i").agg(F.sum("g")).collect():  # width x (dims + 1) rows at most
            if k < 0:
                loss = g
            else:
                slope[k, i] = g
        shared.unpersist()
        ridge = point.reshape(width, dims + 1).copy()
        if not penalize_intercept:
            ridge[:, dims] = 0
        return float((ridge * ridge).sum() / 2 + c * loss), (ridge + c * slope).ravel()

    return minimized(value_and_slope, np.zeros(width * (dims + 1)), tolerance, rounds).reshape(width, dims + 1)


def margins(i_column, v_column, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sparse rows: their margins by class, and the features, rows and values of all entries."""
    i, v = i_column.flatten().to_numpy(), v_column.flatten().to_numpy()
    sizes = i_column.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    z = np.stack([np.bincount(row, w[i] * v, len(sizes)) + w[-1] for w in weights], 1) if len(sizes) else np.zeros((0, len(weights)))
    return z, i, row, v


def score_sparse(rows: DataFrame, weights: np.ndarray, out: str = "p") -> DataFrame:
    """rows, but for i and v, with the probabilities of all classes as an array."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in rows.columns if c not in ("i", "v")]
    many = max(2, len(weights))

    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole, len(names))):
            z = margins(batch.column(len(names)), batch.column(len(names) + 1), shared.value)[0]
            if z.shape[1] == 1:
                z = np.concatenate([np.zeros_like(z), z], 1)
            e = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
            p = (e / e.sum(1, keepdims=True)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, many, dtype=np.int32)), pa.array(p))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.select(*[F.col(f"`{n}`") for n in names], "i", "v").mapInArrow(run, f"{fields}, `{out}` array<double>")
