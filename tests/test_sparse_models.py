"""Sparse fits against dense optima, vocabularies, missing values and group weights."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators.sparse_models import RowEncoder, TextEncoder, fit_sparse, group_weights, score_sparse


def optimum(x, y, w, classes, c, penalized):
    """By Newton's steps on dense rows; the ridge of an intercept left free is tiny."""
    x = np.hstack([x, np.ones((len(x), 1))])
    width, d = (1 if classes == 2 else classes), x.shape[1]
    ridge = np.ones((width, d))
    ridge[:, -1] = 1 if penalized else 1e-12
    theta = np.zeros(width * d)
    for _ in range(100):
        z = x @ theta.reshape(width, d).T
        if width == 1:
            p = 1 / (1 + np.exp(-z))
            off = p - y[:, None]
        else:
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = p - np.eye(classes)[y]
        g = (theta.reshape(width, d) * ridge + c * (off * w[:, None]).T @ x).ravel()
        h = np.diag(ridge.ravel())
        for a in range(width):
            for b in range(width):
                m = p[:, a] * ((a == b) - p[:, b]) if width > 1 else p[:, 0] * (1 - p[:, 0])
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] += c * (x * (w * m)[:, None]).T @ x
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        theta = theta - step
        if np.abs(step).max() < 1e-12:
            break
    return theta.reshape(width, d)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 240
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), None if rng.random() < 0.2 else float(rng.normal() * 40)
        kind = "xyz"[rng.integers(3)] if rng.random() < 0.9 else None
        y = int(a + (b or 15) / 40 + (kind == "x") + rng.normal() > 0.7)
        rows.append((i, a, b, kind, f"g{int(rng.zipf(1.7)) % 9}" if i % 11 else None, y, int(rng.integers(3))))
    return rows, spark.createDataFrame(rows, "id int, a double, b double, kind string, grp string, y int, `three` int").repartition(3)


def dense(rows):
    flat = [[r[1], r[2] or 0.0, 0.0, float(r[2] is None)] for r in rows]
    x = np.array(flat)
    scale = x.std(0)
    x = x / np.where(scale == 0, 1, scale)
    return np.hstack([x, np.array([[float(r[3] == k) for k in "xyz"] for r in rows])])


def test_binary_fit_is_the_optimum(spark, table):
    rows, df = table
    weighed = group_weights(df, "grp")
    w = {r.id: r.w for r in weighed.select("id", "w").collect()}
    sizes = Counter(r[4] for r in rows)
    assert all(abs(w[r[0]] - len(rows) / len(sizes) / sizes[r[4]]) < 1e-12 for r in rows)
    encoder = RowEncoder(["a", "b"], ["kind"]).fit(df)
    assert encoder.names == ["a", "b", "missing_a", "missing_b", "kind=x", "kind=y", "kind=z"]
    x, y = dense(rows), np.array([r[5] for r in rows])
    encoded = encoder.transform(weighed)
    for r in encoded.select("id", "i", "v").collect():
        row = np.zeros(7)
        row[r.i] = r.v
        assert np.allclose(row, x[r.id])
    for penalized in (True, False):
        got = fit_sparse(encoded, 7, c=0.1, penalize_intercept=penalized, weight="w")
        assert np.allclose(got, optimum(x, y, np.array([w[r[0]] for r in rows]), 2, 0.1, penalized), atol=1e-6)
    p = {r.id: r.p for r in score_sparse(encoded.select("id", "i", "v"), got).collect()}
    assert np.allclose([p[i][1] for i in range(len(rows))], 1 / (1 + np.exp(-(x @ got[0, :-1] + got[0, -1]))))
    unseen = spark.createDataFrame([(1, None, float("nan"), "new", None, None, None)], df.schema)
    assert encoder.transform(unseen).first().v == [1 / encoder.scales[3]] or encoder.transform(unseen).first().i == [2, 3]


def test_ternary_fit_is_the_optimum(table):
    rows, df = table
    encoder = RowEncoder(["a", "b"], ["kind"]).fit(df)
    got = fit_sparse(encoder.transform(df), 7, classes=3, c=0.5, label="three")
    expected = optimum(dense(rows), np.array([r[6] for r in rows]), np.ones(len(rows)), 3, 0.5, False)
    center = lambda m: m - np.append(np.zeros(m.shape[1] - 1), m[:, -1].mean())  # noqa: E731  a free intercept is free up to a shift
    assert np.allclose(center(got), center(expected), atol=1e-5)


def test_text_rows_are_tf_idf(spark):
    texts = ["Red red apple", "red pear-tree apple", "green pear-tree", "green apple a", None, "", "red apple red apple red"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    e = TextEncoder(dims=1 << 16, least=2, most_share=0.9).fit(df, "text")
    words = [re.findall(r"[\w-]{2,}", (t or "").lower()) for t in texts]
    grams = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    names = sorted({g for w in grams for g in w})
    place = dict(zip(names, (r[0] for r in spark.createDataFrame([(n, g) for n, g in enumerate(names)], "n int, g string").orderBy("n").select(F.pmod(F.xxhash64("g"), F.lit(1 << 16))).collect())))
    assert len(set(place.values())) == len(names)
    df_of = Counter(g for w in grams for g in set(w))
    for r in e.transform(df, "text").collect():
        tf = Counter(g for g in grams[r.id] if 2 <= df_of[g] <= 0.9 * len(texts))
        row = {place[g]: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df_of[g])) + 1) for g, k in tf.items()}
        size = math.sqrt(sum(v * v for v in row.values()))
        assert dict(zip(r.i, r.v)) == pytest.approx({i: v / size for i, v in row.items()}) and r.i == sorted(r.i)
    assert TextEncoder(dims=64).fit(df.limit(0), "text").transform(df.limit(0), "text").collect() == []


def test_too_many_values(table):
    with pytest.raises(ValueError, match="over 10 values"):
        RowEncoder([], ["id"]).fit(table[1], most=10)


def test_batches_are_cut_by_entries():
    import pyarrow as pa

    from eventloom.operators.sparse_models import pieces

    sizes = [3, 0, 4, 9, 0, 2, 1, 1, 5, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([[n] * n for n in sizes])], names=["id", "i"])
    parts = list(pieces(batch, 1, 7))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [sum(p.column(1).value_lengths().to_pylist()) for p in parts] == [7, 9, 4, 5]
    assert list(pieces(batch.slice(0, 0), 1)) == []
