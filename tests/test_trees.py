"""Trees from aggregates against a plain NumPy grower."""

import numpy as np

from eventloom.operators.trees import Split, bin_of, fit_trees, quantile_edges

FEATURES = ["a", "b", "c"]


def rows_of(rng, n):
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0], nan=1) > 0.3) ^ (np.nan_to_num(x[:, 2]) < -0.4)).astype(int)
    y[rng.random(n) < 0.05] ^= 1
    return x, y


def plain(x, y, w, edges, trees, depth, rate, ridge, least):
    """Row by row, in NumPy."""
    bins = np.stack([np.where(np.isnan(x[:, f]), 0, 1 + sum((x[:, f] > e).astype(int) for e in edges[f])) for f in range(x.shape[1])], 1).astype(int)
    base = np.log((w @ y + 0.5) / (w.sum() - w @ y + 0.5))
    margin, out = np.full(len(y), base), []

    def grow(at, level):
        p = 1 / (1 + np.exp(-margin[at]))
        g, h = w[at] * (y[at] - p), w[at] * p * (1 - p)
        best, value = None, lambda a, b: a * a / (b + ridge)
        if level < depth:
            for f in range(x.shape[1]):
                for upto in range(1, 1 + max(map(len, edges))):
                    for missing in (True, False):
                        b = bins[at, f]
                        left = np.where(b == 0, missing, b <= upto)
                        if not missing and not (b == 0).any() or min(left.sum(), (~left).sum()) < least:
                            continue
                        gain = value(g[left].sum(), h[left].sum()) + value(g[~left].sum(), h[~left].sum()) - value(g.sum(), h.sum())
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = gain, f, upto, missing, left
        if best is None:
            step[at] = rate * g.sum() / (h.sum() + ridge)
            return step[at][0]
        _, f, upto, missing, left = best
        return f, upto, missing, grow(at[left], level + 1), grow(at[~left], level + 1)

    for _ in range(trees):
        step = np.zeros(len(y))
        out.append(grow(np.arange(len(y)), 0))
        margin = margin + step
    return out, margin


def shape(node):
    return (node.feature, node.upto, node.missing_left, shape(node.left), shape(node.right)) if isinstance(node, Split) else node


def flat(node):
    return [x for part in node for x in flat(part)] if isinstance(node, tuple) else [node]


def test_trees_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    x, y = rows_of(rng, 600)
    w = rng.integers(1, 4, len(y)).astype(float)
    data = [(*[None if np.isnan(v) and i % 2 else float(v) for v in r], int(t), float(k), i) for i, (r, t, k) in enumerate(zip(x, y, w))] + [(1.0, 1.0, 1.0, None, 1.0, -1)]
    df = spark.createDataFrame(data, "a double, b double, c double, y int, w double, i int").repartition(3)
    model = fit_trees(df, FEATURES, "y", trees=4, depth=3, rate=0.3, bins=8, least=10, weight="w")
    expected, margin = plain(x, y, w, model.edges, 4, 3, 0.3, 1.0, 10)
    assert np.allclose(np.array([v for t in model.trees for v in flat(shape(t))], float), np.array([v for t in expected for v in flat(t)], float), atol=1e-9)
    got = {r.i: r.p for r in df.select("i", model.probability().alias("p")).collect()}
    p = 1 / (1 + np.exp(-margin))
    assert np.allclose([got[i] for i in range(len(y))], p, atol=1e-9) and got[-1] is not None
    assert ((p >= 0.5) == (y == 1)).mean() > 0.85


def test_edges_and_bins(spark):
    df = spark.createDataFrame([(float(i % 10), float("nan"), None) for i in range(100)], "a double, b double, c double")
    edges = quantile_edges(df, FEATURES, 5)
    assert edges == [[1.0, 3.0, 5.0, 7.0], [], []]
    got = {r.a: r.b for r in df.select("a", bin_of(df["a"], edges[0]).alias("b")).distinct().collect()}
    assert got == {float(i): 1 + sum(i > e for e in edges[0]) for i in range(10)}
    assert {r[0] for r in df.select(bin_of(df["b"], [])).collect()} == {0}


def test_one_label_or_none(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1)], "a double, b double, c double, y int")
    assert fit_trees(df, FEATURES, "y").trees == [] and fit_trees(df.limit(0), FEATURES, "y").trees == []
    assert 0.5 < df.select(fit_trees(df, FEATURES, "y").probability()).first()[0] < 1
