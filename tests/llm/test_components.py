"""Components of links: the least node of each, in no more rounds than it takes."""

import random

import numpy as np

from eventloom.llm import jaccard_join


def least_nodes(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent if find(x) != x}


def test_components_end_with_stars(spark, monkeypatch):
    """A round is some six shuffles and two joins, whose tables the driver broadcasts: none runs only to find that nothing changes."""
    written, released = [], []
    materialize = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(jaccard_join, "release", lambda session: released.append(1))
    run = lambda edges: {tuple(r) for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    stars = [(n, 1) for n in range(2, 40)] + [(100, n) for n in range(101, 102)] + [(7, 7), (1, 5), (5, 1)]
    assert run(stars) == least_nodes(stars)
    assert len(written) == 1 and not released
    some = random.Random(3)
    for edges in ([(n, n + 1) for n in range(60)], [(some.randrange(300), some.randrange(300)) for _ in range(220)], [(n, 50) for n in range(50)]):
        written.clear(), released.clear()
        assert run(edges) == least_nodes(edges)
        assert len(released) == len(written) - 1 > 0  # garbage goes after every round
    assert jaccard_join.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_frequent_shingles_come_as_columns(spark, monkeypatch):
    """Up to 200,000 frequent shingles reach the driver as an Arrow column, not as rows."""
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: [r for r in f(self) if self.columns != ["token", "count"] or not 1 / 0])
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(n, f"{text} {'x' * (n % 3)}") for n in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    sets = [jaccard_join.shingle_sets([f"{text} {'x' * (n % 3)}".encode()])[0] for n in range(12)]
    links = [(a, b) for a in range(12) for b in range(12) if jaccard_join.links(np.sort(sets[a]), np.sort(sets[b]), 75)]
    least = dict(least_nodes(links))
    assert got == {n: least.get(n, n) for n in range(12)}
