"""Known answers for operators whose ties and edges the tables do not exercise."""

from datetime import datetime as T

import pytest

from eventloom.operators.asof import asof_join
from eventloom.operators.cluster import component_labels, leader_labels
from eventloom.operators.metrics import average_precision, roc_auc
from eventloom.streaming.jobs import buckets, dedup, upsert_to

T0, T1, T2 = T(2024, 1, 1, 10), T(2024, 1, 1, 10, 10), T(2024, 1, 1, 11)


@pytest.mark.parametrize("forward,strict,expected", [(True, False, 1.0), (True, True, 2.0), (False, False, 1.0), (False, True, None)])
def test_asof_ties(spark, forward, strict, expected):
    left = spark.createDataFrame([(1, "a", T0)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T0, 1.0), ("a", T1, 2.0), ("b", T0, 9.0)], "k string, at timestamp_ntz, v double")
    assert asof_join(left, right, ["k"], "t", "at", "v", "hit", forward, strict).first()["hit"] == expected


def test_asof_tolerance_voids_and_null_time_matches_nothing(spark):
    left = spark.createDataFrame([(1, "a", T1), (2, "a", None)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T2, 1.0)], "k string, at timestamp_ntz, v double")
    assert [r["hit"] for r in asof_join(left, right, ["k"], "t", "at", "v", "hit", tolerance_s=1200).collect()] == [None, None]
    assert {r["id"]: r["hit"] for r in asof_join(left, right, ["k"], "t", "at", "v", "hit").collect()} == {1: 1.0, 2: None}


@pytest.mark.parametrize("forward,expected", [(True, [2.0, 2.0, 3.0, None]), (False, [None, 1.0, 2.0, 3.0])])
def test_asof_carries_over_empty_buckets(spark, forward, expected):
    left = spark.createDataFrame([(n, "a", T(2024, 1, day, 12)) for n, day in enumerate((1, 3, 9, 20))], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T(2024, 1, 1, 12), 1.0), ("a", T(2024, 1, 5), 2.0), ("a", T(2024, 1, 12), 3.0), ("b", T(2024, 1, 2), 9.0)], "k string, at timestamp_ntz, v double")
    got = {r["id"]: r["hit"] for r in asof_join(left, right, ["k"], "t", "at", "v", "hit", forward, strict=True).collect()}
    assert [got[n] for n in range(4)] == expected


def test_auc_and_precision_known_answers(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert roc_auc(df, "s", "y").first()["auc"] == 0.75
    assert abs(average_precision(df, "s", "y").first()["pr_auc"] - 5 / 6) < 1e-12
    assert roc_auc(df.where("y = 1"), "s", "y").first()["auc"] is None


def test_leader_clusters_compare_with_first_member_only():
    words = [{"a", "b", "c"}, {"b", "c", "d"}, {"c", "d", "e"}]
    assert leader_labels([0, 1, 2], words, 10, 0.6) == [0, 0, 2]
    assert leader_labels([0, 100], [words[0]] * 2, 10, 0.6) == [0, 1]


def test_component_clusters_veto_conflicting_marks():
    w = [{"a", "b"}] * 3
    assert component_labels([0, 1, 2], w, [{"x"}, set(), {"y"}], 10, 0.6) == [0, 0, 2]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, 5), (1, T0, 6), (2, T1, 7)], "k int, t timestamp, v int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for n, (out, expected) in enumerate([(dedup(stream, ["k"], "t"), 2), (buckets(stream, "t", ["k"]), 2)]):
        q = out.writeStream.format("memory").queryName(f"s{n}").outputMode("append" if n == 0 else "complete").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(f"s{n}").count() == expected
    sink = upsert_to(str(tmp_path / "t"), ["k"], ["v"])
    sink(rows, 0)
    sink(rows.limit(0), 1)
    sink(rows.limit(0), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).select("k", "v").collect()) == [(1, 6), (2, 7)]


def test_logistic_sums_equal_plain_newton(spark):
    import numpy as np

    from eventloom.operators.models import fit_logistic, seal, unseal

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    w, one = np.zeros(3), np.column_stack([np.ones(300), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        r = np.diag([0.0, 1.0, 1.0])
        w = w + np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) + r, one.T @ (y - p) - r @ w)
    assert np.allclose(fit_logistic(df, ["a", "b"], "y"), w, atol=1e-7)
    assert np.isfinite(fit_logistic(df.limit(0), ["a", "b"], "y")).all() and fit_logistic(df.where("y = 1"), ["a"], "y")[1] == 0
    text = seal({"features": ["a"], "weights": [0.0, 1.5], "trained_through": 3})
    assert unseal(text, ["a"])["weights"] == [0.0, 1.5]
    for broken in (text.replace("1.5", "1.6"), text.replace("linear-model/1", "x"), text.replace('"features"', '"feature"')):
        with pytest.raises(ValueError):
            unseal(broken)
    with pytest.raises(ValueError):
        unseal(text, ["b"])


@pytest.mark.parametrize("forward", [True, False])
def test_asof_null_keys_match_nothing(spark, forward):
    left = spark.createDataFrame([(1, None, T0), (2, "a", T0)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([(None, T0, 1.0), ("a", T0, 2.0)], "k string, at timestamp_ntz, v double")
    assert {r["id"]: r["hit"] for r in asof_join(left, right, ["k"], "t", "at", "v", "hit", forward).collect()} == {1: None, 2: 2.0}
