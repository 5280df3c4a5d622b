"""Aggregates over windows of fixed length, against all pairs, and without making pairs."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom import plans
from eventloom.operators.windows import window_aggregates, window_rows
from eventloom.plans.market import entries, horizon
from eventloom.sources.fixtures import bars

SF = "/root/testdata/sf0.001"


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("strict", [False, True])
def test_windows_hold_what_all_pairs_hold(spark, strict):
    rng = random.Random(3)
    key = lambda: rng.choice(["a", "a", "b", None])
    left = [(n, key(), rng.choice([None, rng.randrange(-40, 60)])) for n in range(150)]
    right = [(key(), rng.choice([None, rng.randrange(-60, 60)]), float(rng.randrange(9))) for _ in range(200)]
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz").alias(c)
    df = window_aggregates(
        spark.createDataFrame(left, "id long, k string, s long").select("id", "k", at("s")), "id", spark.createDataFrame(right, "k string, t long, v double").select("k", at("t"), "v"),
        ["k"], "s", 10, "t", {"low": F.col("v"), "first": F.struct(F.unix_seconds(F.col("t").cast("timestamp")), "v")}, {"high": F.col("v")}, strict,
    )
    expected = []
    for number, k, s in left:
        held = [] if k is None or s is None else [(t, v) for x, t, v in right if x == k and t is not None and (s < t if strict else s <= t) and t <= s + 10]
        if held:
            expected.append((number, len(held), min(v for _, v in held), max(v for _, v in held), min(held)))
    assert sorted((r.id, r.n, r.low, r.high, tuple(r["first"])) for r in df.collect()) == expected


def test_event_window_rows_meets_no_pairs(spark):
    assert joins(plans.queries()["event_window_rows"](spark, SF)) == joins(entries(spark, SF))


def test_window_stats_meets_no_pairs(spark):
    assert joins(plans.queries()["window_stats"](spark, SF)) == 0


def test_check_reconcile_meets_no_pairs(spark):
    assert joins(plans.queries()["check_reconcile"](spark, SF)) == 2 * joins(horizon(entries(spark, SF), spark, SF, 4, "target")) + 1  # the labels, those again for their windows, and both together


def test_steps_of_feature_rows_dont_work_out_those_before_them(spark):
    plan = plans.queries()["materiality_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 24


@pytest.mark.parametrize("strict", [False, True])
def test_window_rows_are_all_pairs(spark, strict):
    rng = random.Random(4)
    left = [(n, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-40, 60)])) for n in range(80)]
    right = [(n, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-60, 60)])) for n in range(120)]
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz").alias(c)
    df = window_rows(spark.createDataFrame(left, "id long, k string, s long").select("id", "k", at("s")), spark.createDataFrame(right, "row long, k string, t long").select("row", "k", at("t")), ["k"], "s", 10, "t", strict)
    expected = [(a, b) for a, k, s in left for b, x, t in right if k is not None and k == x and None not in (s, t) and (s < t if strict else s <= t) and t <= s + 10]
    assert sorted((r.id, r.row) for r in df.collect()) == sorted(expected)


def test_event_window_rows_tells_which_bars(spark):
    order = {}
    for r in bars(spark, SF).orderBy("at", "bar_id").collect():
        order.setdefault(r.ticker, []).append(r.bar_id)
    e = entries(spark, SF).select("signal_id", "ticker", "entry_at")
    laid_out, ticker = {}, {r.signal_id: r.ticker for r in e.collect()}
    for r in window_rows(e, bars(spark, SF), ["ticker"], "entry_at", 6 * 3600, "at").collect():
        laid_out.setdefault(r.signal_id, set()).add(r.bar_id)
    told = {}
    for r in plans.queries()["event_window_rows"](spark, SF).collect():
        run = order[ticker[r.signal_id]]
        told[r.signal_id] = set(run[run.index(r.first_bar) : run.index(r.last_bar) + 1])
        assert len(told[r.signal_id]) == r.n
    assert told and told == laid_out
