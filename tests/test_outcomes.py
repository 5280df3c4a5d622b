"""Outcomes and reports on planted signals, each case worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.operators import outcomes as O
from eventloom.operators.metrics import wilson
from eventloom.plans.signal_ops import expire

T = dt.datetime(2024, 1, 1, 10)
NOW = dt.datetime(2024, 1, 10)


def at(hours=0.0, minutes=0.0):
    return T + dt.timedelta(hours=hours, minutes=minutes)


SIGNALS = "signal_id long, ticker string, as_of timestamp_ntz, data_cutoff_at timestamp_ntz, created_at timestamp_ntz, news_id long, direction string, score double, confidence double, model_version string, config_version string"
NEWS = "news_id long, source_id string, url string, published_at timestamp_ntz, received_at timestamp_ntz"
BARS = "ticker string, at timestamp_ntz, open double, close double"


def signal(i, ticker, direction="up", created=at(), cutoff=at(), as_of=at(), news=1, confidence=0.75):
    return (i, ticker, as_of, cutoff, created, news, direction, 10.0, confidence, "m", "c")


def run(spark, signals, news, bars, now=NOW):
    lit = F.lit(now).cast("timestamp_ntz")
    return O.outcomes(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(news, NEWS), spark.createDataFrame(bars, BARS), lit)


@pytest.fixture(scope="module")
def done(spark):
    news = [(1, "a", "u", at(-1), at(minutes=-30)), (2, None, None, at(2), at(3)), (3, "a", "u", at(-1), at(1))]
    bars = [("A", at(), 1.0, 1.0)] + [("A", at(minutes=5 + 60 * h), 100.0 + h, 100.5) for h in (0, 1, 4, 24, 72)]  # a bar at the decision is no entry
    bars += [("B", at(minutes=1), 50.0, 50.0), ("B", at(minutes=90), 60.0, 60.0), ("C", at(minutes=1), 10.0, 10.0), ("C", at(minutes=61), 10.0, 10.0), (None, at(), 1.0, 1.0), ("D", None, 1.0, 1.0), ("D", at(1), None, 1.0)]
    signals = [
        signal(1, "A"), signal(2, "A", "down"), signal(3, "A", "neutral"), signal(4, "B"), signal(5, "C"), signal(6, "D"), signal(7, "A", news=2), signal(8, "A", news=3), signal(9, "A", news=9), signal(10, "A", news=None),
        signal(11, "A", created=at(minutes=16)), signal(12, "A", created=at(minutes=-1)), signal(13, "A", cutoff=at(minutes=1)), signal(14, "A", cutoff=None), signal(15, None), signal(16, "C", "neutral", confidence=None),
        signal(17, "A", as_of=None, cutoff=None, created=None, news=None), signal(18, "A", None),
    ]
    return {r.signal_id: r for r in run(spark, signals, news, bars).collect()}


def test_entries_and_returns(done):
    a = done[1]
    assert (a.entry, a.entry_at, a.bp_1h, a.bp_4h, a.bp_1d, a.bp_3d, a.bp_latest) == (100.0, at(minutes=5), 100, 400, 2400, 7200, 50)
    assert (a.status, a.verdict, a.verdict_status, a.outcome_terminal, a.raw_observation_count) == ("evaluated", True, "evaluated", True, 8)
    assert done[2].verdict is False and done[3].verdict is None
    assert (done[3].verdict_status, done[3].neutral_move_status) == ("not_applicable", "material_move")
    assert done[16].neutral_move_status == "quiet"


def test_late_and_missing_bars(done):
    b = done[4]  # its only later bar comes 29 minutes late for one hour
    assert (b.delay_1h, b.timely_1h, b.bp_1h, b.seen_4h_at, b.verdict_status, b.status) == (29 * 60, False, None, None, "missed_window", "partial")
    c = done[5]  # without a four-hour bar the first hour decides, and a flat return is no hit
    assert (c.bp_4h, c.bp, c.verdict) == (None, 0, False)
    for n in (6, 15, 17):
        assert (done[n].entry, done[n].status, done[n].verdict_status, done[n].outcome_terminal, done[n].bp_latest) == (None, "unavailable", "unavailable", False, None)
    assert (done[18].verdict, done[18].bp_4h) == (None, 400)


def test_reasons_and_anchors(done):
    reasons = {1: None, 7: "evidence_published_after_signal", 8: "evidence_received_after_signal", 9: "missing_evidence", 10: "missing_evidence", 11: "retrospective_signal", 12: "signal_as_of_after_creation", 13: "data_cutoff_after_creation", 14: "missing_time", 17: "missing_time"}
    assert {n: done[n].reason for n in reasons} == reasons
    assert (done[7].decision_at, done[7].evaluation_anchor, done[7].entry_at) == (at(3), "evidence_cutoff_replay", at(minutes=245))
    assert (done[9].decision_at, done[9].evaluation_anchor, done[9].cohort) == (at(), "live_decision", "retrospective")
    assert (done[11].decision_at, done[11].live_decision_at, done[11].processing_lag_seconds) == (at(), at(minutes=16), 960)
    assert (done[9].delivery_lag_seconds, done[9].processing_lag_seconds, done[12].processing_lag_seconds, done[17].processing_lag_seconds) == (None, 0, 0, None)
    assert (done[1].cohort, done[1].delivery_lag_seconds, done[10].raw_observation_count) == ("live", 1800, 1)


def test_pending_until_now(spark):
    bars = [("A", at(minutes=1), 10.0, 10.0)]
    news = [(1, "a", "u", at(-1), at(-1))]
    state = lambda now: run(spark, [signal(1, "A"), signal(2, "A", "neutral")], news, bars, now).orderBy("signal_id").collect()
    early, late = state(at(1)), state(at(1.5))
    assert [early[0].verdict_status, early[1].neutral_move_status, early[0].outcome_terminal] == ["pending", "pending", False]
    assert [late[0].verdict_status, late[1].neutral_move_status, late[0].outcome_terminal] == ["missed_window", "missed_window", False]
    assert state(at(73))[0].outcome_terminal


def test_empty_tables(spark):
    none = run(spark, [], [], [])
    assert none.count() == 0 and O.exclusions(none).count() == 0 and O.payoffs(none).count() == 0 and O.cost_scenarios(none).count() == 0
    summary = O.cohort_summary(none).collect()
    assert {(r.cohort, r.signals_total, r.hit_rate_pct, r.coverage_pct) for r in summary} == {(c, 0, None, 0.0) for c in O.COHORTS}
    assert {(r.signals, r.median_signed_return_pct) for r in O.breakdowns(none).collect()} == {(0, None)}
    alone = run(spark, [signal(1, "A")], [], []).collect()
    assert (alone[0].reason, alone[0].status) == ("missing_evidence", "unavailable")


def test_reports(spark):
    news = [(1, "a", "u", at(-1), at(-1))]
    bars = [(t, at(minutes=m), p, p) for t, m, p in (("A", 1, 100.0), ("A", 241, 101.0), ("B", 1, 100.0), ("B", 241, 98.0), ("C", 1, 100.0), ("C", 241, 100.25))]
    d = run(spark, [signal(1, "A"), signal(2, "B"), signal(3, "C", "down"), signal(4, "B", "neutral"), signal(5, "Z")], news, bars)
    live = O.cohort_summary(d).where("cohort = 'live'").first()
    assert (live.signals_total, live.directional_signals, live.evaluated, live.unavailable, live.partial, live.coverage_pct) == (5, 4, 3, 1, 3, 75.0)
    assert (live.hit_rate_pct, live.average_signed_return_pct, live.median_signed_return_pct) == (33.3, -0.42, -0.25)  # of 1.00, -2.00, -0.25
    arms = {r.arm: r for r in O.payoffs(d).where("cohort = 'all'").collect()}
    assert {a: (r.observations, r.hits, r.mean_pct, r.minimum_pct) for a, r in arms.items()} == {
        "system": (3, 1, -0.416667, -2.0), "always_up": (3, 2, -0.25, -2.0), "always_down": (3, 1, 0.25, -1.0), "said_up": (2, 1, -0.5, -2.0), "said_down": (1, 1, 0.25, 0.25)
    }
    costs = {r.cost_bps: r for r in O.cost_scenarios(d).where("cohort = 'live'").collect()}
    assert (costs[50].sum_pct, costs[50].mean_pct, costs[50].break_even_bps) == (-2.75, -0.916667, -41.666667)
    lines = {(r.dimension, r.value): (r.signals, r.observations) for r in O.breakdowns(d).collect()}
    assert (lines["horizon", "4h"], lines["horizon", "1d"], lines["direction", "neutral"], lines["ticker", "B"], lines["confidence", "70-80%"]) == ((5, 3), (5, 0), (1, 0), (2, 1), (5, 3))
    assert len(O.export_columns(d, "market", "x").columns) == 48


def test_interval_of_nothing_is_null(spark):
    low, high = wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (0, 4), (4, 4)], "k long, n long").select(low, high).collect()
    assert [r[0] is None for r in got] == [True, False, False] and got[0][1] is None and got[1][0] == 0.0 and got[2][1] == 1.0


def test_expiry_is_rewritten(spark):
    rows = [(1, "active", at(1)), (2, "active", at(3)), (3, "withdrawn", at(1)), (4, "active", None), (5, "active", at(2)), (6, None, at(1))]
    df = expire(spark.createDataFrame(rows, "id long, status string, expires_at timestamp_ntz"), F.lit(at(2)).cast("timestamp_ntz"))
    assert {r.id: r.status for r in df.collect()} == {1: "expired", 2: "active", 3: "withdrawn", 4: "active", 5: "expired", 6: None}
