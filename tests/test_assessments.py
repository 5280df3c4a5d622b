"""Assessments on planted days, each worked out by hand."""

import datetime as dt

from eventloom.operators.assessments import assess, market_state

DAILY = "ticker string, day date, close double, volume long, value double"
REPORTS = "ticker string, published_at timestamp_ntz, news_id long, balance int"
ACTIVE = "ticker string, signal_id long, direction string, score double, confidence double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def frame(spark, daily, reports=(), active=(), tickers=("A",), known=None):
    of = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    names = lambda ts: of([(t,) for t in ts], "ticker string")
    out = assess(names(tickers), names(known if known is not None else tickers), market_state(of(daily, DAILY)), of(reports, REPORTS), of(active, ACTIVE))
    return {r.ticker: r for r in out.collect()}


#: Seven days at 100, a last one at 103 with four times the volume.
CALM = [("A", day(n), 100.0, 10, 9000.0) for n in range(7)] + [("A", day(7), 103.0, 40, 9000.0)]


def test_market_alone(spark):
    a = frame(spark, CALM)["A"]
    # one day and five days of 3 %: 20 + 10 of price, full volume under a rise; of the five factors only the report is missing
    assert (a.price_part, a.volume_part, a.report_part, a.score, a.assessment_type) == (30.0, 15.0, 0.0, 45.0, "quant")
    assert (a.confidence, a.direction, a.bias_direction, a.action, a.volume_ratio, a.reaction_pct) == (0.72, "neutral", "up", "no_action", 4.0, 3.0)


def test_signal_and_report(spark):
    reports = [("A", dt.datetime(2024, 1, 2), 1, 3), ("A", dt.datetime(2024, 1, 3), 2, -9), ("A", dt.datetime(2024, 1, 3), 1, 1), ("A", None, 9, 5), ("A", dt.datetime(2025, 1, 1), 3, None)]
    a = frame(spark, CALM, reports, [("A", 7, "up", 50.0, 0.9)])["A"]
    assert (a.report_balance, a.report_id, a.market_score, a.market_confidence) == (-9, 2, 25.0, 0.78)  # -63 is cut to -20
    assert (a.score, a.confidence, a.signal_part, a.report_part, a.price_part) == (41.25, 0.86, 32.5, -7.0, 10.5)
    assert (a.direction, a.action, a.agreement, a.assessment_type) == ("up", "consider_buy", "confirms", "hybrid")
    down = frame(spark, CALM, [], [("A", 7, "down", -80.0, 0.9)])["A"]
    assert (down.score, down.direction, down.action, down.agreement) == (-36.25, "down", "review_position", "differs")
    assert frame(spark, CALM, [], [("A", 7, "neutral", 80.0, 0.9)])["A"].direction == "neutral"


def test_errors_and_few_days(spark):
    rows = [("B", day(0), 10.0, None, None), ("C", day(0), None, 5, 1.0), ("D", None, 10.0, 5, 1.0), ("E", day(0), 10.0, 0, 10.0), ("E", day(1), 5.0, 0, 10.0)]
    got = frame(spark, rows, tickers=("B", "C", "D", "E", "X"), known=("B", "C", "D", "E"))
    assert {t: r.error for t, r in got.items()} == {"B": None, "C": "MARKET_DATA_UNAVAILABLE", "D": "MARKET_DATA_UNAVAILABLE", "E": None, "X": "INSTRUMENT_NOT_FOUND"}
    assert (got["B"].score, got["B"].confidence, got["B"].liquidity, got["B"].reaction_pct, got["X"].score) == (0.0, 0.4, "unavailable", 0.0, None)
    assert (got["E"].price_part, got["E"].volume_part, got["E"].volume_ratio, got["E"].volatility_pct, got["E"].confidence) == (-40.0, 0.0, None, None, 0.44)
    assert frame(spark, [], tickers=(), known=()) == {}


def test_only_the_last_days_count(spark):
    old = [("A", day(-n), 1.0, 10_000, 1.0) for n in range(20, 40)]
    recent = [("A", day(n), 100.0 + n % 2, 10, 9000.0) for n in range(21)]
    assert frame(spark, old + recent)["A"] == frame(spark, [("A", day(-20), 1.0, 10_000, 1.0)] + recent)["A"]
