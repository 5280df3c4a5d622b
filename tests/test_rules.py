"""Known answers of the text rules, each a trap of its own."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions.rules import Instrument, alias_pattern, facts, financial_polarity, first_rule, headline_and_publisher, mentions, named_in, tense, term_polarity
from eventloom.operators.asof import asof_goals
from eventloom.plans.news_ops import BODIES


@pytest.mark.parametrize(
    "text, answer",
    [
        ("Net profit grew 12% to 3.4 bln usd", 1), ("Profit fell 3%", -1), ("Net loss narrowed 30%", 1), ("Loss widened 5%", -1), ("Costs rose 8% and revenue fell 5%", -1), ("Profit grew 10% but debt rose 20%", 0),
        ("Profit did not grow 5%", 0), ("We expect profit growth of 15%", 0), ("A year earlier profit fell 40%", None), ("Dividend of 7% approved", None), ("The firm posted a loss of 2,1 mln usd", -1),
        ("Profit rose 6% amid growth of its clients", 1), ("Profit reached 6 mln usd amid growth of sales", 0), ("Profit of 6 mln usd on sales growth", 0), ("Revenue rose 9%. The result is worse than forecast", 0),
        ("Revenue rose 9%. That is better than forecast", 1), ("Profit grew", None), ("Revenue fell 5% compared with last year", -1), ("Profit fell 5% last year", 0), ("Growth of profit was 5%", 1), ("Debt of clients rose 5%", 0),
        ("Profit stood at 5 mln usd, it rose 3%", 0), ("Profit rose 2,5 %; margin 3 usd.\nRevenue increased 4%", 1), ("", None), ("Nothing here", None), ("Profit rose 3% and fell 2%", 1),
    ],
)
def test_financial_polarity(spark, text, answer):
    assert spark.createDataFrame([(text,)], "t string").select(financial_polarity(F.col("t"))).first()[0] == answer


def test_readings_of_the_bodies(spark):
    got = spark.createDataFrame([(n, b) for n, (b, _) in enumerate(BODIES)], "n int, t string").select("n", financial_polarity(F.col("t")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {n: p for n, (_, p) in enumerate(BODIES)}
    assert spark.range(1).select(financial_polarity(F.lit(None).cast("string"))).first()[0] is None


def test_names_in_their_cases(spark):
    rows = [("доля северстали растёт", True), ("о северсталью.", True), ("СЕВЕРСТАЛЬ", True), ("северсталькомплект", False), ("несеверсталь", False), ("", False)]
    got = spark.createDataFrame(rows, "t string, y boolean").select("y", named_in(F.lower("t"), ("Северсталь",)).alias("x")).collect()
    assert [r.x for r in got] == [r.y for r in got]
    assert alias_pattern("банк") == "банк"  # short words take no endings


def test_mentions_by_place_and_parent(spark):
    names = [Instrument("P", ("Alfa",), ("maker",)), Instrument("C", ("Alfa Energo",), (), "energy", "P"), Instrument("B", ("Borneo",), ("maker",))]
    rows = [("Alfa rises", "Borneo"), ("maker", "Borneo and alfa"), ("Alfa Energo", "Alfa"), ("x", "nothing"), ("alfabet", "borneos")]
    got = spark.createDataFrame(rows, "title string, body string").select(mentions(F.col("title"), F.col("body"), names).alias("m")).collect()
    assert [[(x.ticker, x.relevance) for x in r.m] for r in got] == [[("P", 0.96), ("B", 0.78)], [("B", 0.84), ("P", 0.84)], [("C", 0.96)], [], []]
    most = spark.createDataFrame(rows, "title string, body string").select(F.size(mentions(F.col("title"), F.col("body"), names, 1)).alias("n")).collect()
    assert [r.n for r in most] == [1, 1, 1, 0, 0]


def test_facts_publisher_type_tense(spark):
    df = spark.createDataFrame([("Up 3,5 % today. Paid 2 mln usd and 4%! " + "x 1% " * 30, "Head - line — tass.example.com"), ("none", "Head - line - somebody"), ("", "Head — Daily  Voice")], "t string, title string")
    head, publisher = headline_and_publisher(F.col("title"), ("daily voice",))
    kind, weight = first_rule(F.col("t"), [("a", 0.9, ("paid", "mln")), ("b", 0.7, ("today",))])
    r = df.select(facts(F.col("t")).alias("f"), head.alias("h"), publisher.alias("p"), kind.alias("k"), weight.alias("w"), tense(F.col("t"), ("today",), ("paid",)).alias("s"), term_polarity(F.col("t"), ("today", "to"), ("x",)).alias("v")).collect()
    assert [(x.kind, x.value) for x in r[0].f[:3]] == [("percentage", "3.5"), ("percentage", "4"), ("money", "2 mln usd")] and len(r[0].f) == 20 and r[0].f[0].quote == "Up 3,5 % today"
    assert [(x.h, x.p) for x in r] == [("Head - line", "tass.example.com"), ("Head - line - somebody", None), ("Head", "Daily  Voice")]
    assert [(x.k, x.w, x.s) for x in r] == [("a", 0.9, "future"), ("other", 0.35, "current"), ("other", 0.35, "current")]
    assert r[0].v == (2 - 30) / 32 and r[2].v == 0


def test_unusable_prices_are_no_bars(spark, tmp_path):
    from eventloom.sources.fixtures import bars, benchmark_bars

    rows = [(1, "2024-01-01 00:00:00", 1, "a", 0.0, "{}"), (2, "2024-01-01 00:01:00", 1, "a", None, "{}"), (3, "2024-01-01 00:02:00", 1, "a", float("nan"), "{}"), (4, "2024-01-01 00:03:00", 1, "a", float("inf"), "{}"), (5, "2024-01-01 00:04:00", 1, "a", 2.0, "{}"), (6, "2024-01-01 00:05:00", 1, "a", -1.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    assert [r.bar_id for r in bars(spark, str(tmp_path)).collect()] == [5] and [r.open for r in benchmark_bars(spark, str(tmp_path)).collect()] == [2.0]


def test_several_goals_in_one_pass(spark):
    prices = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("a", 30, 3.0), ("b", 15, 9.0)], "k string, s int, v double").withColumn("at", F.timestamp_seconds("s"))
    asks = spark.createDataFrame([(1, "a", 20, 100), (2, "b", 14, 16), (3, "c", 1, 1), (4, "a", None, 31)], "id long, k string, x int, y int").withColumns({"tx": F.timestamp_seconds("x"), "ty": F.timestamp_seconds("y")})
    got = {r.id: (r.p, r.q) for r in asof_goals(asks, "id", prices, ["k"], "at", "v", {"p": ("tx", 5), "q": ("ty", 50)}, forward=False).collect()}
    assert got == {1: (2.0, None), 2: (None, 9.0), 3: (None, None), 4: (None, 3.0)}
