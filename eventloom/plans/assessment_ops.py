"""Assessments over the instruments that event types and users make up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.assessments import assess, market_state
from ..sources.fixtures import priced, signals, table
from .registry import query
from .signal_ops import NOW, keep_latest

#: Terms of good and bad reports in the given prose, and the mark of a report.
GOOD, BAD, MARK = ("tion", "and", "ung"), ("ment", "der ", "eau"), "the"

_CLIP = "CASE WHEN {x} IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"  # null stays null


@query("assessments", f""", i AS (SELECT event_type || '-' || (user_id % 40) AS ticker, event_id, ts, value FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL), dl AS (SELECT ticker, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(CAST(round(value * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS worth FROM i WHERE value > 0 AND value < CAST('inf' AS DOUBLE) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS n, ln(close / lead(close) OVER (PARTITION BY ticker ORDER BY day DESC)) AS lr FROM dl), px AS (SELECT * REPLACE (CASE WHEN n <= 21 THEN lr END AS lr) FROM rk WHERE n <= 22),
mk AS (SELECT ticker, max(day) AS day, max(close) FILTER (n = 1) AS last, (max(close) FILTER (n = 1) / max(close) FILTER (n = 2) - 1) * 100 AS one, (max(close) FILTER (n = 1) / max(close) FILTER (n = 6) - 1) * 100 AS five, CASE WHEN count(lr) >= 2 THEN stddev_samp(lr) * 100 END AS vol,
  CASE WHEN max(worth) FILTER (n = 1) >= 5000 THEN 'sufficient' ELSE 'limited' END AS liquidity, max(volume) FILTER (n = 1) / median(volume) FILTER (n BETWEEN 2 AND 21) AS ratio FROM px GROUP BY ticker),
rp AS (SELECT ticker, arg_max(b, (ts, doc_id)) AS balance, arg_max(doc_id, (ts, doc_id)) AS report_id FROM (SELECT i.ticker, i.ts, d.doc_id, {' + '.join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in GOOD)} - {' - '.join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in BAD)} AS b FROM documents d JOIN i ON i.event_id = d.doc_id * 4 WHERE contains(lower(text), '{MARK}')) GROUP BY ticker),
ac AS (SELECT i.ticker, arg_max(signal_id, (ts, event_id)) AS signal_id FROM i JOIN sig ON event_id = signal_id WHERE ts <= {NOW} AND ts > {NOW} - INTERVAL 3 DAY GROUP BY i.ticker), sg AS (SELECT ac.ticker, s.signal_id, s.direction AS said, CAST(round(score * 100) AS BIGINT) AS sh, CAST(round(confidence * 100) AS BIGINT) AS ch FROM ac JOIN sig s ON ac.signal_id = s.signal_id),
x AS (SELECT q.ticker AS t, q.known, mk.* EXCLUDE (ticker), rp.* EXCLUDE (ticker), sg.* EXCLUDE (ticker), coalesce(one, 0) * 0.55::DOUBLE + coalesce(five, 0) * 0.45::DOUBLE AS reaction FROM (SELECT DISTINCT ticker, true AS known FROM i UNION ALL SELECT 'absent', false) q LEFT JOIN mk ON q.ticker = mk.ticker LEFT JOIN rp ON q.ticker = rp.ticker LEFT JOIN sg ON q.ticker = sg.ticker),
y AS (SELECT *, CAST(round(({_CLIP.format(lo='-40::DOUBLE', hi='40::DOUBLE', x='coalesce(one, 0) / 3 * 20 + coalesce(five, 0) / 6 * 20')}) * 100) AS BIGINT) AS ph, coalesce(CAST(round(sign(reaction) * 15 * ({_CLIP.format(lo='0::DOUBLE', hi='1::DOUBLE', x='(ratio - 1) / 1.5::DOUBLE')}) * 100) AS BIGINT), 0) AS vh, coalesce({_CLIP.format(lo=-2000, hi=2000, x='balance * 700')}, 0) AS rh,
  CAST(round({_CLIP.format(lo='25::DOUBLE', hi='85::DOUBLE', x="40 + 6 * ((one IS NOT NULL OR five IS NOT NULL)::INT + (ratio IS NOT NULL)::INT + (vol IS NOT NULL)::INT + 1 + (balance IS NOT NULL)::INT) + CASE liquidity WHEN 'sufficient' THEN 8 ELSE -8 END - CASE WHEN vol > 4 THEN least((vol - 4) * 2.5::DOUBLE, 12) ELSE 0 END")}) AS BIGINT) AS qc FROM x),
z AS (SELECT *, ph + vh + rh AS qh, signal_id IS NOT NULL AS hybrid, CASE WHEN NOT known THEN 'INSTRUMENT_NOT_FOUND' WHEN last IS NULL THEN 'MARKET_DATA_UNAVAILABLE' END AS error FROM y),
f AS (SELECT *, CASE WHEN hybrid THEN CAST(round((sh * 65 + qh * 35) / CAST(100 AS DOUBLE)) AS BIGINT) ELSE qh END AS score_h, CASE WHEN hybrid THEN CAST(round((ch * 65 + qc * 35) / CAST(100 AS DOUBLE)) AS BIGINT) ELSE qc END AS sure_h FROM z),
o AS (SELECT *, CASE WHEN said IN ('up', 'down') AND score_h >= 1800 THEN 'up' WHEN said IN ('up', 'down') AND score_h <= -1800 THEN 'down' ELSE 'neutral' END AS way FROM f WHERE error IS NULL)
SELECT t AS ticker, NULL AS error, strftime(day, '%Y-%m-%d') AS as_of, last AS last_price, round(reaction * 100) / 100 AS reaction_pct, round(ratio * 100) / 100 AS volume_ratio, round(vol * 100) / 100 AS volatility_pct, liquidity, balance AS report_balance, report_id, CASE WHEN hybrid THEN round(ph * 35 / CAST(100 AS DOUBLE)) ELSE ph END / 100 AS price_part,
  CASE WHEN hybrid THEN round(vh * 35 / CAST(100 AS DOUBLE)) ELSE vh END / 100 AS volume_part, CASE WHEN hybrid THEN round(rh * 35 / CAST(100 AS DOUBLE)) ELSE rh END / 100 AS report_part, round(sh * 65 / CAST(100 AS DOUBLE)) / 100 AS signal_part, signal_id, CASE WHEN hybrid THEN 'hybrid' ELSE 'quant' END AS assessment_type,
  qh / CAST(100 AS DOUBLE) AS market_score, qc / CAST(100 AS DOUBLE) AS market_confidence, CASE WHEN qh >= 500 THEN 'up' WHEN qh <= -500 THEN 'down' ELSE 'neutral' END AS market_bias, score_h / CAST(100 AS DOUBLE) AS score, sure_h / CAST(100 AS DOUBLE) AS confidence, way AS direction,
  CASE WHEN score_h >= 500 THEN 'up' WHEN score_h <= -500 THEN 'down' ELSE 'neutral' END AS bias_direction, CASE way WHEN 'up' THEN 'consider_buy' WHEN 'down' THEN 'review_position' ELSE 'no_action' END AS action, CASE WHEN hybrid THEN CASE WHEN qh * sh > 0 THEN 'confirms' ELSE 'differs' END END AS agreement FROM o
UNION ALL SELECT t, error, {', '.join(['NULL'] * 23)} FROM z WHERE error IS NOT NULL""")
def assessments(spark, d):
    """Every factor, the mix with the active signal, direction, bias and action; errors for instruments that lack data."""
    name = F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 40).cast("string"))
    own = table(spark, d, "events").select(name.alias("ticker"), "event_id", "ts", "value").where("ticker IS NOT NULL")
    daily = own.where(priced()).groupBy("ticker", F.to_date(F.col("ts") + F.expr("INTERVAL '3' HOUR")).alias("day")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume"), (F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("value")
    )
    text = F.lower("text")
    balance = sum(text.contains(t).cast("int") for t in GOOD) - sum(text.contains(t).cast("int") for t in BAD)
    told = table(spark, d, "documents").where(text.contains(MARK)).select((F.col("doc_id") * 4).alias("event_id"), F.col("doc_id").alias("news_id"), balance.alias("balance"))
    reports = own.join(told, "event_id").select("ticker", F.col("ts").alias("published_at"), "news_id", "balance")
    now = F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    fresh = own.where((F.col("ts") <= now) & (F.col("ts") > now - F.expr("INTERVAL '3' DAY"))).select("ticker", "ts", F.col("event_id").alias("signal_id"))
    active = keep_latest(fresh, ["ticker"], ["ts", "signal_id"]).select("ticker", "signal_id").join(signals(spark, d).drop("ticker"), "signal_id")
    instruments = own.select("ticker").distinct()
    requested = instruments.unionByName(spark.createDataFrame([("absent",)], "ticker string"))
    out = assess(requested, instruments, market_state(daily), reports, active)
    return out.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))
