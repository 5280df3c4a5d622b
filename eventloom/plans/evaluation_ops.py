"""Outcomes of signals and the reports over them: cohorts, exclusions, breakdowns, payoffs, costs, and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..sources.fixtures import bars, signals, table
from .gate_ops import now
from .registry import query
from .signal_ops import NOW

METHOD = "market-outcome-1"

_AFTER = ", ".join(f"entry_at + INTERVAL {n} HOUR AS target_{h}" for h, n in O.HORIZONS.items())
_SEEN = "".join(f", s_{h} AS (SELECT x.*, b.at AS seen_{h}_at, b.open AS seen_{h} FROM {before} x ASOF LEFT JOIN bars b ON x.ticker = b.ticker AND x.target_{h} <= b.at)" for h, before in zip(O.HORIZONS, ["tg", *[f"s_{h}" for h in O.HORIZONS]]))
_BP = ", ".join(f"CASE WHEN seen_{h}_at <= target_{h} + INTERVAL 20 MINUTE THEN CAST(round((seen_{h} / entry - 1) * 10000) AS BIGINT) END AS bp_{h}, coalesce(seen_{h}_at > target_{h} + INTERVAL 20 MINUTE, false) AS untimely_{h}" for h in O.HORIZONS)

#: Each outcome, from signals that quarter documents' ids: four signals in a row share one document as their evidence.
DONE = f""", news AS (SELECT d.doc_id AS news_id, d.source AS source_id, 'https://news.example/' || d.doc_id AS url, e.ts + (d.n_chars % 7) * INTERVAL 1 MINUTE AS published_at, e.ts + (d.n_chars % 7) * INTERVAL 1 MINUTE + (d.n_chars % 40) * INTERVAL 30 SECOND AS received_at FROM documents d JOIN events e ON e.event_id = d.doc_id * 4),
sg AS (SELECT * EXCLUDE (decision_at, model), decision_at AS as_of, decision_at + (k % 4) * INTERVAL 1 MINUTE AS cutoff, decision_at + (20 * k - CAST(k = 0 AS INTEGER)) * INTERVAL 1 SECOND AS created, signal_id // 4 AS nid, 'm' || model AS model_version, 'c' || (k % 2) AS config_version FROM sig),
rs AS (SELECT *, greatest(as_of, cutoff) AS known, count(*) OVER (PARTITION BY ticker, nid) AS copies, CASE WHEN as_of IS NULL OR cutoff IS NULL OR created IS NULL THEN 'missing_time' WHEN as_of > created THEN 'signal_as_of_after_creation' WHEN cutoff > created THEN 'data_cutoff_after_creation' WHEN news_id IS NULL THEN 'missing_evidence'
  WHEN published_at > created THEN 'evidence_published_after_signal' WHEN received_at > created THEN 'evidence_received_after_signal' WHEN created > greatest(as_of, cutoff) + INTERVAL 15 MINUTE THEN 'retrospective_signal' END AS reason FROM sg LEFT JOIN news ON nid = news_id),
el AS (SELECT *, CASE WHEN reason IS NULL THEN 'live' ELSE 'retrospective' END AS cohort, greatest(known, created) AS live_at, CASE WHEN reason IS NOT NULL AND news_id IS NOT NULL THEN greatest(known, received_at) ELSE greatest(known, created) END AS decision_at FROM rs),
en AS (SELECT s.*, b.at AS entry_at, b.open AS entry FROM el s ASOF LEFT JOIN bars b ON s.ticker = b.ticker AND s.decision_at < b.at),
tg AS (SELECT en.*, {_AFTER}, CASE WHEN entry IS NOT NULL THEN latest END AS latest FROM en LEFT JOIN (SELECT ticker, arg_max(open, bars.at) AS latest FROM bars GROUP BY ticker) l ON en.ticker = l.ticker){_SEEN},
bp AS (SELECT *, {_BP} FROM s_3d),
st AS (SELECT *, coalesce(bp_4h, bp_1h) AS bp, CASE WHEN entry IS NULL THEN 'unavailable' WHEN bp_3d IS NOT NULL THEN 'evaluated' ELSE 'partial' END AS status, CASE WHEN entry IS NULL THEN 'unavailable' WHEN untimely_1h OR untimely_4h OR {NOW} > target_1h + INTERVAL 20 MINUTE THEN 'missed_window' ELSE 'pending' END AS unsettled FROM bp),
done AS (SELECT *, CASE direction WHEN 'up' THEN bp > 0 WHEN 'down' THEN bp < 0 END AS verdict, CASE WHEN direction = 'neutral' THEN 'not_applicable' WHEN bp IS NOT NULL THEN 'evaluated' ELSE unsettled END AS verdict_status,
  CASE WHEN direction <> 'neutral' THEN NULL WHEN bp IS NULL THEN unsettled WHEN abs(bp) < 50 THEN 'quiet' ELSE 'material_move' END AS neutral_move_status, bp_3d IS NOT NULL OR coalesce({NOW} > target_3d + INTERVAL 20 MINUTE, false) AS outcome_terminal, CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 END AS sign FROM st)"""


def done(spark, d) -> DataFrame:
    """Outcomes of the given events as signals, with documents as their evidence."""
    s = signals(spark, d)
    k = F.col("k")
    s = s.select(
        "signal_id", "ticker", F.col("decision_at").alias("as_of"), (F.col("decision_at") + F.make_dt_interval(mins=k % 4)).alias("data_cutoff_at"),
        (F.col("decision_at") + F.make_dt_interval(secs=20 * k - (k == 0).cast("int"))).alias("created_at"), F.floor(F.col("signal_id") / 4).alias("news_id"), "direction", "score", "confidence",
        F.concat(F.lit("m"), F.col("model").cast("string")).alias("model_version"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("config_version"),
    )
    first = table(spark, d, "events").select((F.col("event_id") / 4).alias("q"), "ts").where("q = floor(q)").select(F.floor("q").alias("news_id"), "ts")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("news_id"), "source", "n_chars").join(first, "news_id")
    chars = lambda n: (F.col("n_chars") % n).cast("int")
    published = F.col("ts") + F.make_dt_interval(mins=chars(7))
    news = docs.select("news_id", F.col("source").alias("source_id"), F.concat(F.lit("https://news.example/"), F.col("news_id").cast("string")).alias("url"), published.alias("published_at"), (published + F.make_dt_interval(secs=chars(40) * 30)).alias("received_at"))
    return O.outcomes(s, news, bars(spark, d).withColumn("close", F.col("open")), now())


_R = "round(1000.0 * count(*) FILTER (sign * {r} > 0) / nullif(count(sign * {r}), 0)) / 10 AS hit_rate_pct, round(sum(sign * {r}) / CAST(count(sign * {r}) AS DOUBLE)) / 100 AS average_signed_return_pct, round(median(sign * {r})) / 100 AS median_signed_return_pct"
COHORT = f"""SELECT c.cohort, count(signal_id) AS signals_total, count(sign) AS directional_signals, count(*) FILTER (direction = 'neutral') AS neutral_signals, count(*) FILTER (direction = 'neutral') AS not_applicable, count(verdict) AS evaluated,
  count(*) FILTER (status = 'evaluated') AS complete, count(*) FILTER (status = 'partial' AND verdict IS NOT NULL) AS partial, count(*) FILTER (verdict_status = 'pending') AS pending, count(*) FILTER (verdict_status = 'missed_window') AS missed_window,
  count(*) FILTER (verdict_status = 'unavailable') AS unavailable, {_R.format(r='bp')}, coalesce(round(1000.0 * count(verdict) / nullif(count(sign), 0)) / 10, 0) AS coverage_pct, 'directional_up_down_only_v1' AS quality_methodology
  FROM (SELECT unnest(['all', 'live', 'retrospective']) AS cohort) c LEFT JOIN done ON c.cohort IN ('all', done.cohort) GROUP BY c.cohort"""


@query("eval_summary", DONE + " " + COHORT)
def eval_summary(spark, d):
    """A4: counts by state, rates and coverage of each cohort and of all."""
    return O.cohort_summary(done(spark, d))


@query("eval_headline", DONE + f""", q AS ({COHORT}) SELECT 'live' AS metric_scope, l.hit_rate_pct, l.average_signed_return_pct, l.median_signed_return_pct, l.coverage_pct, l.signals_total AS live_eligible, r.signals_total AS research_only,
  l.evaluated AS live_evaluated, r.evaluated AS research_evaluated, l.coverage_pct AS live_coverage_pct, r.coverage_pct AS research_coverage_pct FROM q l, q r WHERE l.cohort = 'live' AND r.cohort = 'retrospective'""")
def eval_headline(spark, d):
    """A4: the live cohort's rates beside both cohorts' sizes."""
    return O.headline(done(spark, d))


@query("eval_exclusions", DONE + " SELECT reason, count(*) AS n FROM done WHERE reason IS NOT NULL GROUP BY reason")
def eval_exclusions(spark, d):
    """A4: retrospective outcomes by reason."""
    return O.exclusions(done(spark, d))


_BAND = "CASE WHEN confidence < 0.6 THEN '<60%' WHEN confidence < 0.7 THEN '60-70%' WHEN confidence < 0.8 THEN '70-80%' WHEN confidence < 1.01 THEN '>=80%' END"
_PARTS = [(f"SELECT 'horizon' AS dimension, '{h}' AS value, bp_{h} AS r, * FROM done") for h in O.HORIZONS] + [f"SELECT '{n}', {v}, bp, * FROM done" for n, v in (("direction", "direction"), ("ticker", "ticker"), ("confidence", _BAND))]
_GRID = ", ".join(f"('{n}', '{v}')" for n, vs in (("horizon", O.HORIZONS), ("direction", ("up", "down", "neutral")), ("confidence", O.BANDS)) for v in vs)


@query("eval_breakdowns", DONE + f""", p AS ({' UNION ALL '.join(_PARTS)}), g AS (SELECT * FROM (VALUES {_GRID}) v(dimension, value) UNION SELECT DISTINCT 'ticker', ticker FROM done WHERE ticker IS NOT NULL)
SELECT g.dimension, g.value, count(signal_id) AS signals, count(sign) AS directional_signals, count(*) FILTER (direction = 'neutral') AS neutral_signals, count(sign * r) AS observations, {_R.format(r='r')} FROM g LEFT JOIN p ON g.dimension = p.dimension AND g.value = p.value GROUP BY ALL""")
def eval_breakdowns(spark, d):
    """A5: the metric slice by horizon, direction, ticker and band of confidence."""
    return O.breakdowns(done(spark, d))


_ARMS = "unnest([cohort, 'all']) AS cohort, * EXCLUDE (cohort) FROM done WHERE sign IS NOT NULL AND bp_4h IS NOT NULL"


@query("production_metrics", DONE + f""", q AS (SELECT {_ARMS}), a AS (SELECT cohort, unnest(['system', 'always_up', 'always_down', 'said_up', 'said_down']) AS arm, unnest([sign * bp_4h, bp_4h, -bp_4h, CASE WHEN sign = 1 THEN bp_4h END, CASE WHEN sign = -1 THEN bp_4h END]) AS v FROM q),
g AS (SELECT cohort, arm, count(v) AS n, count(*) FILTER (v > 0) AS hits, sum(v) AS total, median(v) AS mid, min(v) AS low, max(v) AS high, 1.959963984540054 AS z FROM a WHERE v IS NOT NULL GROUP BY cohort, arm), p AS (SELECT *, hits / CAST(n AS DOUBLE) AS p, z * z AS zz FROM g),
w AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS c, z * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n) AS h FROM p)
SELECT cohort, arm, n AS observations, hits, round(1000.0 * hits / n) / 10 AS hit_rate_pct, round(greatest(c - h, 0) * 100, 4) AS wilson_low_pct, round(least(c + h, 1) * 100, 4) AS wilson_high_pct, round(total / CAST(n AS DOUBLE) / 100, 6) AS mean_pct, mid / 100 AS median_pct, low / CAST(100 AS DOUBLE) AS minimum_pct, high / CAST(100 AS DOUBLE) AS maximum_pct FROM w""")
def production_metrics(spark, d):
    """The system beside its controls, with intervals and payoffs, by cohort."""
    return O.payoffs(done(spark, d))


@query("cost_scenarios", DONE + f""", q AS (SELECT {_ARMS}), g AS (SELECT cohort, count(*) AS n, sum(sign * bp_4h) AS total, stddev_samp(sign * bp_4h) AS spread FROM q GROUP BY cohort), c AS (SELECT *, total / CAST(n AS DOUBLE) - cost_bps AS mean FROM g, (SELECT unnest([0, 10, 25, 50]) AS cost_bps))
SELECT cohort, CAST(cost_bps AS INTEGER) AS cost_bps, n AS observations, CAST(total - n * cost_bps AS DOUBLE) / 100 AS sum_pct, round(mean / 100, 6) AS mean_pct, round(mean / nullif(spread, 0), 6) AS event_sharpe, round(total / CAST(n AS DOUBLE), 6) AS break_even_bps FROM c""")
def cost_scenarios(spark, d):
    """Sums, means and event Sharpe after four costs, and the cost that breaks even."""
    return O.cost_scenarios(done(spark, d))


def _rfc(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _lag(late: str, early: str) -> str:
    return f"CAST(round((epoch_us({late}) - epoch_us({early})) / CAST(1000000 AS DOUBLE)) AS BIGINT)"


_WIDE = [f"{_rfc(c)} AS {name}" for c, name in (("as_of", "signal_as_of"), ("cutoff", "signal_data_cutoff_at"), ("created", "signal_created_at"), ("decision_at", "decision_at"), ("live_at", "live_decision_at"), ("published_at", "news_published_at"), ("received_at", "news_received_at"), ("entry_at", "entry_at"))]
_WIDE += [x for h in O.HORIZONS for x in (f"bp_{h} / CAST(100 AS DOUBLE) AS return_{h}_pct", f"{_rfc(f'seen_{h}_at')} AS observed_{h}_at", f"{_lag(f'seen_{h}_at', f'target_{h}')} AS observation_{h}_delay_seconds")]


@query("export_outcomes", DONE + f""" SELECT signal_id, ticker, CASE WHEN reason IS NOT NULL AND news_id IS NOT NULL THEN 'evidence_cutoff_replay' ELSE 'live_decision' END AS evaluation_anchor, CASE WHEN created IS NOT NULL AND known IS NOT NULL THEN greatest(0, {_lag('created', 'known')}) END AS processing_lag_seconds, '{METHOD}' AS evaluation_methodology,
reason IS NULL AS evaluation_eligible, reason AS exclusion_reason, cohort AS eligibility_cohort, direction, score, confidence, model_version, config_version, 'market' AS evaluation_benchmark, status, nid AS news_id, source_id AS news_source_id, url AS news_url,
CASE WHEN news_id IS NOT NULL THEN greatest(0, {_lag('received_at', 'published_at')}) END AS delivery_lag_seconds, round(entry, 4) AS entry_price, {_lag('entry_at', 'decision_at')} AS entry_delay_seconds, round(latest, 4) AS latest_price, CAST(round((latest / entry - 1) * 10000) AS BIGINT) / CAST(100 AS DOUBLE) AS latest_return_pct,
verdict, verdict_status, neutral_move_status, outcome_terminal, copies AS raw_observation_count, {', '.join(_WIDE)} FROM done""")
def export_outcomes(spark, d):
    """The full flat row of an outcome, which the CSV and JSON sinks write."""
    return O.export_columns(done(spark, d), "market", METHOD)
