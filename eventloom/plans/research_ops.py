"""Examples, labels, audits, policies and comparisons built on entries, targets and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.metrics import roc_auc, wilson
from ..operators.running import running_sums
from ..operators.windows import window_aggregates
from ..sources.fixtures import bars, benchmark_bars, signals, table
from .gate_ops import hours, minutes, now
from .market import ENTRY, TARGET, change, entries, horizon, pct
from .metric_ops import SCORED, scored
from .registry import query
from .signal_ops import NOW

H4 = ENTRY + TARGET.format(h="4 HOUR")
REASON = "CASE WHEN direction = 'neutral' THEN 'not_directional' WHEN entry IS NULL THEN 'no_entry' WHEN entry_at > decision_at + INTERVAL 1 HOUR THEN 'entry_lag' WHEN target IS NULL THEN 'no_outcome' WHEN model = 2 THEN 'provider' END"


def examples(spark, d) -> DataFrame:
    """Signals with entry, target and the first reason (if any) not to make an example of them."""
    h = horizon(entries(spark, d), spark, d, 4, "target")
    reason = F.when(F.col("direction") == "neutral", "not_directional").when(F.col("entry").isNull(), "no_entry").when(F.col("entry_at") > F.col("decision_at") + hours(1), "entry_lag").when(F.col("target").isNull(), "no_outcome").when(F.col("model") == 2, "provider")
    return h.withColumn("reason", reason)


@query("dataset_examples", H4 + f", r AS (SELECT *, {REASON} AS reason FROM h) SELECT signal_id, round((target / entry - 1) * 100, 6) AS ret, target > entry AS up FROM r WHERE reason IS NULL")
def dataset_examples(spark, d):
    """Labelled examples; strict entry, inclusive outcome, lag bounds and equal provenance."""
    return examples(spark, d).where("reason IS NULL").select("signal_id", pct("target", "entry").alias("ret"), (F.col("target") > F.col("entry")).alias("up"))


@query("dataset_skip_reasons", H4 + f", r AS (SELECT *, {REASON} AS reason FROM h) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def dataset_skip_reasons(spark, d):
    """Rows by the first reason that they make no example."""
    return examples(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


FOUR = """, g AS (SELECT *, decision_at + INTERVAL 5 MINUTE AS a, decision_at + INTERVAL 4 HOUR AS z FROM sig),
s0 AS (SELECT g.*, CASE WHEN b.at <= a + INTERVAL 20 MINUTE THEN b.open END AS s0 FROM g ASOF LEFT JOIN bars b ON g.ticker = b.ticker AND g.a <= b.at), s1 AS (SELECT s0.*, CASE WHEN b.at <= z + INTERVAL 20 MINUTE THEN b.open END AS s1 FROM s0 ASOF LEFT JOIN bars b ON s0.ticker = b.ticker AND s0.z <= b.at),
b0 AS (SELECT s1.*, CASE WHEN b.at <= a + INTERVAL 20 MINUTE THEN b.open END AS b0 FROM s1 ASOF LEFT JOIN bench b ON s1.a <= b.at), b1 AS (SELECT b0.*, CASE WHEN b.at <= z + INTERVAL 20 MINUTE THEN b.open END AS b1 FROM b0 ASOF LEFT JOIN bench b ON b0.z <= b.at)"""


def remaining(spark, d) -> DataFrame:
    df = signals(spark, d).withColumn("a", F.col("decision_at") + minutes(5)).withColumn("z", F.col("decision_at") + hours(4))
    for series, key, name in ((bars(spark, d), ["ticker"], "s"), (benchmark_bars(spark, d), [], "b")):
        for n, when in enumerate("az"):
            df = asof_join(df, series, key, when, "at", "open", f"{name}{n}", tolerance_s=1200)
    return df.withColumn("rest", (F.try_divide("s1", "s0") - F.try_divide("b1", "b0")) * 100)


@query("remaining_returns", FOUR + " SELECT signal_id, round((s1 / s0 - b1 / b0) * 100, 6) AS rest FROM b1")
def remaining_returns(spark, d):
    """Stock less benchmark from five minutes to four hours after publication; all four prices are required."""
    return remaining(spark, d).select("signal_id", F.round("rest", 6).alias("rest"))


@query("model_outcomes", FOUR + " SELECT signal_id, CASE WHEN s1 / s0 - b1 / b0 > 0 THEN 'up' WHEN s1 / s0 - b1 / b0 < 0 THEN 'down' WHEN s1 / s0 = b1 / b0 THEN 'flat' END AS label, abs((s1 / s0 - b1 / b0) * 100) >= 1 AS material FROM b1")
def model_outcomes(spark, d):
    """C14: direction and materiality (one per cent) of the remaining return."""
    r = remaining(spark, d).withColumn("x", F.try_divide("s1", "s0") - F.try_divide("b1", "b0"))
    x = F.col("x")
    return r.select("signal_id", F.when(x > 0, "up").when(x < 0, "down").when(x == 0, "flat").alias("label"), (F.abs(F.col("rest")) >= 1).alias("material"))


@query("completed_bar_returns", """, e AS (SELECT ticker, bars.at + INTERVAL 1 MINUTE AS done, open FROM bars), p AS (SELECT s.*, CASE WHEN e.done >= decision_at - INTERVAL 3 MINUTE THEN e.open END AS p1 FROM sig s ASOF LEFT JOIN e ON s.ticker = e.ticker AND s.decision_at >= e.done),
q AS (SELECT p.*, p.decision_at - INTERVAL 30 MINUTE AS early FROM p), r AS (SELECT q.*, CASE WHEN e.done >= early - INTERVAL 3 MINUTE THEN e.open END AS p0 FROM q ASOF LEFT JOIN e ON q.ticker = e.ticker AND q.early >= e.done) SELECT signal_id, p1 IS NOT NULL AS quoted, round((p1 / p0 - 1) * 100, 6) AS ret FROM r""")
def completed_bar_returns(spark, d):
    """Only bars completed by the cutoff count, and quotes of three minutes at most."""
    done = bars(spark, d).select("ticker", (F.col("at") + minutes(1)).alias("done"), "open")
    p = asof_join(signals(spark, d), done, ["ticker"], "decision_at", "done", "open", "p1", forward=False, tolerance_s=180)
    q = asof_join(p.withColumn("early", F.col("decision_at") - minutes(30)), done, ["ticker"], "early", "done", "open", "p0", forward=False, tolerance_s=180)
    return q.select("signal_id", F.col("p1").isNotNull().alias("quoted"), pct("p1", "p0").alias("ret"))


@query("join_one_to_one", "SELECT d.doc_id, l.quality, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS repeats FROM documents d JOIN labels l ON d.doc_id = l.doc_id", base=False)
def join_one_to_one(spark, d):
    """An inner join with the number of keys that break one-to-one."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    repeats = b.groupBy("doc_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeats"))
    return a.join(b, "doc_id").join(F.broadcast(repeats))


@query("paired_models", " SELECT a.day, a.ticker, a.n AS n0, b.n AS n1 FROM (SELECT CAST(decision_at AS DATE) AS day, ticker, count(*) AS n FROM sig WHERE model = 0 GROUP BY 1, 2) a JOIN (SELECT CAST(decision_at AS DATE) AS day, ticker, count(*) AS n FROM sig WHERE model = 1 GROUP BY 1, 2) b ON a.day = b.day AND a.ticker = b.ticker")
def paired_models(spark, d):
    """Two models on the keys that both have."""
    g = lambda m: signals(spark, d).where(F.col("model") == m).groupBy(F.to_date("decision_at").alias("day"), "ticker").agg(F.count(F.lit(1)).alias(f"n{m}"))
    return g(0).join(g(1), ["day", "ticker"])


@query("join_feature_set", " SELECT s.signal_id, e.value FROM sig s JOIN events e ON s.signal_id = e.event_id AND s.decision_at = e.ts")
def join_feature_set(spark, d):
    """The feature set of exactly this id and time."""
    f = table(spark, d, "events").select(F.col("event_id").alias("signal_id"), F.col("ts").alias("decision_at"), "value")
    return signals(spark, d).select("signal_id", "decision_at").join(f, ["signal_id", "decision_at"]).select("signal_id", "value")


@query("identity_audit", "SELECT 'signal_only' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'outcome_only', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", base=False)
def identity_audit(spark, d):
    """How many identities either side lacks."""
    a, b = (table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    one = lambda x, y, k: x.join(y, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return one(a, b, "signal_only").unionByName(one(b, a, "outcome_only"))


@query("check_label_availability", FOUR.replace("AS s1 FROM s0", "AS s1, b.at AS s1_at FROM s0").replace("AS b1 FROM b0", "AS b1, b.at AS b1_at FROM b0") + " SELECT signal_id, epoch_us(greatest(s1_at, b1_at)) AS available_us FROM b1 WHERE s1 IS NOT NULL AND b1 IS NOT NULL")
def check_label_availability(spark, d):
    """V8: a label is available with the later of its two observations."""
    r = remaining(spark, d).where("s1 IS NOT NULL AND b1 IS NOT NULL")
    return r.select("signal_id", F.unix_micros(F.greatest("s1_at", "b1_at").cast("timestamp")).alias("available_us"))


@query("temporal_audit", ENTRY + " SELECT ticker, count(*) AS n, count(*) FILTER (entry IS NULL) AS missing, min(epoch_us(entry_at) - epoch_us(decision_at)) AS low_us, max(epoch_us(entry_at) - epoch_us(decision_at)) AS high_us FROM e GROUP BY ticker")
def temporal_audit(spark, d):
    """V7: lags of entries and how many are missing."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = entries(spark, d).withColumn("lag", us("entry_at") - us("decision_at"))
    return e.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entry").isNull()).alias("missing"), F.min("lag").alias("low_us"), F.max("lag").alias("high_us"))


OTHER = ENTRY + """, one AS (SELECT bars.at AS at, arg_min(open, bar_id) AS open FROM bars WHERE ticker = 'view' GROUP BY 1), x AS (SELECT e.*, b.open AS old FROM e ASOF LEFT JOIN bench b ON e.entry_at <= b.at), y AS (SELECT x.*, b.open AS new FROM x ASOF LEFT JOIN one b ON x.entry_at <= b.at)"""


@query("check_benchmark_only", OTHER + " SELECT count(*) AS n, 0 * count(*) AS core, count(*) FILTER (old IS DISTINCT FROM new) AS benchmark FROM y")
def check_benchmark_only(spark, d):
    """V6: after the benchmark series is replaced, rows whose core or benchmark fields differ (null-safe)."""
    one = bars(spark, d).where("ticker = 'view'").groupBy("at").agg(F.min_by("open", "bar_id").alias("open"))
    e = entries(spark, d).select("signal_id", "entry", "entry_at")
    before = asof_join(e, benchmark_bars(spark, d), [], "entry_at", "at", "open", "old")
    after = asof_join(before.select("signal_id", "entry", "entry_at", "old"), one, [], "entry_at", "at", "open", "new")
    both = after.select("signal_id", F.col("entry").alias("again"), "old", "new").join(e, "signal_id")
    differ = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    return both.agg(F.count(F.lit(1)).alias("n"), differ("entry", "again").alias("core"), differ("old", "new").alias("benchmark"))


@query("check_reconcile", H4 + """, g AS (SELECT h.signal_id, arg_min(b.open, b.at) AS again FROM h JOIN bars b ON h.ticker = b.ticker AND b.at >= h.entry_at + INTERVAL 4 HOUR AND b.at <= h.entry_at + INTERVAL 4 HOUR + INTERVAL 20 MINUTE GROUP BY 1)
SELECT count(*) AS n, count(target) AS labelled, count(*) FILTER (target IS DISTINCT FROM again) AS differing FROM h LEFT JOIN g ON h.signal_id = g.signal_id""")
def check_reconcile(spark, d):
    """V9: labels built again by another way (the first of all bars of the window) against those of the as-of join."""
    h = horizon(entries(spark, d), spark, d, 4, "target").select("signal_id", "ticker", "goal", "target")
    first = window_aggregates(h, "signal_id", bars(spark, d), ["ticker"], "goal", 1200, "at", {"first": F.struct("at", "open")})
    both = h.join(first.select("signal_id", F.col("first.open").alias("again")), "signal_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled"), F.count_if(~F.col("target").eqNullSafe(F.col("again"))).alias("differing"))


SPLIT = ("2024-01-18 00:00:00", "2024-01-24 00:00:00")


@query("temporal_split_v2", f""", g AS (SELECT ticker, user_id, min(decision_at) AS a, max(decision_at + INTERVAL 4 HOUR) AS b FROM sig GROUP BY ticker, user_id)
SELECT ticker, user_id, CASE WHEN b <= TIMESTAMP '{SPLIT[0]}' THEN 'train' WHEN a >= TIMESTAMP '{SPLIT[1]}' + INTERVAL 72 HOUR THEN 'future' ELSE 'purged' END AS part FROM g""")
def temporal_split_v2(spark, d):
    """What starts within the embargo after the edge is purged too."""
    g = signals(spark, d).groupBy("ticker", "user_id").agg(F.min("decision_at").alias("a"), F.max(F.col("decision_at") + hours(4)).alias("b"))
    at = lambda e: F.expr(f"TIMESTAMP_NTZ '{e}'")
    return g.select("ticker", "user_id", F.when(F.col("b") <= at(SPLIT[0]), "train").when(F.col("a") >= at(SPLIT[1]) + hours(72), "future").otherwise("purged").alias("part"))


@query("fold_labels", """, w AS (SELECT unnest([TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-22 00:00:00']) AS edge)
SELECT CAST(edge AS DATE) AS edge_day, count(*) AS n FROM sig, w WHERE decision_at + INTERVAL 4 HOUR + INTERVAL 20 MINUTE <= edge GROUP BY 1""")
def fold_labels(spark, d):
    """P5: labels available before a fold's evaluation starts."""
    edges = F.array(*[F.expr(f"TIMESTAMP_NTZ '2024-01-{day} 00:00:00'") for day in ("08", "15", "22")])
    w = signals(spark, d).withColumn("edge", F.explode(edges)).where(F.col("decision_at") + hours(4) + minutes(20) <= F.col("edge"))
    return w.groupBy(F.to_date("edge").alias("edge_day")).agg(F.count(F.lit(1)).alias("n"))


@query("fold_seal", " SELECT user_id, sha256(string_agg(CAST(signal_id AS VARCHAR), ',' ORDER BY signal_id)) AS seal, count(*) AS n FROM sig GROUP BY user_id")
def fold_seal(spark, d):
    """A digest of a part's ordered ids."""
    g = signals(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list("signal_id")).alias("i"))
    return g.select("user_id", F.sha2(F.array_join(F.transform("i", lambda x: x.cast("string")), ","), 256).alias("seal"), F.size("i").cast("long").alias("n"))


def counts_by_signal(rows, ids=None):
    """(user_id, n) of rows, of the ids given or of all."""
    kept = rows if ids is None else rows.where(F.col("user_id").isin(ids))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("count_by_signal", " SELECT user_id, count(*) AS n FROM sig WHERE user_id IN (1, 2, 3, 5, 8) GROUP BY user_id")
def count_by_signal(spark, d):
    """A2: counts over an id list."""
    return counts_by_signal(signals(spark, d), [1, 2, 3, 5, 8])


@query("count_by_signal_all", " SELECT user_id, count(*) AS n FROM sig GROUP BY user_id")
def count_by_signal_all(spark, d):
    """A2: counts without an id list."""
    return counts_by_signal(signals(spark, d))


@query("news_coverage", "SELECT d.source, count(*) AS n, count(l.doc_id) AS processed, round(100.0 * count(l.doc_id) / count(*), 1) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source", base=False)
def news_coverage(spark, d):
    """Processed share by source."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("one")), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("processed")).select("source", "n", "processed", F.round(100.0 * F.col("processed") / F.col("n"), 1).cast("double").alias("coverage"))


@query("company_coverage", "SELECT n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey", base=False)
def company_coverage(spark, d):
    """Each company of the list with its count, zeros kept."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").join(n, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("source_freshness", f" SELECT ticker, epoch_us(max(decision_at)) AS newest_us, max(decision_at) < {NOW} + INTERVAL 10 DAY AS stale FROM sig GROUP BY ticker")
def source_freshness(spark, d):
    """The newest row by source and whether it is stale."""
    g = signals(spark, d).groupBy("ticker").agg(F.max("decision_at").alias("m"))
    return g.select("ticker", F.unix_micros(F.col("m").cast("timestamp")).alias("newest_us"), (F.col("m") < now() + F.expr("INTERVAL '10' DAY")).alias("stale"))


@query("collection_totals", "SELECT count(DISTINCT source) AS sources, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents", base=False)
def collection_totals(spark, d):
    """A8."""
    return table(spark, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"))


HITS = H4 + ", r AS (SELECT *, (target / entry - 1) * 100 AS ret FROM h WHERE target IS NOT NULL AND direction <> 'neutral'), q AS (SELECT *, (direction = 'up') = (ret > 0) AS hit, CASE direction WHEN 'up' THEN ret ELSE -ret END AS signed FROM r)"


def hits(spark, d) -> DataFrame:
    r = horizon(entries(spark, d), spark, d, 4, "target").where("target IS NOT NULL AND direction <> 'neutral'").withColumn("ret", change("target", "entry") * 100)
    return r.withColumn("hit", (F.col("direction") == "up") == (F.col("ret") > 0)).withColumn("signed", F.when(F.col("direction") == "up", F.col("ret")).otherwise(-F.col("ret")))


@query("signal_benchmark", HITS + " SELECT model, count(*) AS n, count(*) FILTER (hit) AS hits, count(DISTINCT user_id) AS groups, round(avg(signed), 6) AS mean_signed FROM q GROUP BY model")
def signal_benchmark(spark, d):
    """Hits, groups and signed returns by model."""
    return hits(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count_distinct("user_id").alias("groups"), F.round(F.avg("signed"), 6).alias("mean_signed"))


@query("rule_vs_model", HITS + " SELECT count(*) AS n, count(*) FILTER (hit AND (k >= 50) = (ret > 0)) AS both, count(*) FILTER (hit AND (k >= 50) <> (ret > 0)) AS model_only, count(*) FILTER (NOT hit AND (k >= 50) = (ret > 0)) AS rule_only FROM q")
def rule_vs_model(spark, d):
    """Model and rule on the same rows."""
    q = hits(spark, d).withColumn("rule", (F.col("k") >= 50) == (F.col("ret") > 0))
    return q.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("hit AND rule")).alias("both"), F.count_if(F.expr("hit AND NOT rule")).alias("model_only"), F.count_if(F.expr("NOT hit AND rule")).alias("rule_only"))


@query("materiality_selection", SCORED + " SELECT cluster, count(*) FILTER (p >= 0.6) AS selected, round(avg(y) FILTER (p >= 0.6), 6) AS hit_rate, round(avg(y) FILTER (p >= 0.6) / nullif(avg(y), 0), 6) AS lift FROM x GROUP BY cluster", base=False)
def materiality_selection(spark, d):
    """Selected share, precision and lift over the prevalence."""
    chosen = F.avg(F.when(F.col("p") >= 0.6, F.col("y")))
    return scored(spark, d).groupBy("cluster").agg(F.count_if(F.col("p") >= 0.6).alias("selected"), F.round(chosen, 6).alias("hit_rate"), F.round(F.try_divide(chosen, F.avg("y")), 6).alias("lift"))


@query("coverage_policy", SCORED + " SELECT doc_id, CASE WHEN p >= 0.8 THEN 'up' WHEN p <= 0.2 THEN 'down' ELSE 'abstain' END AS decision FROM x", base=False)
def coverage_policy(spark, d):
    """Fixed thresholds; between them the policy abstains."""
    p = F.col("p")
    return scored(spark, d).select("doc_id", F.when(p >= 0.8, "up").when(p <= 0.2, "down").otherwise("abstain").alias("decision"))


@query("quality_gate", SCORED + " SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) >= 0.58 AS accuracy_ok, count(*) >= 30 AS rows_ok, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) >= 10 AS classes_ok FROM x", base=False)
def quality_gate(spark, d):
    """Thresholds as boolean columns."""
    right = F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0))
    return scored(spark, d).agg(F.round(right, 6).alias("accuracy"), (right >= 0.58).alias("accuracy_ok"), (F.count(F.lit(1)) >= 30).alias("rows_ok"), (F.least(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)) >= 10).alias("classes_ok"))


@query("blend", SCORED + " SELECT doc_id, round((p + CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END) / 2, 6) AS blended FROM x", base=False)
def blend(spark, d):
    """The mean of two models' probabilities."""
    return scored(spark, d).select("doc_id", F.round((F.col("p") + F.when(F.col("toxic") == 1, 0.0).otherwise(1.0)) / 2, 6).alias("blended"))


@query("joint_policy", SCORED + ", c AS (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM x) SELECT doc_id, round(1 / (1 + exp(-(ln(q / (1 - q)) + 0.3))), 6) AS shifted, round(p * greatest(q, 1 - q), 6) AS joint FROM c", base=False)
def joint_policy(spark, d):
    """A shift on the logit scale, and joint confidence."""
    c = scored(spark, d).withColumn("q", F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6)))
    q = F.col("q")
    return c.select("doc_id", F.round(1 / (1 + F.exp(-(F.log(q / (1 - q)) + 0.3))), 6).alias("shifted"), F.round(F.col("p") * F.greatest(q, 1 - q), 6).alias("joint"))


@query("wilson_threshold", SCORED + """, g AS (SELECT p, sum(y) AS s, count(*) AS n FROM x GROUP BY p), r AS (SELECT p, CAST(sum(s) OVER (ORDER BY p DESC) AS DOUBLE) AS s, CAST(sum(n) OVER (ORDER BY p DESC) AS DOUBLE) AS n, 1.959963984540054 AS z FROM g),
t AS (SELECT p, (s / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS low FROM r) SELECT p AS threshold, round(greatest(low, 0), 6) AS low FROM t ORDER BY round(greatest(low, 0), 6) DESC, p LIMIT 1""", base=False)
def wilson_threshold(spark, d):
    """The threshold of the best lower bound; counts per score first, so the ordered part is small."""
    g = scored(spark, d).groupBy("p").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    r = running_sums(g, "p", {"hits": "s", "m": "n"}, descending=True)
    return r.select(F.col("p").alias("threshold"), F.round(wilson(F.col("hits"), F.col("m"))[0], 6).alias("low")).orderBy(F.desc("low"), "threshold").limit(1)


@query("asymmetric_policy", SCORED + """, u AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS up), w AS (SELECT unnest([0.1, 0.2, 0.3, 0.4]) AS down),
g AS (SELECT CAST(up AS DOUBLE) AS up, CAST(down AS DOUBLE) AS down, count(*) FILTER (p >= up AND y = 1) + count(*) FILTER (p <= down AND y = 0) AS hits, count(*) FILTER (p >= up OR p <= down) AS n FROM x, u, w GROUP BY 1, 2) SELECT up, down, hits, n FROM g WHERE n >= 10 ORDER BY hits / CAST(n AS DOUBLE) DESC, n DESC, up, down LIMIT 1""", base=False)
def asymmetric_policy(spark, d):
    """The best pair of cutoffs of a grid of fixed size; counts per score first."""
    g = scored(spark, d).groupBy("p").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(u).alias("up"), F.lit(w).alias("down")) for u in (0.5, 0.6, 0.7, 0.8, 0.9) for w in (0.1, 0.2, 0.3, 0.4)])
    c = g.withColumn("c", F.explode(grid)).select("p", "s", "n", "c.*")
    high, low = F.col("p") >= F.col("up"), F.col("p") <= F.col("down")
    out = c.groupBy("up", "down").agg(F.sum(F.when(high, F.col("s")).when(low, F.col("n") - F.col("s")).otherwise(0)).alias("hits"), F.sum(F.when(high | low, F.col("n")).otherwise(0)).alias("n"))
    return out.where("n >= 10").orderBy(F.desc(F.col("hits") / F.col("n")), F.desc("n"), "up", "down").limit(1)


DAILY = ", f AS (SELECT ticker, CAST(bars.at + INTERVAL 3 HOUR AS DATE) AS day, arg_min(open, (bars.at, bar_id)) AS o FROM bars GROUP BY 1, 2), dr AS (SELECT ticker, day, o / lag(o) OVER (PARTITION BY ticker ORDER BY day) - 1 AS r FROM f), mf AS (SELECT CAST(bench.at + INTERVAL 3 HOUR AS DATE) AS day, arg_min(open, bench.at) AS o FROM bench GROUP BY 1), mr AS (SELECT day, o / lag(o) OVER (ORDER BY day) - 1 AS m FROM mf)"


@query("risk_beta", DAILY + " SELECT ticker, CASE WHEN count(*) >= 20 AND var_samp(m) > 0 THEN round(greatest(-2, least(4, covar_samp(r, m) / var_samp(m))), 6) END AS beta FROM dr JOIN mr ON dr.day = mr.day WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY ticker")
def risk_beta(spark, d):
    """Beta to the benchmark over common days, 20 at least, within [-2, 4]."""
    day = F.to_date(F.col("at") + hours(3)).alias("day")
    f = bars(spark, d).groupBy("ticker", day).agg(F.min_by("open", F.struct("at", "bar_id")).alias("o"))
    r = f.select("ticker", "day", (F.try_divide(F.col("o"), F.lag("o").over(Window.partitionBy("ticker").orderBy("day"))) - 1).alias("r"))
    mf = benchmark_bars(spark, d).groupBy(day).agg(F.min_by("open", "at").alias("o"))
    m = mf.select("day", (F.try_divide(F.col("o"), F.lag("o").over(Window.partitionBy(F.lit(1)).orderBy("day"))) - 1).alias("m"))  # one row a day
    b = F.try_divide(F.covar_samp("r", "m"), F.var_samp("m"))
    return r.join(m, "day").where("r IS NOT NULL AND m IS NOT NULL").groupBy("ticker").agg(F.when((F.count(F.lit(1)) >= 20) & (F.var_samp("m") > 0), F.round(F.greatest(F.lit(-2.0), F.least(F.lit(4.0), b)), 6)).alias("beta"))


@query("window_stats", " SELECT s.signal_id, count(*) AS n, round((max(b.open) / min(b.open) - 1) * 100, 6) AS range_pct FROM sig s JOIN bars b ON s.ticker = b.ticker AND b.at <= s.decision_at AND b.at > s.decision_at - INTERVAL 30 MINUTE GROUP BY s.signal_id")
def window_stats(spark, d):
    """Bars of the half hour before."""
    s = signals(spark, d).select("signal_id", "ticker", (F.col("decision_at") - minutes(30)).alias("since"))
    r = window_aggregates(s, "signal_id", bars(spark, d), ["ticker"], "since", 1800, "at", {"low": F.col("open")}, {"high": F.col("open")}, strict=True)
    return r.select("signal_id", "n", F.round((F.try_divide(F.col("high"), F.col("low")) - 1) * 100, 6).alias("range_pct"))


@query("scenario_range", " SELECT signal_id, round(2.0 * sqrt(4 / CAST(24 AS DOUBLE)) * (1 - abs(score) / 200), 6) AS low, round(2.0 * sqrt(4 / CAST(24 AS DOUBLE)) * (1 + abs(score) / 200), 6) AS high FROM sig")
def scenario_range(spark, d):
    """A range from volatility by the root of time and the strength of the score."""
    base = F.lit(2.0) * F.sqrt(F.lit(4 / 24))
    return signals(spark, d).select("signal_id", F.round(base * (1 - F.abs("score") / 200), 6).alias("low"), F.round(base * (1 + F.abs("score") / 200), 6).alias("high"))


@query("symmetric_features", ENTRY + " SELECT signal_id, abs(score) AS strength, round(abs(entry - 50) / greatest(confidence, 0.05), 6) AS ratio FROM e")
def symmetric_features(spark, d):
    """Absolute features; a ratio's denominator has a floor."""
    return entries(spark, d).select("signal_id", F.abs("score").alias("strength"), F.round(F.abs(F.col("entry") - 50) / F.greatest(F.col("confidence"), F.lit(0.05)), 6).alias("ratio"))


@query("interactions", " SELECT signal_id, ticker || '|' || CASE WHEN score > 0 THEN 'pos' WHEN score < 0 THEN 'neg' ELSE 'zero' END AS crossed FROM sig")
def interactions(spark, d):
    """Category by sign."""
    s = F.col("score")
    return signals(spark, d).select("signal_id", F.concat_ws("|", "ticker", F.when(s > 0, "pos").when(s < 0, "neg").otherwise("zero")).alias("crossed"))


@query("ternary_label", H4 + " SELECT signal_id, CASE WHEN target IS NULL THEN NULL WHEN (target / entry - 1) * 100 / 2 > 0.5 THEN 1 WHEN (target / entry - 1) * 100 / 2 < -0.5 THEN -1 ELSE 0 END AS label FROM h")
def ternary_label(spark, d):
    """The margin over a scale, in three classes."""
    m = change("target", "entry") * 100 / 2
    h = horizon(entries(spark, d), spark, d, 4, "target")
    return h.select("signal_id", F.when(F.col("target").isNull(), None).when(m > 0.5, 1).when(m < -0.5, -1).otherwise(0).alias("label"))


@query("sentiment_features", ", q AS (SELECT signal_id, (k + 1) / CAST(202 AS DOUBLE) AS a, (101 - k) / CAST(202 AS DOUBLE) AS b, 0.5 - 1 / CAST(202 AS DOUBLE) + 0 * k AS c FROM sig) SELECT signal_id, round(a - b, 6) AS score, round(greatest(a, b, c), 6) AS confidence, round(-(a * ln(a) + b * ln(b) + c * ln(c)) / ln(3), 6) AS entropy FROM q")
def sentiment_features(spark, d):
    """Score, confidence and normalised entropy of three probabilities."""
    q = signals(spark, d).select("signal_id", ((F.col("k") + 1) / 202.0).alias("a"), ((101 - F.col("k")) / 202.0).alias("b")).withColumn("c", F.lit(0.5 - 1 / 202) + 0 * F.col("a"))
    terms = sum((F.col(x) * F.log(x) for x in "abc"), F.lit(0.0))
    return q.select("signal_id", F.round(F.col("a") - F.col("b"), 6).alias("score"), F.round(F.greatest("a", "b", "c"), 6).alias("confidence"), F.round(-terms / F.log(F.lit(3.0)), 6).alias("entropy"))


@query("reconcile_polarity", " SELECT signal_id, CASE WHEN model = 0 OR sign(score) <> sign(k - 40) THEN score / 100 ELSE (score / 100 + (k - 40) / CAST(60 AS DOUBLE)) / 2 END AS polarity FROM sig".replace("CASE WHEN", "round(CASE WHEN").replace("END AS", "END, 6) AS"))
def reconcile_polarity(spark, d):
    """The rule's polarity stands unless an outside one agrees in sign."""
    rule, other = F.col("score") / 100, (F.col("k") - 40) / 60
    keep = (F.col("model") == 0) | (F.signum("score") != F.signum(F.col("k") - 40))
    return signals(spark, d).select("signal_id", F.round(F.when(keep, rule).otherwise((rule + other) / 2), 6).alias("polarity"))


@query("materiality_outcomes", H4 + f", r AS (SELECT *, CASE WHEN entry IS NULL THEN 'no_entry' WHEN target IS NULL AND entry_at + INTERVAL 4 HOUR + INTERVAL 20 MINUTE > {NOW} THEN 'pending' WHEN target IS NULL THEN 'missed' ELSE 'evaluated' END AS status FROM h) SELECT signal_id, status, CASE WHEN status = 'evaluated' THEN (confidence >= 0.5) = (abs(target / entry - 1) * 100 >= 1) END AS verdict FROM r")
def materiality_outcomes(spark, d):
    """Pending, unavailable or evaluated; the verdict is whether prediction and outcome agree."""
    h = horizon(entries(spark, d), spark, d, 4, "target")
    none, open_ = F.col("target").isNull(), F.col("entry_at") + hours(4) + minutes(20) > now()
    status = F.when(F.col("entry").isNull(), "no_entry").when(none & open_, "pending").when(none, "missed").otherwise("evaluated")
    agree = (F.col("confidence") >= 0.5) == (F.abs(change("target", "entry")) * 100 >= 1)
    return h.withColumn("status", status).select("signal_id", "status", F.when(F.col("status") == "evaluated", agree).alias("verdict"))


@query("materiality_status", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'ready' ELSE 'deferred' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", base=False)
def materiality_status(spark, d):
    """The state of each news item's prediction."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "ready").otherwise("deferred").alias("status"))


@query("load_checks", " SELECT count(*) AS n, count(*) - count(DISTINCT signal_id) AS repeats, count(*) FILTER (confidence NOT BETWEEN 0 AND 1) AS out_of_range, count(*) FILTER (direction IS NULL) AS untyped FROM sig")
def load_checks(spark, d):
    """Invariants of a loaded dataset as counts."""
    return signals(spark, d).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("signal_id")).alias("repeats"), F.count_if(~F.col("confidence").between(0, 1)).alias("out_of_range"), F.count_if(F.col("direction").isNull()).alias("untyped"))


@query("nb_gate", SCORED + " SELECT count(*) >= 100 AS enough, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) FILTER (p < 0.2), 6) AS reject_precision, round(count(*) FILTER (p < 0.2) / CAST(count(*) AS DOUBLE), 6) AS reject_coverage FROM x", base=False)
def nb_gate(spark, d):
    """Limits of a router before it may serve."""
    low = F.col("p") < 0.2
    return scored(spark, d).agg((F.count(F.lit(1)) >= 100).alias("enough"), F.round(F.avg(F.when(low, F.when(F.col("y") == 0, 1.0).otherwise(0.0))), 6).alias("reject_precision"), F.round(F.count_if(low) / F.count(F.lit(1)), 6).alias("reject_coverage"))


@query("model_vs_formula", SCORED + """, z AS (SELECT y, p AS s, 'model' AS arm FROM x UNION ALL SELECT y, 1 - p, 'formula' FROM x), g AS (SELECT arm, s, sum(y) AS pos, count(*) AS n FROM z GROUP BY arm, s), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY arm ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / CAST(2 AS DOUBLE) AS mid FROM g)
SELECT arm, round((sum(pos * mid) - sum(pos) * (sum(pos) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 4) AS auc FROM r GROUP BY arm""", base=False)
def model_vs_formula(spark, d):
    """Ranking quality of two systems on the same rows."""
    arms = F.array(F.struct(F.lit("model").alias("arm"), F.col("p").alias("s")), F.struct(F.lit("formula").alias("arm"), (1 - F.col("p")).alias("s")))
    z = scored(spark, d).select("y", F.explode(arms).alias("a")).select("y", "a.*")
    return roc_auc(z, "s", "y", ["arm"]).select("arm", F.round("auc", 4).alias("auc"))
