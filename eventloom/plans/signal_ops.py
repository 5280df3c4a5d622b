"""Row operators over signals: filters, keep-latest, history, ranking, pages, sets, upserts."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import previous
from ..sources.fixtures import signals, table
from .registry import query

NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, that of the greatest order: an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def expire(df: DataFrame, now: Column) -> DataFrame:
    """df with active rows whose expires_at has come marked expired; other states, and rows without an expiry, stay."""
    over = (F.col("status") == "active") & (F.col("expires_at") <= now)
    return df.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


@query("filter_signals", f""", f AS (SELECT *, CASE WHEN model = 2 THEN 'withdrawn' ELSE 'active' END AS stored, least(decision_at + k * INTERVAL 1 HOUR, decision_at + INTERVAL 3 DAY) AS expires_at FROM sig), e AS (SELECT *, CASE WHEN stored = 'active' AND expires_at <= {NOW} THEN 'expired' ELSE stored END AS status FROM f)
SELECT signal_id, ticker, direction, confidence, status FROM e WHERE ticker IN ('purchase', 'click') AND direction IN ('up', 'down') AND confidence >= 0.5 AND status IN ('active', 'expired') ORDER BY decision_at DESC, signal_id DESC LIMIT 1000""")
def filter_signals(spark, d):
    """expiry is rewritten first, then a conjunctive filter, newest first, at most 1000."""
    s = signals(spark, d).withColumn("status", F.when(F.col("model") == 2, "withdrawn").otherwise("active"))
    end = F.least(F.col("decision_at") + F.make_dt_interval(hours=F.col("k")), F.col("decision_at") + F.expr("INTERVAL '3' DAY"))
    s = expire(s.withColumn("expires_at", end), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    s = s.where(F.col("ticker").isin("purchase", "click") & F.col("direction").isin("up", "down") & (F.col("confidence") >= 0.5) & F.col("status").isin("active", "expired"))
    return s.orderBy(F.desc("decision_at"), F.desc("signal_id")).limit(1000).select("signal_id", "ticker", "direction", "confidence", "status")


@query("signal_freshness", f""", f AS (SELECT *, least(decision_at + k * INTERVAL 1 HOUR, decision_at + INTERVAL 3 DAY) AS expires_at FROM sig)
SELECT signal_id, epoch_us(expires_at) AS expires_us, CASE WHEN expires_at <= {NOW} THEN 'expired' ELSE 'active' END AS status FROM f""")
def signal_freshness(spark, d):
    """expiry capped at three days after publication, status by a given now."""
    end = F.least(F.col("decision_at") + F.make_dt_interval(hours=F.col("k")), F.col("decision_at") + F.expr("INTERVAL '3' DAY"))
    f = signals(spark, d).withColumn("e", end)
    status = F.when(F.col("e").cast("timestamp") <= F.expr(NOW), "expired").otherwise("active")
    return f.select("signal_id", F.unix_micros(F.col("e").cast("timestamp")).alias("expires_us"), status.alias("status"))


@query("gate_publishable", " SELECT signal_id, direction = 'up' OR (direction = 'down' AND score <= -30 AND confidence >= 0.8) AS publishable FROM sig")
def gate_publishable(spark, d):
    """down needs a strong score and confidence."""
    down = (F.col("direction") == "down") & (F.col("score") <= -30) & (F.col("confidence") >= 0.8)
    return signals(spark, d).select("signal_id", ((F.col("direction") == "up") | down).alias("publishable"))


@query("dedup_signals", " SELECT ticker, user_id, max(signal_id) AS signal_id, arg_max(score, (decision_at, signal_id)) AS score FROM sig GROUP BY ticker, user_id")
def dedup_signals(spark, d):
    """The latest signal of each key."""
    return keep_latest(signals(spark, d), ["ticker", "user_id"], ["decision_at", "signal_id"]).select("ticker", "user_id", "signal_id", "score")


@query("active_by_ticker", " SELECT ticker, arg_max(signal_id, (decision_at, signal_id)) AS signal_id FROM sig WHERE direction <> 'neutral' GROUP BY ticker")
def active_by_ticker(spark, d):
    """The newest directional signal by ticker."""
    return keep_latest(signals(spark, d).where("direction <> 'neutral'"), ["ticker"], ["decision_at", "signal_id"]).select("ticker", "signal_id")


@query("signal_history", """, w AS (SELECT signal_id, ticker, direction, lag(direction) OVER o AS prev_direction, score - lag(score) OVER o AS score_delta, round(confidence - lag(confidence) OVER o, 6) AS confidence_delta
FROM sig WINDOW o AS (PARTITION BY ticker ORDER BY decision_at, signal_id)) SELECT *, direction <> prev_direction AS changed FROM w""")
def signal_history(spark, d):
    """Each signal against the one before on its ticker."""
    s = previous(signals(spark, d), "ticker", F.to_date("decision_at"), ["decision_at", "signal_id"], {"prev_direction": "direction", "s0": "score", "c0": "confidence"})
    w = s.select("signal_id", "ticker", "direction", "prev_direction", (F.col("score") - F.col("s0")).alias("score_delta"), F.round(F.col("confidence") - F.col("c0"), 6).alias("confidence_delta"))
    return w.withColumn("changed", F.col("direction") != F.col("prev_direction"))


@query("quality_series", """, r AS (SELECT *, CASE WHEN k >= 66 THEN 1 ELSE 0 END AS hit, CASE WHEN direction = 'up' THEN k - 50 ELSE 50 - k END AS signed FROM sig WHERE direction <> 'neutral'),
w AS (SELECT signal_id, ticker, sum(hit) OVER o AS hits, count(*) OVER o AS n, sum(signed) OVER o AS total FROM r WINDOW o AS (PARTITION BY ticker ORDER BY decision_at, signal_id ROWS UNBOUNDED PRECEDING))
SELECT signal_id, ticker, CAST(hits AS BIGINT) AS hits, n, hits / CAST(n AS DOUBLE) AS running, total / CAST(n AS DOUBLE) AS mean_signed FROM w""")
def quality_series(spark, d):
    """Running hits, number, hit rate and mean signed move by ticker.

    Each day's totals are carried to the days after, and a running sum is taken within the day: a hot ticker is many tasks.
    """
    r = signals(spark, d).where("direction <> 'neutral'").select(
        "signal_id", "ticker", "decision_at", F.to_date("decision_at").alias("day"), F.when(F.col("k") >= 66, 1).otherwise(0).alias("hit"), F.when(F.col("direction") == "up", F.col("k") - 50).otherwise(50 - F.col("k")).alias("signed")
    )
    sums = {"hits": F.sum("hit"), "n": F.count(F.lit(1)), "total": F.sum("signed")}
    days = r.groupBy("ticker", "day").agg(*[v.alias(f"d_{c}") for c, v in sums.items()])
    before = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("ticker", "day", *[F.coalesce(F.sum(f"d_{c}").over(before), F.lit(0)).alias(f"d_{c}") for c in sums])
    upto = Window.partitionBy("ticker", "day").orderBy("decision_at", "signal_id").rowsBetween(Window.unboundedPreceding, 0)
    w = r.select("signal_id", "ticker", "day", *[v.over(upto).alias(c) for c, v in sums.items()]).join(days, ["ticker", "day"])
    w = w.select("signal_id", "ticker", *[(F.col(c) + F.col(f"d_{c}")).alias(c) for c in sums])
    return w.select("signal_id", "ticker", "hits", "n", (F.col("hits") / F.col("n")).alias("running"), (F.col("total") / F.col("n")).alias("mean_signed"))


@query("rank_by_materiality", """, s AS (SELECT *, CAST(decision_at AS DATE) AS day, k % 4 <> 0 AS scored FROM sig),
slots AS (SELECT day, signal_id, row_number() OVER (PARTITION BY day, scored ORDER BY decision_at DESC, signal_id) AS n, row_number() OVER (PARTITION BY day ORDER BY decision_at DESC, signal_id) AS slot, scored FROM s),
best AS (SELECT day, signal_id, row_number() OVER (PARTITION BY day ORDER BY confidence DESC, decision_at DESC, signal_id) AS n FROM s WHERE scored)
SELECT coalesce(b.signal_id, x.signal_id) AS signal_id, x.slot FROM slots x LEFT JOIN best b ON x.scored AND x.day = b.day AND x.n = b.n""")
def rank_by_materiality(spark, d):
    """Scored rows are ranked within their day among the slots of scored rows; others keep theirs."""
    s = signals(spark, d).withColumn("day", F.to_date("decision_at")).withColumn("scored", F.col("k") % 4 != 0)
    newest = [F.desc("decision_at"), F.col("signal_id")]
    slots = s.select("day", "scored", "signal_id", F.row_number().over(Window.partitionBy("day", "scored").orderBy(*newest)).alias("n"), F.row_number().over(Window.partitionBy("day").orderBy(*newest)).alias("slot"))
    best = s.where("scored").select("day", F.lit(True).alias("scored"), F.col("signal_id").alias("best_id"), F.row_number().over(Window.partitionBy("day").orderBy(F.desc("confidence"), *newest)).alias("n"))
    return slots.join(best, ["day", "scored", "n"], "left").select(F.coalesce("best_id", "signal_id").alias("signal_id"), "slot")


@query("daily_topk", ", r AS (SELECT *, row_number() OVER (PARTITION BY CAST(decision_at AS DATE) ORDER BY confidence DESC, signal_id) AS rn FROM sig) SELECT signal_id, rn FROM r WHERE rn <= 3")
def daily_topk(spark, d):
    """Three most confident a day."""
    rn = F.row_number().over(Window.partitionBy(F.to_date("decision_at")).orderBy(F.desc("confidence"), "signal_id"))
    return signals(spark, d).select("signal_id", rn.alias("rn")).where("rn <= 3")


@query("scan_news_latest", " SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 1000", base=False)
def scan_news_latest(spark, d):
    """Ordered scan with a limit (the feature)."""
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(1000).select("doc_id", "source")


@query("page_keyset", " SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (1000, 2) ORDER BY l_orderkey, l_linenumber LIMIT 251", base=False)
def page_keyset(spark, d):
    """L2: the page after a composite key, with one row of look-ahead."""
    t = table(spark, d, "lineitem")
    after = (F.col("l_orderkey") > 1000) | ((F.col("l_orderkey") == 1000) & (F.col("l_linenumber") > 2))
    return t.where(after).orderBy("l_orderkey", "l_linenumber").limit(251).select("l_orderkey", "l_linenumber", "l_partkey")


@query("page_offset", " SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200", base=False)
def page_offset(spark, d):
    """L3: offset page."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(100)


@query("semi_news_by_ids", " SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", base=False)
def semi_news_by_ids(spark, d):
    """Rows of an id set."""
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("reprocess_backlog", " SELECT doc_id, n_chars % 4 AS priority FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY priority DESC, doc_id LIMIT 500", base=False)
def reprocess_backlog(spark, d):
    """F16: rows without a current result, by priority."""
    left = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.select("doc_id", (F.col("n_chars") % 4).alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(500)


@query("join_request_job", " SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'", base=False)
def join_request_job(spark, d):
    """Inner join on an id."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.join(table(spark, d, "customer"), o.o_custkey == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_nationkey")


@query("join_source_meta", " SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", base=False)
def join_source_meta(spark, d):
    """Left join that keeps rows without partners."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("nest_predictions", " SELECT user_id, string_agg(CAST(signal_id AS VARCHAR), ',' ORDER BY confidence DESC, signal_id DESC) AS ids FROM sig GROUP BY user_id")
def nest_predictions(spark, d):
    """Predictions nested under their key, best first."""
    g = signals(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("confidence", "signal_id")), asc=False).alias("p"))
    return g.select("user_id", F.array_join(F.transform("p", lambda x: x["signal_id"].cast("string")), ",").alias("ids"))


@query("upsert_latest", """, u AS (SELECT *, 0 AS gen FROM sig UNION ALL BY NAME SELECT * REPLACE (score + 1 AS score), 1 AS gen FROM sig WHERE direction <> 'neutral')
SELECT signal_id, arg_max(score, gen) AS score, max(gen) AS gen FROM u GROUP BY signal_id""")
def upsert_latest(spark, d):
    """A keyed union in which the later generation wins."""
    s = signals(spark, d)
    newer = s.where("direction <> 'neutral'").withColumn("score", F.col("score") + 1)
    both = s.withColumn("gen", F.lit(0)).unionByName(newer.withColumn("gen", F.lit(1)))
    return keep_latest(both.select("signal_id", "score", "gen"), ["signal_id"], ["gen"]).select("signal_id", "score", "gen")


@query("ingest_idempotent", " SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", base=False)
def ingest_idempotent(spark, d):
    """Insert if absent."""
    incoming = table(spark, d, "documents").select("doc_id", "source")
    return incoming.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("snapshot_retention", " SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'", base=False)
def snapshot_retention(spark, d):
    """Rows that a retention limit keeps."""
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("event_id")


@query("merge_datasets", " SELECT doc_id, 'a' AS part FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'b' FROM labels WHERE toxic = 0 AND quality = 0", base=False)
def merge_datasets(spark, d):
    """Union of disjoint datasets."""
    l = table(spark, d, "labels")  # noqa: E741
    return l.where("toxic = 1").select("doc_id", F.lit("a").alias("part")).unionByName(l.where("toxic = 0 AND quality = 0").select("doc_id", F.lit("b").alias("part")))


@query("id_differences", " SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", base=False)
def id_differences(spark, d):
    """Ids on one side only."""
    a, b = (table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    return a.join(b, "doc_id", "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("kind", F.lit("unknown")))


@query("id_intersection", " SELECT DISTINCT o_custkey AS custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10", base=False)
def id_intersection(spark, d):
    """U4."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")).intersect(table(spark, d, "customer").where("c_nationkey < 10").select("c_custkey"))


@query("prediction_alignment", " SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'both' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id", base=False)
def prediction_alignment(spark, d):
    """Full alignment of predictions and examples."""
    a = table(spark, d, "documents").select("doc_id", F.lit(1).alias("a"))
    b = table(spark, d, "labels").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").otherwise("both").alias("side"))


@query("dim_lookup", " SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", base=False)
def dim_lookup(spark, d):
    """Dimension lookups; the optimizer broadcasts the sides it measures as small."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("count_by_model", " SELECT model, count(*) AS n FROM sig GROUP BY model")
def count_by_model(spark, d):
    """A1, A2."""
    return signals(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


#: Checksums of source names for SQL, which has no crc32.
_lanes = "(VALUES " + ", ".join(f"('src{n}', {crc32(f'src{n}'.encode())})" for n in range(100)) + ") c(name, sum)"


@query("stream_lanes", f" SELECT source, CASE WHEN c.sum % 6 = 0 THEN 'fast' ELSE 'discovery_' || (c.sum % 5) END AS lane, count(*) AS n FROM documents LEFT JOIN {_lanes} ON source = c.name GROUP BY ALL", base=False)
def stream_lanes(spark, d):
    """ST1: sources dealt to the fast lane or to one of five stable discovery lanes, by checksum."""
    sum_ = F.crc32(F.col("source").cast("binary"))
    lane = F.when(sum_ % 6 == 0, "fast").otherwise(F.concat(F.lit("discovery_"), (sum_ % 5).cast("string")))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", lane.alias("lane"), "n")


@query("source_bucket", f" SELECT source, CAST(c.sum % 5 AS INTEGER) AS bucket, count(*) AS n FROM documents LEFT JOIN {_lanes} ON source = c.name GROUP BY ALL", base=False)
def source_bucket(spark, d):
    """The stable bucket of a source, by crc32."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", (F.crc32(F.col("source").cast("binary")) % 5).cast("int").alias("bucket"), "n")


@query("stream_dedup", " SELECT DISTINCT user_id, event_type FROM events", base=False)
def stream_dedup(spark, d):
    """ST3: the first row of each key (the streaming form is streaming.dedup)."""
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()
