"""Gates, reasons, due sets and projections of news and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.fixtures import bars, signals, table
from .market import ENTRY, TARGET, change, entries, horizon
from .registry import query
from .signal_ops import NOW, keep_latest
from .text_ops import TITLE, TOKENS, titled


def now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def hours(n: int):
    return F.expr(f"INTERVAL '{n}' HOUR")


def minutes(n: int):
    return F.expr(f"INTERVAL '{n}' MINUTE")


@query("news_public", f"SELECT doc_id FROM documents WHERE source <> 'src0' AND (source <> 'src1' OR contains(lower({TITLE}), 'tion'))", base=False)
def news_public(spark, d):
    """the smoke source is hidden, the exchange feed shows only titles of its own kind."""
    return titled(spark, d).where("source <> 'src0' AND (source <> 'src1' OR contains(lower(title), 'tion'))").select("doc_id")


@query("gate_product_event", " SELECT s.signal_id, s.direction <> 'neutral' OR json_extract_string(e.props, '$.flag') = 'true' OR coalesce(TRY_CAST(json_extract_string(e.props, '$.k') AS INTEGER), 0) > 50 AS product FROM sig s JOIN events e ON s.signal_id = e.event_id")
def gate_product_event(spark, d):
    """a signal, a candidate flag that is exactly true, or outcomes counted."""
    p = F.from_json("props", "flag string, k int")
    s = signals(spark, d).select("signal_id", "direction")
    j = s.join(table(spark, d, "events").select(F.col("event_id").alias("signal_id"), p.alias("p")), "signal_id")
    return j.select("signal_id", ((F.col("direction") != "neutral") | (F.col("p.flag") == "true") | (F.coalesce("p.k", F.lit(0)) > 50)).alias("product"))


@query("materiality_due", f""" SELECT s.signal_id FROM sig s LEFT JOIN labels p ON s.signal_id = p.doc_id
WHERE decision_at <= {NOW} - INTERVAL 5 MINUTE AND decision_at >= {NOW} - INTERVAL 7 DAY AND (p.doc_id IS NULL OR (p.quality = 0 AND decision_at <= {NOW} - INTERVAL 1 HOUR))""")
def materiality_due(spark, d):
    """published five minutes ago at least, not too old, not ready; deferred ones after their interval."""
    s = signals(spark, d).where((F.col("decision_at") <= now() - minutes(5)) & (F.col("decision_at") >= now() - F.expr("INTERVAL '7' DAY")))
    p = table(spark, d, "labels").select(F.col("doc_id").alias("signal_id"), "quality")
    retry = (F.col("quality") == 0) & (F.col("decision_at") <= now() - hours(1))
    return s.join(p, "signal_id", "left").where(F.col("quality").isNull() | retry).select("signal_id")


@query("materiality_outcome_due", f" SELECT DISTINCT signal_id FROM sig WHERE direction <> 'neutral' AND decision_at + INTERVAL 4 HOUR <= {NOW} AND signal_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def materiality_outcome_due(spark, d):
    """ready, past its four hours, without an outcome."""
    due = signals(spark, d).where((F.col("direction") != "neutral") & (F.col("decision_at") + hours(4) <= now())).select("signal_id").distinct()
    return due.join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("signal_id")), "signal_id", "left_anti")


@query("prepare_skip_reasons", "WITH r AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN l.toxic = 1 THEN 'policy' WHEN n_chars < 200 THEN 'short' WHEN contains(text, '!!') THEN 'noise' ELSE 'kept' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT reason, count(*) AS n FROM r GROUP BY reason", base=False)
def prepare_skip_reasons(spark, d):
    """rows by the first reason to skip them."""
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = F.when(F.col("toxic").isNull(), "no_label").when(F.col("toxic") == 1, "policy").when(F.col("n_chars") < 200, "short").when(F.col("text").contains("!!"), "noise").otherwise("kept")
    return r.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("eval_pending", ENTRY + TARGET.format(h="4 HOUR") + f" SELECT signal_id, CASE WHEN entry IS NULL THEN 'no_entry' WHEN target IS NOT NULL THEN 'complete' WHEN entry_at + INTERVAL 4 HOUR + INTERVAL 20 MINUTE > {NOW} THEN 'pending' ELSE 'missed_window' END AS status FROM h")
def eval_pending(spark, d):
    """F18, ST5: complete, pending until the target's window ends, then missed; recomputed for rows not terminal."""
    h = horizon(entries(spark, d), spark, d, 4, "target")
    late = F.col("entry_at") + hours(4) + minutes(20) > now()
    return h.select("signal_id", F.when(F.col("entry").isNull(), "no_entry").when(F.col("target").isNotNull(), "complete").when(late, "pending").otherwise("missed_window").alias("status"))


@query("signal_evidence", """, r AS (SELECT signal_id, unnest([signal_id, signal_id + 1, user_id]) AS ref FROM sig)
SELECT r.signal_id, string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY d.doc_id) AS found, CASE count(d.doc_id) WHEN 3 THEN 'complete' WHEN 0 THEN 'missing' ELSE 'partial' END AS status FROM r LEFT JOIN documents d ON r.ref = d.doc_id GROUP BY r.signal_id""")
def signal_evidence(spark, d):
    """references resolved and gathered again, with how complete they are."""
    r = signals(spark, d).select("signal_id", F.explode(F.array("signal_id", F.col("signal_id") + 1, "user_id")).alias("doc_id"))
    known = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("hit"))
    g = r.join(known, "doc_id", "left").groupBy("signal_id").agg(F.array_sort(F.collect_list("hit")).alias("h"))
    n = F.size("h")
    return g.select("signal_id", F.when(n > 0, F.array_join(F.transform("h", lambda x: x.cast("string")), ",")).alias("found"), F.when(n == 3, "complete").when(n == 0, "missing").otherwise("partial").alias("status"))


@query("rejection_reason", " SELECT signal_id, CASE WHEN direction = 'neutral' THEN 'neutral' WHEN direction = 'down' AND score > -30 THEN 'weak_down' WHEN confidence < 0.7 AND direction = 'up' THEN 'low_confidence' WHEN model = 2 THEN 'retired_model' END AS reason FROM sig")
def rejection_reason(spark, d):
    """The first reason that holds."""
    dirn = F.col("direction")
    reason = F.when(dirn == "neutral", "neutral").when((dirn == "down") & (F.col("score") > -30), "weak_down").when((F.col("confidence") < 0.7) & (dirn == "up"), "low_confidence").when(F.col("model") == 2, "retired_model")
    return signals(spark, d).select("signal_id", reason.alias("reason"))


@query("eval_eligibility", """, l AS (SELECT *, decision_at + k * INTERVAL 30 SECOND AS processed FROM sig)
SELECT signal_id, CASE WHEN direction = 'neutral' THEN 'not_directional' WHEN model = 2 THEN 'context' END AS reason, CASE WHEN processed <= decision_at + INTERVAL 15 MINUTE THEN 'live' ELSE 'retrospective' END AS cohort,
epoch_us(CASE WHEN processed <= decision_at + INTERVAL 15 MINUTE THEN processed ELSE decision_at END) AS anchor_us FROM l""")
def eval_eligibility(spark, d):
    """X18, ST4: late rows are labelled and anchored at their evidence, never dropped."""
    l = signals(spark, d).withColumn("processed", F.col("decision_at") + F.make_dt_interval(secs=F.col("k") * F.lit(30)))  # noqa: E741
    live = F.col("processed") <= F.col("decision_at") + minutes(15)
    reason = F.when(F.col("direction") == "neutral", "not_directional").when(F.col("model") == 2, "context")
    anchor = F.when(live, F.col("processed")).otherwise(F.col("decision_at"))
    return l.select("signal_id", reason.alias("reason"), F.when(live, "live").otherwise("retrospective").alias("cohort"), F.unix_micros(anchor.cast("timestamp")).alias("anchor_us"))


@query("eval_outcomes", ENTRY + TARGET.format(h="4 HOUR") + """, r AS (SELECT *, (target / entry - 1) * 100 AS ret FROM h)
SELECT signal_id, CASE WHEN ret IS NULL THEN 'unavailable' WHEN direction = 'neutral' AND abs(ret) < 0.5 THEN 'quiet' WHEN direction = 'neutral' THEN 'material_move' WHEN ret = 0 THEN 'flat' WHEN (direction = 'up') = (ret > 0) THEN 'hit' ELSE 'miss' END AS verdict FROM r""")
def eval_outcomes(spark, d):
    """Verdicts of directional and neutral signals."""
    r = horizon(entries(spark, d), spark, d, 4, "target").withColumn("ret", change("target", "entry") * 100)
    neutral, ret = F.col("direction") == "neutral", F.col("ret")
    v = F.when(ret.isNull(), "unavailable").when(neutral & (F.abs(ret) < 0.5), "quiet").when(neutral, "material_move").when(ret == 0, "flat").when((F.col("direction") == "up") == (ret > 0), "hit").otherwise("miss")
    return r.select("signal_id", v.alias("verdict"))


@query("token_overlap", f"WITH t AS (SELECT item_id, {TOKENS.format(x='text')} AS w FROM benchmark) SELECT a.item_id AS x, b.item_id AS y, len(list_intersect(a.w, b.w)) / CAST(least(len(a.w), len(b.w)) AS DOUBLE) >= 0.6 AS alike FROM t a JOIN t b ON b.item_id = a.item_id + 1 WHERE len(a.w) > 0 AND len(b.w) > 0", base=False)
def token_overlap(spark, d):
    """The share of the smaller token set, of items side by side."""
    t = table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("w")).where("size(w) > 0")
    later = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    share = F.try_divide(F.size(F.array_intersect("w", "v")), F.least(F.size("w"), F.size("v")))
    return t.join(later, "item_id").select(F.col("item_id").alias("x"), (F.col("item_id") + 1).alias("y"), (share >= 0.6).alias("alike"))


@query("latest_model_signal", " SELECT user_id, ticker, arg_max(signal_id, (model, decision_at, signal_id)) AS signal_id, max(model) AS model FROM sig GROUP BY user_id, ticker")
def latest_model_signal(spark, d):
    """Of each news and ticker, the signal of the latest model."""
    return keep_latest(signals(spark, d), ["user_id", "ticker"], ["model", "decision_at", "signal_id"]).select("user_id", "ticker", "signal_id", "model")


@query("dedup_decisions", " SELECT ticker, user_id, direction, model, arg_max(signal_id, (confidence, -signal_id)) AS signal_id FROM sig GROUP BY ticker, user_id, direction, model")
def dedup_decisions(spark, d):
    """The most confident decision of each key, the first of equals."""
    s = signals(spark, d).withColumn("back", -F.col("signal_id"))
    return keep_latest(s, ["ticker", "user_id", "direction", "model"], ["confidence", "back"]).select("ticker", "user_id", "direction", "model", "signal_id")


@query("latest_epoch", " SELECT model, arg_max(signal_id, (CASE WHEN k >= 50 THEN 1 ELSE 0 END, decision_at, signal_id)) AS epoch FROM sig GROUP BY model")
def latest_epoch(spark, d):
    """The latest epoch of each model, those of the current methodology first."""
    s = signals(spark, d).withColumn("current", (F.col("k") >= 50).cast("int"))
    return keep_latest(s, ["model"], ["current", "decision_at", "signal_id"]).select("model", F.col("signal_id").alias("epoch"))


@query("ready_epochs", " SELECT model, max(signal_id) AS epoch FROM sig WHERE confidence < 0.9 GROUP BY model")
def ready_epochs(spark, d):
    """ST6: readers see only epochs whose commit marker says complete."""
    return signals(spark, d).where("confidence < 0.9").groupBy("model").agg(F.max("signal_id").alias("epoch"))


@query("merge_observations", """, u AS (SELECT model, ticker, user_id, signal_id, score, 0 AS gen FROM sig UNION ALL SELECT model, ticker, user_id, signal_id, -score, 1 FROM sig WHERE direction = 'down')
SELECT model, ticker, user_id, signal_id, arg_max(score, gen) AS score FROM u WHERE model >= 1 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY model, ticker, user_id, signal_id"))
def merge_observations(spark, d):
    """Keyed union of valid keys; the later generation wins."""
    keys = ["model", "ticker", "user_id", "signal_id"]
    s = signals(spark, d).where("model >= 1")
    u = s.select(*keys, "score", F.lit(0).alias("gen")).unionByName(s.where("direction = 'down'").select(*keys, (-F.col("score")).alias("score"), F.lit(1).alias("gen")))
    return keep_latest(u, keys, ["gen"]).drop("gen")


@query("backfill_observations", " SELECT user_id, arg_min(signal_id, (decision_at, signal_id)) AS signal_id, count(*) AS n FROM sig GROUP BY user_id")
def backfill_observations(spark, d):
    """Nested observations laid out again, the first of each key wins."""
    nested = signals(spark, d).groupBy("model", "user_id", F.floor(F.col("signal_id") / 500)).agg(F.collect_list(F.struct("decision_at", "signal_id")).alias("o"))
    flat = nested.select("user_id", F.explode("o").alias("o"))
    return flat.groupBy("user_id").agg(F.min("o").alias("f"), F.count(F.lit(1)).alias("n")).select("user_id", F.col("f.signal_id").alias("signal_id"), "n")


@query("epoch_refresh", " SELECT model, count(*) AS stored, greatest(count(*), count(*) FILTER (direction <> 'neutral'), count(DISTINCT user_id)) AS raw, count(*) FILTER (direction = 'neutral') = 0 AS complete FROM sig GROUP BY model")
def epoch_refresh(spark, d):
    """Counts of an epoch, the greatest of stored, kept and fresh, and whether it is complete."""
    g = signals(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("direction") != "neutral").alias("kept"), F.countDistinct("user_id").alias("fresh"))
    return g.select("model", "stored", F.greatest("stored", "kept", "fresh").alias("raw"), (F.col("stored") == F.col("kept")).alias("complete"))


@query("source_registry", "SELECT source, 'configured' AS kind FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT DISTINCT 'nation_' || n_nationkey, 'managed' FROM nation UNION ALL SELECT DISTINCT r_name, 'managed' FROM region WHERE r_name NOT IN (SELECT source FROM documents)", base=False)
def source_registry(spark, d):
    """Configured sources and the managed ones that they lack."""
    a = table(spark, d, "documents").select("source").distinct()
    b = table(spark, d, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("source")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("source"))).distinct()
    return a.withColumn("kind", F.lit("configured")).unionByName(b.join(a, "source", "left_anti").withColumn("kind", F.lit("managed")))


@query("report_factor", r"WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) AS s FROM documents) SELECT doc_id, count(*) AS n FROM s WHERE contains(lower(s), 'tion') AND contains(lower(s), 'the') GROUP BY doc_id", base=False)
def report_factor(spark, d):
    """C11: sentences in which an alias and a report marker stand together."""
    s = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[.!?][ \t\n\r\f]+")).alias("s"))
    return s.where("contains(lower(s), 'tion') AND contains(lower(s), 'the')").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("archive_snapshots", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, CASE WHEN rn > 1 THEN 'duplicate' WHEN contains(text, '!!') THEN 'edited' END AS skipped, substr({TITLE}, 1, 500) AS content FROM r", base=False)
def archive_snapshots(spark, d):
    """The first row of each external id; edited rows are skipped; content is a title cut to its limit."""
    t = titled(spark, d).withColumn("h", F.md5(F.col("text").cast("binary")))
    first = t.groupBy("h").agg(F.min("doc_id").alias("first"))
    skipped = F.when(F.col("doc_id") != F.col("first"), "duplicate").when(F.col("text").contains("!!"), "edited")
    return t.join(first, "h").select("doc_id", skipped.alias("skipped"), F.substring("title", 1, 500).alias("content"))


@query("src_iss_rows", " SELECT bar_id, ticker, open FROM bars")
def src_iss_rows(spark, d):
    """Columnar JSON (columns and rows of values) back to rows, by the place of each column."""
    from ..sources.feeds import columnar_rows

    row = F.array(F.col("bar_id").cast("string"), "ticker", F.col("open").cast("string"))
    payload = F.to_json(F.struct(F.array(F.lit("ID"), F.lit("TICKER"), F.lit("OPEN")).alias("columns"), F.collect_list(row).alias("data")))
    pages = bars(spark, d).groupBy(F.floor(F.col("bar_id") / 500)).agg(payload.alias("payload"))
    return columnar_rows(pages, "payload", {"bar_id": ("ID", "long"), "ticker": ("TICKER", "string"), "open": ("OPEN", "double")})


@query("src_market_opens", ", m AS (SELECT ticker, date_trunc('minute', bars.at) AS t, open FROM bars WHERE open > 0) SELECT ticker, epoch_us(t) AS minute_us, min(open) AS open, min(open) <> max(open) AS conflict FROM m GROUP BY ticker, t")
def src_market_opens(spark, d):
    """Finite positive opens by minute; differing ones at a minute are a conflict."""
    m = bars(spark, d).where("open > 0 AND NOT isnan(open) AND open < double('infinity')").groupBy("ticker", F.date_trunc("minute", F.col("at").cast("timestamp")).alias("t"))
    return m.agg(F.min("open").alias("open"), (F.min("open") != F.max("open")).alias("conflict")).select("ticker", F.unix_micros("t").alias("minute_us"), "open", "conflict")
