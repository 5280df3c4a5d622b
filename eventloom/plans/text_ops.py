"""Text to features, signals and pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import plain_text, text_hash, tokens
from ..sources.fixtures import table
from .registry import query

TITLE = "string_split(text, chr(10))[1]"
TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^a-zа-яё0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3))"


def titled(spark, d):
    return table(spark, d, "documents").withColumn("title", F.split("text", "\n")[0])


@query("tokenize_title", f"SELECT doc_id, len({TOKENS.format(x=TITLE)}) AS n, array_to_string(list_sort({TOKENS.format(x=TITLE)}), ' ') AS tokens FROM documents", base=False)
def tokenize_title(spark, d):
    """X1."""
    t = titled(spark, d).select("doc_id", tokens(F.col("title")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("text_hash", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS digest FROM documents", base=False)
def text_hash_query(spark, d):
    """X24."""
    return table(spark, d, "documents").select("doc_id", text_hash(F.col("text")).alias("digest"))


@query("txt_html_plain", """WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|iframe)[^>]*>.*?</(script|style|iframe)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b)
SELECT page_id, regexp_replace(trim(regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g')), ' ([.,;:!?])', '\\1', 'g') AS plain FROM c""", base=False)
def txt_html_plain(spark, d):
    """S2."""
    return table(spark, d, "pages").select("page_id", plain_text(F.col("html")).alias("plain"))


@query("near_dup_pairs", f"""WITH t AS (SELECT doc_id, source, {TOKENS.format(x=TITLE)} AS w FROM documents), p AS (SELECT a.doc_id AS x, b.doc_id AS y, len(list_intersect(a.w, b.w)) / CAST(least(len(a.w), len(b.w)) AS DOUBLE) AS o FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id AND b.doc_id - a.doc_id <= 48 AND len(a.w) > 0 AND len(b.w) > 0)
SELECT x, y, round(o, 6) AS overlap FROM p WHERE o >= 0.6""", base=False)
def near_dup_pairs(spark, d):
    """Title pairs of one source within 48 hours (documents are an hour apart) that share 0.6 of the smaller token set.

    They meet on source, token and a 48-hour bucket, the later side in its own bucket and the one before.
    """
    t = titled(spark, d).select("doc_id", "source", tokens(F.col("title")).alias("w"))
    e = t.select("source", F.explode("w").alias("k"), F.col("doc_id").alias("x"), F.size("w").alias("nx"), F.floor(F.col("doc_id") / 48).alias("slot"))
    later = e.select("source", "k", F.col("x").alias("y"), F.col("nx").alias("ny"), F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"))
    near = e.join(later, ["source", "k", "slot"]).where("x < y AND y - x <= 48")
    shared = near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    o = F.col("c") / F.least("nx", "ny")
    return shared.where(o >= 0.6).select("x", "y", F.round(o, 6).alias("overlap"))


@query("time_features", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, isodow(ts) - 1 AS weekday, CASE WHEN hour(ts) < 7 THEN 'pre_open' WHEN hour(ts) * 60 + minute(ts) < 950 THEN 'main' ELSE 'post_close' END AS session FROM events", base=False)
def time_features(spark, d):
    """X20."""
    h = F.hour("ts")
    angle = 2 * F.pi() * h / 24
    session = F.when(h < 7, "pre_open").when(h * 60 + F.minute("ts") < 950, "main").otherwise("post_close")
    return table(spark, d, "events").select("event_id", F.round(F.sin(angle), 6).alias("hour_sin"), F.round(F.cos(angle), 6).alias("hour_cos"), F.weekday("ts").cast("long").alias("weekday"), session.alias("session"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", base=False)
def json_extract(spark, d):
    """Typed reading of JSON; wrong kinds are null."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_raw = "[split_part(text, ' ', 1), CAST(doc_id AS VARCHAR), 'Infinity', '-inf', 'NaN', 'true', '1e3', ''][1 + doc_id % 8]"


@query("num_guard", f"SELECT doc_id, CASE WHEN isfinite(TRY_CAST({_raw} AS DOUBLE)) THEN TRY_CAST({_raw} AS DOUBLE) END AS x FROM documents", base=False)
def num_guard(spark, d):
    """Strings that are not finite numbers are null; words for infinity, NaN and truth are no numbers."""
    raw = F.element_at(F.array(F.split("text", " ")[0], F.col("doc_id").cast("string"), *map(F.lit, ("Infinity", "-inf", "NaN", "true", "1e3", ""))), (F.col("doc_id") % 8 + 1).cast("int"))
    x = table(spark, d, "documents").select("doc_id", raw.alias("s")).select("doc_id", F.expr("try_cast(s AS double)").alias("x"))
    return x.select("doc_id", F.when(F.abs("x") < float("inf"), F.col("x")).alias("x"))


@query("baselines", "SELECT event_id, CASE WHEN CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 2) AS INTEGER) % 2 = 0 THEN 'up' ELSE 'down' END AS coin, 'up' AS always, CASE WHEN value > lag(value) OVER w THEN 'up' WHEN value < lag(value) OVER w THEN 'down' ELSE 'flat' END AS momentum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", base=False)
def baselines(spark, d):
    """The coin of a digest's first byte, always up, and the sign of the last move (flat where there is none)."""
    first = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    last = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("last", last)
    return e.select("event_id", F.when(first % 2 == 0, "up").otherwise("down").alias("coin"), F.lit("up").alias("always"), F.when(F.col("value") > F.col("last"), "up").when(F.col("value") < F.col("last"), "down").otherwise("flat").alias("momentum"))
