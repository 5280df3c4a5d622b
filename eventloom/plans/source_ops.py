"""Feeds, channel pages and rebuild graphs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feeds import channel_posts, rss_items
from ..sources.fixtures import table
from .registry import query

_day = lambda n: F.date_format(F.expr("TIMESTAMP '2024-01-01 00:00:00'") + F.make_dt_interval(hours=n.cast("int")), "dd MMM yyyy HH:mm:ss")


@query("src_rss_items", "SELECT doc_id // 50 AS feed, 'Item ' || doc_id AS title, 'g' || doc_id AS guid, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR) AS published_us, 'Length ' || n_chars || ' & more' AS body FROM documents WHERE doc_id % 7 <> 3", base=False)
def src_rss_items(spark, d):
    """The items of feeds of up to 50 documents each; one in seven lacks its guid and goes."""
    n, chars = F.col("doc_id"), F.col("n_chars").cast("string")
    text = n.cast("string")
    guid = F.when(n % 7 == 3, "").otherwise(F.concat(F.lit("<guid>g"), text, F.lit("</guid>")))
    body = F.concat(F.lit("&lt;p&gt;Length "), chars, F.lit(" &amp;amp; more&lt;/p&gt;"))
    item = F.concat(F.lit("<item><title>Item "), text, F.lit("</title><link>https://x.example/"), text, F.lit("</link>"), guid, F.lit("<pubDate>Mon, "), _day(n), F.lit(" +0000</pubDate><description>"), body, F.lit("</description></item>"))
    feeds = table(spark, d, "documents").groupBy(F.floor(n / 50).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("xml"))  # 50 rows a feed
    return rss_items(feeds).select("feed", "title", "guid", F.unix_micros("published").alias("published_us"), "body")


@query("src_channel_posts", "SELECT doc_id // 20 AS page, 'ch/' || doc_id AS post_id, 'Text of ' || doc_id || ' here' AS text, doc_id % 4 = 0 AS edited FROM documents WHERE doc_id % 9 <> 5", base=False)
def src_channel_posts(spark, d):
    """The messages of pages of up to 20 posts each; one in nine has no time and goes."""
    n = F.col("doc_id")
    text = n.cast("string")
    time = F.when(n % 9 == 5, "").otherwise(F.lit('<time datetime="2024-01-01T00:00:00+00:00"></time>'))
    edited = F.when(n % 4 == 0, '<span class="message_meta">edited </span>').otherwise('<span class="message_meta"></span>')
    post = F.concat(F.lit('<div class="w message x" data-post="ch/'), text, F.lit('"><div class="message_text js">Text of<br/>'), text, F.lit(" <b>here</b></div>"), edited, time, F.lit("</div>"))
    pages = table(spark, d, "documents").groupBy(F.floor(n / 20).alias("page")).agg(F.concat(F.lit("<html>"), F.array_join(F.array_sort(F.collect_list(post)), "\n")).alias("html"))  # 20 rows a page
    return channel_posts(pages).select("page", "post_id", "text", "edited")


def reachable(edges: DataFrame, start: DataFrame, towards: str, come_from: str) -> DataFrame:
    """Nodes that edges lead to from `start`, itself included: a join for each step, until none is new. Graphs of steps are small."""
    seen = start.select(F.col(start.columns[0]).alias("node")).distinct()
    new = seen
    while not new.isEmpty():
        new = edges.join(new, edges[come_from] == new["node"]).select(F.col(towards).alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(new)
    return seen


@query("rebuild", """WITH RECURSIVE e AS (SELECT n_nationkey // 2 AS a, n_nationkey AS b FROM nation WHERE n_nationkey > 0), down AS (SELECT 1 AS n UNION SELECT e.b FROM e JOIN down ON e.a = down.n), up AS (SELECT 22 AS n UNION SELECT e.a FROM e JOIN up ON e.b = up.n)
SELECT CAST(n AS BIGINT) AS step FROM down WHERE n IN (SELECT n FROM up) AND n <> 1""", base=False)
def rebuild(spark, d):
    """The steps that a change of `start` makes necessary for `final`: downstream of the one and upstream of the other."""
    edges = table(spark, d, "nation").where("n_nationkey > 0").select(F.floor(F.col("n_nationkey") / 2).cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    one = lambda n: spark.range(n, n + 1)
    down, up = reachable(edges, one(1), "b", "a"), reachable(edges, one(22), "a", "b")
    return down.join(up, "node", "left_semi").where("node <> 1").select(F.col("node").alias("step"))


@query("src_jsonl", "SELECT event_id, user_id, value FROM events", base=False)
def src_jsonl(spark, d):
    """Rows of JSON lines; a malformed line would fail the query."""
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    return lines.select(F.from_json("value", "event_id long, user_id long, value double", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("page_keyset_export", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) SELECT CAST(n // 1000 AS BIGINT) AS page, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n FROM r GROUP BY n // 1000""", base=False)
def page_keyset_export(spark, d):
    """The whole table as pages of 1000 keys in rising order, with each page's first and last key.

    Places come from counts by range of keys, so no task orders the table.
    """
    keys = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 65_536).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))  # one row a range
    placed = keys.join(starts, "part").withColumn("n", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")) - 1)
    return placed.groupBy(F.floor(F.col("n") / 1000).alias("page")).agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count(F.lit(1)).alias("n"))
