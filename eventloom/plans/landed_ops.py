"""Paged candles and channel archives: landed by Spark from the tables, read back by the sources of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.archive import archived_posts, land_archive
from ..sources.candles import land_pages, read_candles
from ..sources.fixtures import bars, table
from ..sources.shared import scratch
from .registry import query


@query("paged_candles", """, m AS (SELECT ticker, bars.at AS t, arg_min(open, bar_id) AS open, min(bar_id) AS id FROM bars GROUP BY 1, 2)
SELECT ticker, epoch_us(t - INTERVAL 3 HOUR) AS at_us, open, CAST(CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies FROM m""")
def paged_candles(spark, d):
    """Pages of 500 candles in local time, one in ten twice, as rows in UTC."""
    one = bars(spark, d).groupBy("ticker", "at").agg(F.min_by("open", "bar_id").alias("open"), F.min("bar_id").alias("id"))
    twice = one.unionByName(one.where("id % 10 = 0"))
    folder = scratch(spark, "candle-pages")
    land_pages(twice.select("ticker", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("begin"), "open", "id"), folder, ["begin", "id"])
    return read_candles(spark, folder).select("ticker", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "open", "copies")


@query("archive_posts", """SELECT coalesce(source, 'none') AS channel, doc_id + 1 AS message_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE) AS published_us,
length(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ([.,;:!?])', '\\1', 'g')) AS n_chars, doc_id % 4 = 0 AS edited FROM documents WHERE trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) <> ''""", base=False)
def archive_posts(spark, d):
    """Every document as a post of its source's channel, archived backwards by a stream that is stopped and goes on."""
    minute = F.expr("TIMESTAMP '2024-01-01 00:00:00'") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    posts = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("channel"), (F.col("doc_id") + 1).alias("message_id"), minute.alias("published"), "text", (F.col("doc_id") % 4 == 0).alias("edited"))
    folder, out, check = scratch(spark, "archive"), scratch(spark, "posts"), scratch(spark, "posts-checkpoint")
    land_archive(posts.where("text IS NOT NULL"), folder, run_pages=16)
    for pages in (8, 64):  # the second run begins where the first one stopped
        stream = archived_posts(spark, folder, pages=pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            if pages == 64:
                stream.processAllAvailable()
            else:
                while stream.isActive and not stream.lastProgress:
                    stream.awaitTermination(0.2)
        finally:
            stream.stop()
        if stream.exception():
            raise stream.exception()
    return spark.read.schema("channel string, message_id long, published timestamp, text string, edited boolean").parquet(out).select("channel", "message_id", F.unix_micros("published").alias("published_us"), F.char_length("text").cast("long").alias("n_chars"), "edited")
