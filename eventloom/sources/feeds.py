"""Readers of feeds, channel pages, bounded line files and columnar JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_text

MAX_BYTES = 8_000_000

ITEM = "title string, link string, guid string, pubDate string, description string, full_text string, content string"


def rss_items(feeds: DataFrame, xml: str = "xml", max_items: int | None = None) -> DataFrame:
    """One row per item of each feed text: title, link, guid, published, body; newest first within a feed.

    Feeds over 8 MB give nothing; items without title, link, guid or a readable date go; the full text is taken before
    encoded content, and that before the description. Columns of the feeds stay; a feed is one row, so items of one
    feed are ordered within it.
    """
    parsed = F.from_xml(F.regexp_replace(F.regexp_replace(F.col(xml), r"<(/?)content:encoded", "<$1content"), r"<(/?)[A-Za-z]*:?full-text", "<$1full_text"), f"struct<channel: struct<item: array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in ITEM.split(','))}>>>>")
    own = [c for c in feeds.columns if c != xml]
    items = feeds.where(F.octet_length(xml) <= MAX_BYTES).select(*own, F.explode(parsed["channel"]["item"]).alias("i"))
    body = F.coalesce("i.full_text", "i.content", "i.description")
    at = F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    out = items.select(*own, *[F.trim(f"i.{c}").alias(c) for c in ("title", "link", "guid")], at.alias("published"), plain_text(body).alias("body"))
    out = out.where("title <> '' AND link <> '' AND guid <> '' AND published IS NOT NULL")
    if max_items is None:
        return out
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("published"), "guid")) if own else F.row_number().over(Window.orderBy(F.desc("published"), "guid"))
    return out.withColumn("__n", rank).where(F.col("__n") <= max_items).drop("__n")


def channel_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Messages of public channel pages: id, time, text and whether it was edited. Columns of the pages stay."""
    own = [c for c in pages.columns if c != html]
    parts = F.slice(F.split(F.col(html), r'(?=<div class="[^"]*message[^"]*" data-post=)'), 2, 2_000_000)

    def post(p: Column) -> Column:
        first = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
        return F.struct(
            first(r'data-post="([^"]+)"').alias("post_id"),
            F.try_to_timestamp(first(r'<time[^>]*datetime="([^"]+)"')).alias("published"),
            plain_text(F.regexp_replace(first(r'(?s)<div class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>'), r"<br ?/?>", " ")).alias("text"),
            p.rlike(r"(?s)message_meta[^>]*>\s*edited").alias("edited"),
        )

    out = pages.select(*own, F.inline(F.transform(parts, post)))  # what is filtered below is worked out once, not in the filter as well
    return out.where("post_id IS NOT NULL AND published IS NOT NULL AND text <> ''")


def bounded_lines(spark: SparkSession, path: str, schema: str, max_rows: int, max_line: int = 1_000_000) -> DataFrame:
    """JSON lines, gzipped or not, that fail on bad rows, on lines over max_line and on more rows than max_rows."""
    lines = spark.read.text(path)
    size = lines.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("value")).alias("m")).first()
    if size.n > max_rows or (size.m or 0) > max_line:
        raise ValueError(f"{path}: {size.n} rows, longest line of {size.m} bytes; allowed are {max_rows} and {max_line}")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def columnar_rows(df: DataFrame, payload: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of payloads {"columns": [...], "data": [[...], ...]}; fields map a name to its column and type."""
    p = df.select(F.from_json(payload, "columns array<string>, data array<array<string>>").alias("p")).select("p.columns", F.explode("p.data").alias("row"))

    def pick(column: str, kind: str) -> Column:
        return F.try_element_at("row", F.array_position("columns", column).cast("int")).try_cast(kind)

    return p.select(*[pick(c, k).alias(name) for name, (c, k) in fields.items()])


def assert_read_only(sql: str) -> str:
    """The statement itself, if it only reads."""
    import re

    if not re.match(r"(?is)^\s*(select|with)\b", sql) or re.search(r"(?is)\b(insert|update|upsert|delete|drop|alter|create|replace|truncate|grant|merge)\b", sql) or ";" in sql.rstrip().rstrip(";"):
        raise ValueError("only one reading statement is allowed")
    return sql
