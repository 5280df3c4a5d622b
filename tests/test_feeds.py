"""Readers on small feeds whose rows are known."""

import gzip

import pytest

from eventloom.sources.feeds import assert_read_only, bounded_lines, channel_posts, columnar_rows, rss_items

RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:y="http://y"><channel><title>f</title>
<item><title>One</title><link>http://a/1</link><guid>1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0300</pubDate><description>short</description><content:encoded>&lt;p&gt;longer&lt;/p&gt;</content:encoded></item>
<item><title>Two</title><link>http://a/2</link><guid>2</guid><pubDate>Tue, 02 Jan 2024 10:00:00 +0300</pubDate><description>only</description><y:full-text>whole</y:full-text></item>
<item><title>No date</title><link>http://a/3</link><guid>3</guid><description>x</description></item>
<item><link>http://a/4</link><guid>4</guid><pubDate>Tue, 02 Jan 2024 10:00:00 +0300</pubDate></item></channel></rss>"""

PAGE = """<html><div class="wrap"><div class="tg_message js" data-post="c/1"><div class="message_text">Hello<br/>there <b>you</b></div><time datetime="2024-01-01T10:00:00+00:00"></time></div>
<div class="tg_message js" data-post="c/2"><div class="message_text">Again</div><span class="message_meta">edited <time datetime="2024-01-01T11:00:00+00:00"></time></span></div>
<div class="tg_message js" data-post="c/3"><div class="message_text"></div><time datetime="2024-01-01T12:00:00+00:00"></time></div></div>"""


def test_rss_items(spark):
    feeds = spark.createDataFrame([(1, RSS), (2, ""), (3, None)], "feed int, xml string")
    rows = sorted((r["guid"], r["title"], r["body"]) for r in rss_items(feeds).collect())
    assert rows == [("1", "One", "longer"), ("2", "Two", "whole")]
    assert [r["guid"] for r in rss_items(feeds, max_items=1).collect()] == ["2"]


def test_channel_posts(spark):
    rows = sorted(tuple(r) for r in channel_posts(spark.createDataFrame([(PAGE,), (None,), ("",)], "html string")).select("post_id", "text", "edited").collect())
    assert rows == [("c/1", "Hello there you", False), ("c/2", "Again", True)]


def test_bounded_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in bounded_lines(spark, str(tmp_path), "a int", 10).collect()) == [1, 2]
    with pytest.raises(ValueError):
        bounded_lines(spark, str(tmp_path), "a int", 1)


def test_columnar_rows_and_guard(spark):
    df = spark.createDataFrame([('{"columns": ["B", "A"], "data": [["x", "1"], ["y", "bad"]]}',), (None,)], "p string")
    assert [tuple(r) for r in columnar_rows(df, "p", {"a": ("A", "int"), "b": ("B", "string")}).collect()] == [(1, "x"), (None, "y")]
    assert assert_read_only("SELECT 1")
    for bad in ("DROP TABLE t", "SELECT 1; DELETE FROM t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError):
            assert_read_only(bad)
