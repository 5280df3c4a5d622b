"""Paged candles and the resumable archive: dedup, conflicts, gaps, stops and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom.sources.archive import archived_posts, land_archive
from eventloom.sources.candles import land_pages, read_candles


def page(folder, ticker, start, rows):
    at = folder / f"ticker={ticker}" / f"start={start}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(json.dumps({"candles": {"columns": ["open", "begin", "close"], "data": rows}}))


def test_candles(spark, tmp_path):
    minute = lambda n: f"2024-01-01 {n // 60:02}:{n % 60:02}:00"
    rows = [[10.0 + n, minute(n), None] for n in range(7)]
    for start in (0, 3, 6):
        page(tmp_path, "AA", start, rows[start : start + 3])
    page(tmp_path, "B%20B", 0, [[1.0, minute(0), 2.0], [1.0, minute(0), 2.0], [3.0, minute(200), 2.0]])
    page(tmp_path, "B%20B", 3, [])
    got = read_candles(spark, str(tmp_path), page_rows=3, run_pages=2).orderBy("ticker", "at").collect()
    assert [(r.ticker, r.open, r.copies) for r in got] == [*(("AA", 10.0 + n, 1) for n in range(7)), ("B B", 1.0, 2), ("B B", 3.0, 1)]
    assert got[0].close is None and str(got[0].at) == "2023-12-31 21:00:00" and str(got[-1].at) == "2024-01-01 00:20:00"
    assert read_candles(spark, str(tmp_path), page_rows=3, tickers="AA").count() == 7


@pytest.mark.parametrize("pages,said", [({0: 2, 3: 1}, "not the last"), ({0: 3, 6: 1}, "follow"), ({0: 4}, "not the last")])
def test_candle_pages_that_cannot_be(spark, tmp_path, pages, said):
    for start, n in pages.items():
        page(tmp_path, "AA", start, [[1.0, f"2024-01-01 00:{start + i:02}:00", None] for i in range(n)])
    with pytest.raises(Exception, match=said):
        read_candles(spark, str(tmp_path), page_rows=3).collect()


def test_conflicting_candles(spark, tmp_path):
    page(tmp_path, "AA", 0, [[1.0, "2024-01-01 00:00:00", None], [2.0, "2024-01-01 00:00:00", None]])
    with pytest.raises(Exception, match="conflicting candles: AA"):
        read_candles(spark, str(tmp_path), page_rows=3).collect()


def test_landed_pages_come_back(spark, tmp_path):
    rows = [("T", f"2024-01-0{1 + n // 30} 10:{n % 30:02}:00", n / 3) for n in range(75)] + [("U", "2024-01-01 00:00:00", None)]
    land_pages(spark.createDataFrame(rows, "ticker string, begin string, open double"), str(tmp_path / "x"), ["begin"], page_rows=10)
    assert len(list((tmp_path / "x" / "ticker=T").glob("start=*"))) == 8
    got = read_candles(spark, str(tmp_path / "x"), zone="UTC", page_rows=10).collect()
    assert sorted((r.ticker, str(r.at), r.open) for r in got) == sorted(rows)


def posts(spark, n):
    some = spark.range(n).withColumn("channel", F.when(F.col("id") % 3 == 0, "aa").otherwise("bb"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    return some.select("channel", (F.col("id") * 7 + 5).alias("message_id"), at.alias("published"), F.concat(F.lit("a <b> & "), F.col("id").cast("string")).alias("text"), (F.col("id") % 4 == 0).alias("edited"))


def test_archive_resumes(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    own = posts(spark, 500)
    land_archive(own, folder, page_posts=9)

    def run(batches=None):
        stream = archived_posts(spark, folder, pages=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            if batches is None:
                stream.processAllAvailable()
            while batches and (stream.lastProgress or {"batchId": -1})["batchId"] < batches and stream.isActive:
                pass
        finally:
            stream.stop()
        if stream.exception():
            raise stream.exception()

    key = lambda df: sorted((r.channel, r.message_id, r.published, r.text, r.edited) for r in df.collect())
    run(2)  # stopped on the way
    some = spark.read.parquet(out).count()
    assert 0 < some < 500
    run()
    assert key(spark.read.parquet(out)) == key(own)
    run()  # nothing new
    # Older posts land later, and the stream goes on behind them.
    older = posts(spark, 500).withColumn("message_id", F.col("message_id") - 10_000)
    low = tmp_path / "in" / "channel=aa"
    oldest = min(int(p.name.partition("=")[2]) for p in low.glob("before=*"))
    (low / f"before={1}").mkdir()
    (low / "before=1" / "part-0.txt").write_text('<html><div class="message" data-post="aa/0"><div class="message_text">first</div><time datetime="2020-01-01T00:00:00+00:00"></time></div>')
    assert oldest > 1 and older.count() == 500
    run()
    assert spark.read.parquet(out).count() == 501
    (low / "before=0").mkdir()
    (low / "before=0" / "part-0.txt").write_text('<html><div class="message" data-post="aa/77"><div class="message_text">astray</div><time datetime="2020-01-01T00:00:00+00:00"></time></div>')
    with pytest.raises(Exception, match="out of its page"):
        run()
