"""Archives of many pages: packed in runs, dealt to few tasks, and not listed again for each batch."""

import pytest
from pyspark.sql import functions as F

from eventloom.sources import archive
from eventloom.sources.archive import ArchiveReader, archived_posts, land_archive


def drained(reader):
    """The tasks of each batch until nothing new is found."""
    out, last = [], reader.initialOffset()
    while (now := reader.latestOffset()) != last:
        out.append(reader.partitions(last, now))
        last = now
    return out


def test_listing_and_tasks_follow_the_input(tmp_path, monkeypatch):
    for channel in ("aa", "bb"):
        for n in range(1, 401):
            (tmp_path / f"channel={channel}" / f"before={n}").mkdir(parents=True)
    seen, real = [0], archive.folders
    monkeypatch.setattr(archive, "folders", lambda uri: seen.__setitem__(0, seen[0] + len(got := real(uri))) or got)
    batches = drained(ArchiveReader({"path": str(tmp_path), "pages": "20"}))
    assert len(batches) == 20 and all(len(b) == 4 for b in batches)  # 20 pages a channel: 16 and 4
    got = [(p.channel, before, until) for b in batches for p in b for _, before, until in p.landed]
    assert sorted(got) == sorted((c, n, n - 1) for c in ("aa", "bb") for n in range(1, 401))
    assert seen[0] <= 4 * 800  # not 800 for every batch


def test_older_pages_are_found_behind_a_known_chain(tmp_path):
    for n in range(101, 151):
        (tmp_path / "channel=aa" / f"before={n}").mkdir(parents=True)
    reader = ArchiveReader({"path": str(tmp_path), "pages": "20"})
    first = reader.latestOffset()
    for n in range(51, 101):
        (tmp_path / "channel=aa" / f"before={n}").mkdir()
    batches = [reader.partitions({}, first)]
    while (now := reader.latestOffset()) != first:
        batches.append(reader.partitions(first, now))
        first = now
    assert [x[1:] for b in batches for p in b for x in p.landed] == [(n, n - 1 if n > 51 else 0) for n in range(150, 50, -1)]


def test_runs(spark, tmp_path):
    """Packed pages give the same posts in a stream that stops and goes on; a page of its own may follow; a cut run is an error."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    some = spark.range(500).withColumn("channel", F.when(F.col("id") % 3 == 0, "a a").otherwise("b-b"))
    own = some.select("channel", (F.col("id") * 300 + 5).alias("message_id"), F.timestamp_seconds(F.col("id") * 60).alias("published"), F.concat(F.lit('a <b> & "\n'), "id", F.lit("\\ ")).alias("text"), F.lit(False).alias("edited"))
    land_archive(own, folder, page_posts=9, run_pages=4)
    runs = list((tmp_path / "in").glob("channel=*/run=*"))
    assert 15 <= len(runs) <= 20 and not list((tmp_path / "in").glob("channel=*/before=*"))
    reader = ArchiveReader({"path": folder, "pages": "3"})
    pages = [(c, before, until) for b in drained(reader) for p in b for c, before, until, _ in reader.read(p)]
    for channel in ("a a", "b-b"):
        chain = [x[1:] for x in pages if x[0] == channel]
        assert chain == sorted(chain, reverse=True) and all(a[1] == b[0] for a, b in zip(chain, chain[1:])) and chain[-1][1] == 0
    assert len(pages) >= 56

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

    run(1)
    low = tmp_path / "in" / "channel=a a" / "before=5"
    low.mkdir()
    (low / "part-0.txt").write_text('<html><div class="message" data-post="a a/1"><div class="message_text">first</div><time datetime="2020-01-01T00:00:00+00:00"></time></div>')
    run()
    got = sorted((r.channel, r.message_id, r.published, r.text) for r in spark.read.parquet(out).where("text <> 'first'").collect())
    assert got == sorted((r.channel, r.message_id, r.published, f'a <b> & " {r.text.split(chr(10))[1].strip()}') for r in own.collect())
    assert spark.read.parquet(out).count() == 501
    cut = tmp_path / "cut" / "channel=c" / "run=9-2"
    cut.mkdir(parents=True)
    (cut / "part-0.txt").write_text('{"before":9,"html":"<html>"}\n')
    reader = ArchiveReader({"path": str(tmp_path / "cut")})
    with pytest.raises(ValueError, match="isn't whole"):
        [list(reader.read(p)) for b in drained(reader) for p in b]
