"""Delayed evaluation with timers, keyed upserts, lineage of files."""

import hashlib
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventloom.sources.lineage import describe_files, verify_files
from eventloom.streaming.evaluation import ROCKS, Evaluation, evaluate_signals
from eventloom.streaming.upserts import PART, merge_into, read_upserted, upsert_sink


def test_one_final_row_a_signal(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    signals, bars, out, check = (str(tmp_path / x) for x in ("signals", "bars", "out", "check"))
    at = lambda c: F.to_timestamp(F.concat(F.lit("2024-01-01 "), F.col(c)))

    def put(rows, folder):
        if folder == signals:
            df = spark.createDataFrame(rows, "signal_id long, ticker string, s string").select("signal_id", "ticker", at("s").alias("decision_at"))
        else:
            df = spark.createDataFrame(rows, "ticker string, s string, price double").select("ticker", at("s").alias("at"), "price")
        df.coalesce(1).write.mode("append").parquet(folder)

    put([(1, "a", "00:00:00"), (2, "a", "00:30:00"), (3, "a", "00:55:00"), (4, "b", "00:00:00"), (1, "a", "00:00:00"), (None, "a", "00:00:00")], signals)
    put([("a", "04:15:00", 1.5), ("a", "04:50:01", 9.0), ("b", "03:59:59", 7.0), ("b", "04:20:00", None)], bars)
    read = lambda folder: spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    job = evaluate_signals(read(signals), read(bars)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
    try:
        job.processAllAvailable()
        assert spark.read.schema("signal_id long").parquet(out).count() == 0  # all pending
        put([("a", "04:05:00", 1.4), ("a", "05:10:00", 3.0), ("a", "04:55:00", 2.5)], bars)  # earlier bars refresh the outcome
        job.processAllAvailable()
    finally:
        job.stop()
    job = evaluate_signals(read(signals), read(bars)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()  # state outlives a stop
    try:
        put([(9, "z", "09:00:00")], signals)
        put([("z", "09:00:00", 1.0)], bars)
        job.processAllAvailable()
        put([("a", "04:01:00", 0.1), ("z", "09:01:00", 1.0)], bars)  # behind the watermark
        put([(10, "z", "09:01:00"), (11, "a", "00:01:00")], signals)
        job.processAllAvailable()
    finally:
        job.stop()
    rows = spark.read.parquet(out).collect()
    us = lambda h, m, s=0: 1704067200_000000 + (h * 3600 + m * 60 + s) * 1_000_000
    assert sorted((r.signal_id, r.status, r.observed_us, r.price) for r in rows) == [
        (1, "evaluated", us(4, 5), 1.4), (2, "missed_window", None, None), (3, "evaluated", us(4, 55), 2.5), (4, "missed_window", None, None)
    ]


class Handle:
    """State of one key, and how often it is called."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getMapState(self, name, *_):
        return Held(self)

    getValueState = getMapState


class Held:
    def __init__(self, handle):
        self.handle, self.value, self.map = handle, None, {}

    def call(self, do):
        self.handle.calls += 1
        return do()

    def get(self):
        return self.call(lambda: self.value)

    def update(self, value):
        self.call(lambda: setattr(self, "value", value))

    def clear(self):
        self.call(lambda: setattr(self, "value", None))

    def iterator(self):
        return self.call(lambda: iter(list(self.map.items())))

    def updateValue(self, k, v):
        self.call(lambda: self.map.__setitem__(k, v))

    def removeKey(self, k):
        self.call(lambda: self.map.pop(k, None))


def test_calls_to_state_dont_grow_with_the_rows_of_a_key():
    handle, e = Handle(), Evaluation(1_200_000_000)
    e.init(handle)
    minute = 60_000_000
    rows = [Row(id=None, at=n * minute + 1, price=float(n)) for n in range(80)] + [Row(id=n, at=n * minute // 10, price=None) for n in range(600)]
    list(e.handleInputRows(("a", 0), iter(rows[:300]), None))
    list(e.handleInputRows(("a", 0), iter(rows[300:]), None))
    out = []
    for mark in (40 * minute // 1000, 200 * minute // 1000):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)  # noqa: B023
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.remove(t)
            out += e.handleExpiredTimer(("a", 0), now, SimpleNamespace(getExpiryTimeInMs=lambda: t))  # noqa: B023
    assert sorted((r.signal_id, r.observed_us, r.price) for r in out) == [(n, -(-(n * minute // 10 - 1) // minute) * minute + 1 if n else 1, float(-(-(n * minute // 10 - 1) // minute)) if n else 0.0) for n in range(600)]
    assert handle.calls < 40 and all(s.value is None for s in (e.signals, e.bars)) and not handle.timers


def test_a_merge_touches_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    first = merge_into(df([(i, 1, f"v{i}") for i in range(200)] + [(None, 1, "none")]), path, ["k"], ["at"], parts=16)
    assert first == list(range(16))
    files = lambda: {(d, f) for d in os.listdir(path) if d.startswith(PART) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    before = files()
    changed = df([(3, 2, "new"), (4, 0, "old"), (500, 1, "more"), (3, 1, "x"), (None, 2, "other")])
    touched = merge_into(changed, path, ["k"], ["at"], parts=16)
    assert 0 < len(touched) <= 4 and {d for d, _ in before - files()} == {f"{PART}={p}" for p in touched} == {d for d, _ in files() - before}
    expected = {i: (1, f"v{i}") for i in range(200)} | {3: (2, "new"), 500: (1, "more"), None: (2, "other")}
    got = lambda: {r.k: (r.at, r.v) for r in read_upserted(spark, path).collect()}
    assert got() == expected and read_upserted(spark, path).count() == len(expected)
    upsert_sink(path, ["k"], ["at"], 16)(changed, 7)  # seen again
    assert got() == expected
    assert merge_into(changed.limit(0), path, ["k"], ["at"], parts=16) == []


def test_ties_do_not_depend_on_batches(spark, tmp_path):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "z")]
    df = lambda r: spark.createDataFrame(r, "k long, at long, v string")
    for n, order in enumerate(([0, 1, 2], [1, 0, 2], [2, 1, 0])):
        path = str(tmp_path / str(n))
        for i in order:
            merge_into(df([rows[i]]), path, ["k"], ["at"], parts=4)
        assert [tuple(r) for r in read_upserted(spark, path).collect()] == [(1, 5, "b")]


def test_lineage(spark, tmp_path):
    folder = tmp_path / "data"
    spark.range(100).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).repartition(3).write.parquet(str(folder))
    found = describe_files(spark, str(folder), range_bytes=1000).collect()
    assert len(found) == 3 and sum(r.rows for r in found) == 100
    for r in found:
        raw = (folder / r.file).read_bytes()
        ranges = [raw[a : a + 1000] for a in range(0, len(raw), 1000)]
        assert r.length == len(raw) and len(ranges) > 1 and r.digest == hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in ranges)).hexdigest()
    manifest = spark.createDataFrame(found)
    status = lambda m, **k: {r.file: (r.status, r.repeated_ids) for r in verify_files(spark, m, str(folder), range_bytes=1000, **k).collect()}
    a, b, c = sorted(r.file for r in found)
    assert status(manifest, id_col="id") == {f: ("ok", 0) for f in (a, b, c)}
    changed = manifest.withColumn("rows", F.when(F.col("file") == a, F.col("rows") + 1).otherwise(F.col("rows"))).withColumn("digest", F.when(F.col("file") == b, "0").otherwise(F.col("digest")))
    changed = changed.where(F.col("file") != c).unionByName(spark.createDataFrame([("gone.parquet", 1, "x", 1)], manifest.schema))
    assert status(changed) == {a: ("rows", None), b: ("digest", None), c: ("undeclared", None), "gone.parquet": ("missing", None)}
    spark.createDataFrame([(5, "again"), (5, "again"), (1000, "new")], "id long, x string").coalesce(1).write.mode("append").parquet(str(folder))
    now = status(manifest, id_col="id")
    assert sorted(now.values(), key=str) == sorted([("ok", 0), ("ok", 0), ("ok", 1), ("undeclared", 2)], key=str)
    with pytest.raises(Exception):
        spark.createDataFrame(found).select("none").collect()
