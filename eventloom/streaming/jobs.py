"""Streaming forms: idempotent ingest, tumbling buckets, keyed upserts, polling lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """ST3: the first row of each key within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def buckets(stream: DataFrame, event_time: str, by: list[str], size: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """ST8: counts by tumbling window; what is later than the delay is left out by the watermark."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def upsert_to(path: str, keys: list[str], order: list[str]):
    """A foreachBatch sink that keeps the latest row of each key; a batch seen again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        now = f"{path}/v{batch_id}"
        old = [s.getPath().toString() for s in fs.listStatus(target) if int(s.getPath().getName()[1:]) < batch_id] if fs.exists(target) else []
        rows = batch
        if old:
            last = max(old, key=lambda p: int(p.rpartition("/v")[2]))
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(last))
        rest = [c for c in batch.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
        best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*batch.columns).write.mode("overwrite").parquet(now)

    return write


def delayed_evaluation(
    signals: DataFrame, bars: DataFrame, hours: int = 4, tolerance: str = "20 minutes", delay: str = "10 minutes", key: str = "ticker", decided: str = "decision_at", bar_time: str = "at"
) -> DataFrame:
    """ST5: each signal with the bars from its target on, for so long as the tolerance; one without any once that time is past.

    Both are streams with watermarks. State holds a signal until its target plus tolerance, and bars no longer than signals
    may still ask for them. A signal's earliest bar is its outcome; a null price means missed_window.
    """
    own = signals.withColumn("target_at", F.col(decided) + F.expr(f"INTERVAL '{hours}' HOUR")).withWatermark("target_at", delay)
    prices = bars.withColumnsRenamed({key: "__key", bar_time: "__bar_at"}).withWatermark("__bar_at", delay)
    near = (F.col(key) == F.col("__key")) & (F.col("__bar_at") >= F.col("target_at")) & (F.col("__bar_at") <= F.col("target_at") + F.expr(f"INTERVAL {tolerance}"))
    return own.join(prices, near, "leftOuter").drop("__key").withColumnRenamed("__bar_at", "observed_at")
