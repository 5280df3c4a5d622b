"""Queries that run the stateful forms to their end over whole tables: evaluation with timers, keyed merges, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import bars, signals
from ..sources.lineage import describe_files, verify_files
from ..sources.shared import scratch
from ..streaming.evaluation import ROCKS, evaluate_signals
from ..streaming.upserts import merge_into, read_upserted
from .registry import query


@query("stream_evaluation", """, d AS (SELECT signal_id, ticker, decision_at + INTERVAL 4 HOUR AS target FROM sig WHERE signal_id % 5 = 0 AND ticker IS NOT NULL), b AS (SELECT ticker, bars.at AS t, min(open) AS open FROM bars GROUP BY 1, 2),
w2 AS (SELECT (least((SELECT max(epoch_us(t)) FROM b), (SELECT max(epoch_us(target)) - 14400000000 FROM d)) - 600000000) // 1000 AS mark),
o AS (SELECT signal_id, d.ticker, epoch_us(target) AS target_us, min(epoch_us(t)) AS observed_us, arg_min(open, t) AS price FROM d LEFT JOIN b ON b.ticker = d.ticker AND t >= target AND t <= target + INTERVAL 20 MINUTE GROUP BY ALL)
SELECT signal_id, ticker, target_us, observed_us, price, CASE WHEN observed_us IS NULL THEN 'missed_window' ELSE 'evaluated' END AS status FROM o WHERE (target_us + 1200000000) // 1000 + 1 <= (SELECT mark FROM w2)""")
def stream_evaluation(spark, d):
    """ST5: a signal in five against all bars, through the stream with timers; those whose deadline the watermark hasn't passed stay pending."""
    into, out, check = ({n: scratch(spark, f"evaluation-{n}") for n in ("signals", "bars")}, scratch(spark, "evaluated"), scratch(spark, "evaluation-checkpoint"))
    signals(spark, d).where("signal_id % 5 = 0").select("signal_id", "ticker", F.col("decision_at").cast("timestamp").alias("decision_at")).write.parquet(into["signals"])
    bars(spark, d).select("ticker", F.col("at").cast("timestamp").alias("at"), F.col("open").alias("price")).write.parquet(into["bars"])
    read = lambda n, schema: spark.readStream.schema(schema).parquet(into[n])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        final = evaluate_signals(read("signals", "signal_id long, ticker string, decision_at timestamp"), read("bars", "ticker string, at timestamp, price double"))
        job = final.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            job.processAllAvailable()
        finally:
            job.stop()
        if job.exception():
            raise job.exception()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(final.schema).parquet(out)


@query("upsert_batches", " SELECT user_id, epoch_us(max(decision_at)) AS at_us, arg_max(signal_id, (decision_at, signal_id)) AS signal_id, count(*) > 0 AS known FROM sig GROUP BY user_id")
def upsert_batches(spark, d):
    """Every signal merged by user in three batches, each of which replaces the partitions that it has keys of."""
    path = scratch(spark, "upserts")
    for n in (2, 0, 1):  # order doesn't matter
        merge_into(signals(spark, d).where(F.col("signal_id") % 3 == n).select("user_id", F.col("decision_at").cast("timestamp").alias("at"), "signal_id"), path, ["user_id"], ["at"], parts=16)
    return read_upserted(spark, path).select("user_id", F.unix_micros("at").alias("at_us"), "signal_id", F.lit(True).alias("known"))


@query("lineage_check")
def lineage_check(spark, d):
    """Each file of the folder with its length, rows and digest, and what a check against a manifest says of it."""
    found = describe_files(spark, d)
    return found.join(verify_files(spark, found, d), "file")
