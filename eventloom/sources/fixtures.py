"""The provided tables in their domain roles: price bars, signals, a benchmark series, news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced(price: str = "value") -> Column:
    """Whether a price is usable: finite and positive (null and NaN are not)."""
    return (F.col(price) > 0) & (F.col(price) < float("inf"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, at, open, bar_id: usable from `at` on, since they hold opens. Prices that aren't finite and positive are no bars."""
    return table(spark, sf_dir, "events").where(priced()).select(
        F.col("event_type").alias("ticker"), F.col("ts").alias("at"), F.col("value").alias("open"), F.col("event_id").alias("bar_id")
    )


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole market's series: one open at each time, over all tickers."""
    events = table(spark, sf_dir, "events").where(priced())
    return events.groupBy(F.col("ts").alias("at")).agg(F.min_by("value", "event_id").alias("open"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a signal at its own time."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").withColumn("k", k)
    return base.select(
        F.col("event_id").alias("signal_id"),
        F.col("event_type").alias("ticker"),
        F.col("ts").alias("decision_at"),
        "user_id",
        "k",
        F.when(F.col("k") >= 66, "up").when(F.col("k") <= 33, "down").otherwise("neutral").alias("direction"),
        (2 * (F.col("k") - 50)).cast("double").alias("score"),
        (F.col("k") / 100).alias("confidence"),
        (F.col("user_id") % 3).alias("model"),
    )


#: The same roles for DuckDB, as common table expressions.
SQL = """WITH bars AS (SELECT event_type AS ticker, ts AS at, value AS open, event_id AS bar_id FROM events WHERE value > 0 AND value < CAST('inf' AS DOUBLE)),
bench AS (SELECT ts AS at, arg_min(value, event_id) AS open FROM events WHERE value > 0 AND value < CAST('inf' AS DOUBLE) GROUP BY ts),
base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
sig AS (SELECT event_id AS signal_id, event_type AS ticker, ts AS decision_at, user_id, k,
  CASE WHEN k >= 66 THEN 'up' WHEN k <= 33 THEN 'down' ELSE 'neutral' END AS direction,
  CAST(2 * (k - 50) AS DOUBLE) AS score, k / CAST(100 AS DOUBLE) AS confidence, user_id % 3 AS model FROM base)
"""
