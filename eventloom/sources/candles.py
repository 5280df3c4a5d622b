"""Candles of landed pages as a data source.

A landing job leaves, for each ticker, pages of `page_rows` candles: folder/ticker=T/start=N holds the page that was asked
for from row N on, as {"candles": {"columns": [...], "data": [[...], ...]}}. A ticker ends with its first short page. The
source deals runs of pages to partitions, so that a ticker with a third of all candles is many tasks, and checks what it
can see: pages follow each other without gaps, only the last is short, none is longer. What spans pages is left to Spark:
identical candles count once, different ones of a minute are an error, local times become UTC.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import by_value, text_of

PRICES = ("open", "close", "high", "low", "value", "volume")
SCHEMA = "ticker string, start long, begin string, " + ", ".join(f"{p} double" for p in PRICES)


class Run(InputPartition):
    """Consecutive pages of a ticker; `last`: nothing stands behind them."""

    def __init__(self, ticker: str, folder: str, starts: list[int], last: bool):
        self.ticker, self.folder, self.starts, self.last = ticker, folder, starts, last


class CandlePages(DataSource):
    """spark.read.format("candle_pages").load(folder); options: page_rows, run_pages, max_pages, tickers (joined by commas)."""

    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)


class CandleReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.rows, self.run, self.most = (int(options.get(k, v)) for k, v in (("page_rows", 500), ("run_pages", 64), ("max_pages", 1_000_000)))
        self.tickers = options.get("tickers")

    def partitions(self) -> list[Run]:
        out: list[Run] = []
        landed = by_value(self.path, "ticker")
        for ticker in sorted(set(self.tickers.split(",")) if self.tickers else landed):
            starts = sorted(map(int, by_value(f"{self.path}/{landed[ticker]}", "start"))) if ticker in landed else []
            if starts != [n * self.rows for n in range(len(starts))]:
                raise ValueError(f"{ticker}: pages don't follow each other: {starts[:5]} ...")
            if len(starts) > self.most:
                raise ValueError(f"{ticker}: {len(starts)} pages, {self.most} at most")
            out += [Run(ticker, f"{self.path}/{landed.get(ticker)}", starts[a : a + self.run], a + self.run >= len(starts)) for a in range(0, len(starts), self.run)]
        return out

    def read(self, partition: Run):
        for start in partition.starts:
            page = json.loads(text_of(f"{partition.folder}/start={start}"))["candles"]
            at, data = {c: n for n, c in enumerate(page["columns"])}, page["data"]
            if len(data) > self.rows or len(data) < self.rows and not (partition.last and start == partition.starts[-1]):
                raise ValueError(f"{partition.ticker}, page of {start}: {len(data)} rows, but it is not the last")
            for row in data:
                yield (partition.ticker, start, row[at["begin"]], *(None if p not in at or row[at[p]] is None else float(row[at[p]]) for p in PRICES))


def land_pages(candles: DataFrame, folder: str, order: list[str], page_rows: int = 500) -> None:
    """Write candles (ticker, begin and prices) as pages, as a landing job would leave them: for tests and queries.

    Rows are placed by counts of days first, so that no task orders a ticker.
    """
    from pyspark.sql import Window

    day = candles.withColumn("__day", F.substring("begin", 1, 10))
    before = Window.partitionBy("ticker").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    starts = day.groupBy("ticker", "__day").agg(F.count(F.lit(1)).alias("n")).select("ticker", "__day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    place = F.col("__first") + F.row_number().over(Window.partitionBy("ticker", "__day").orderBy(*order)) - 1
    placed = day.join(starts, ["ticker", "__day"]).withColumn("__at", place)
    fields = ["begin", *[p for p in PRICES if p in candles.columns]]
    row = F.struct(F.col("__at"), F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.get(F.split(F.to_json(F.array(F.col(f))), r"^\[|\]$"), F.lit(1)), F.lit("null")) for f in fields]), F.lit("]")).alias("j"))
    pages = placed.groupBy("ticker", (F.floor(F.col("__at") / page_rows) * page_rows).alias("start")).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # page_rows at most
    head = json.dumps(fields)
    text = F.concat(F.lit('{"candles":{"columns":' + head + ',"data":['), F.array_join("rows.j", ","), F.lit("]}}"))
    pages.select("ticker", "start", text.alias("value")).write.partitionBy("ticker", "start").text(folder)


def read_candles(spark: SparkSession, folder: str, zone: str = "Europe/Moscow", **options) -> DataFrame:
    """ticker, at (UTC), prices and copies: one row a ticker and minute; different candles of one minute are an error."""
    spark.dataSource.register(CandlePages)
    raw = spark.read.format("candle_pages").options(**options).load(folder)
    at = F.to_utc_timestamp(F.to_timestamp_ntz("begin").cast("timestamp_ntz"), zone).alias("at")
    raw = raw.select("ticker", at, F.struct(*PRICES).alias("p"))
    one = raw.groupBy("ticker", "at").agg(F.min("p").alias("p"), F.max("p").alias("q"), F.count(F.lit(1)).alias("copies"))
    checked = F.when(F.col("p") == F.col("q"), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("conflicting candles: "), "ticker", F.lit(" "), F.col("at").cast("string"))))
    return one.select("ticker", "at", checked.alias("p"), "copies").select("ticker", "at", "p.*", "copies")
