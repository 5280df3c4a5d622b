"""Sinks: flat CSV and JSON exports, and publishing that never overwrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in their order: others are left out, missing ones are null."""
    return df.select(*[F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header, whose first name carries the byte-order mark that spreadsheets look for."""
    flat = only(df, fields)
    flat.withColumnRenamed(fields[0], "﻿" + fields[0]).write.csv(path, header=True, emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str, fields: list[str], compressed: bool = True) -> None:
    """JSON lines, null fields included."""
    only(df, fields).write.json(path, compression="gzip" if compressed else "none", ignoreNullFields=False)


def publish(df: DataFrame, path: str) -> None:
    """A table that appears whole or not at all, and never takes the place of another."""
    spark = df.sparkSession
    target, staged = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    df.write.parquet(staged.toString())
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, True)
        raise FileExistsError(path)
