"""Keyed upserts into a table that is partitioned by hash of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "upsert_part"


def part_of(keys: list[str], parts: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(parts)).cast("int")


def merge_into(batch: DataFrame, path: str, keys: list[str], order: list[str], parts: int = 64) -> list[int]:
    """Keep the latest row of each key, by `order`, of the table at path and the batch; returns the partitions that were written.

    Only partitions that the batch has keys of are read and replaced (dynamic partition overwrite: new files are written
    aside and take the place of the old ones when the job is done). A batch seen again changes no row. Of rows that are equal
    in `order` the greatest by the other columns stays. Null keys are keys. An empty batch writes nothing. The number of
    partitions is the table's own: 1,000 of them to some TB keep a merge small.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])) if rest else F.lit(None)
    latest = lambda df: df.groupBy(*keys).agg(best.alias("b")).select(*[F.col(f"b.{c}").alias(c) if c in rest else F.col(c) for c in batch.columns])
    new = latest(batch).withColumn(PART, part_of(keys, parts)).persist()
    try:
        touched = sorted(r[0] for r in new.select(PART).distinct().collect())  # `parts` numbers at most
        if touched:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            old = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
            both = new
            if old:
                had = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, {PART} int").parquet(path).where(F.col(PART).isin(touched))
                both = new.unionByName(had)
            merged = latest(both.drop(PART)).withColumn(PART, part_of(keys, parts))
            merged.repartition(min(len(touched), 10_000), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
        return touched
    finally:
        new.unpersist()


def upsert_sink(path: str, keys: list[str], order: list[str], parts: int = 64):
    """merge_into as a foreachBatch sink."""
    return lambda batch, batch_id: merge_into(batch, path, keys, order, parts)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)
