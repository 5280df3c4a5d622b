"""What a manifest declares of a dataset's files, against the files.

A file's digest is the sha256 of the sha256s of its byte ranges of RANGE bytes, in order: ranges are read by tasks of their own,
so that a file of any size is many bounded pieces. Row counts come from the files' footers. All files are one job.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system

RANGE = 8 << 20


def describe_files(spark: SparkSession, folder: str, range_bytes: int = RANGE, pattern: str = "*.parquet") -> DataFrame:
    """file (relative to folder), length, digest and rows of each file below the folder."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")  # contents aren't read
    ranges = listed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))))

    def run(batches):
        for batch in batches:
            digests, rows = [], []
            for path, length, at in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = file_system(path)
                with system.open_input_file(name) as f:
                    digests.append(hashlib.sha256(f.read_at(min(range_bytes, length - at), at)).digest())
                    rows.append(pq.ParquetFile(f).metadata.num_rows if at == 0 and name.endswith(".parquet") else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(rows, pa.int64())], names=["path", "length", "at", "d", "rows"])

    read = ranges.repartition("path", "at").mapInArrow(run, "path string, length long, at long, d binary, rows long")
    each = read.groupBy("path").agg(F.max("length").alias("length"), F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("at", "d"))).alias("ds"))  # 32 bytes a range
    joined = F.aggregate("ds", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["d"]))
    base = folder.rstrip("/").rpartition("/")[2] + "/"
    return each.select(F.substring_index("path", base, -1).alias("file"), "length", F.sha2(joined, 256).alias("digest"), "rows")


def verify_files(spark: SparkSession, manifest: DataFrame, folder: str, id_col: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """A row for each file of the manifest (file, digest, rows) or the folder: file, status, repeated_ids.

    status: ok, missing, undeclared, digest or rows. repeated_ids: rows of the file whose id, over all files, isn't unique; null
    where no id column is named (the files then needn't share a schema).
    """
    found = describe_files(spark, folder, range_bytes)
    declared = manifest.select("file", F.col("digest").alias("d"), F.col("rows").alias("r"), F.lit(True).alias("declared"))
    both = declared.join(found.withColumn("found", F.lit(True)), "file", "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("d") != F.col("digest"), "digest").when(~F.col("r").eqNullSafe(F.col("rows")), "rows").otherwise("ok")
    out = both.select("file", status.alias("status"))
    if id_col is None:
        return out.withColumn("repeated_ids", F.lit(None).cast("long"))
    base = folder.rstrip("/").rpartition("/")[2] + "/"
    ids = spark.read.option("recursiveFileLookup", "true").parquet(folder).select(F.substring_index("_metadata.file_path", base, -1).alias("file"), F.col(id_col).alias("id"))
    # Counts by id and file are combined before the shuffle; an id's files meet once.
    by_id = ids.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum("n").alias("all"), F.collect_list(F.struct("file", "n")).alias("fs"))  # at most a pair a file
    repeated = by_id.where("all > 1").select(F.explode("fs").alias("f")).groupBy("f.file").agg(F.sum("f.n").alias("repeated_ids"))
    return out.join(repeated, "file", "left").withColumn("repeated_ids", F.coalesce("repeated_ids", F.lit(0)).cast("long"))
