"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Learning may use a row when crc32 of its id, as text, leaves another remainder than 1 by 3.
HELD_OUT_REMAINDER = 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = context_dir.get() if context_dir.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._eventloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table behind a materialize() result that nothing reads any more."""
    path = getattr(df, "_eventloom_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files and broadcasts of finished stages now: it acts when the driver's heap is collected.

    Heap that isn't used any more goes back to the system by this as well, and so does what the driver's Python has freed.
    """
    gc.collect()
    give_back()
    spark._jvm.System.gc()


#: What operators keep in a worker from task to task.
_kept: dict[str, dict] = {}


def kept_in_worker(name: str) -> dict:
    """An operator's own dictionary of what it keeps in a worker."""
    return _kept.setdefault(name, {})


def begin(own: str | None = None) -> None:
    """A task begins: what other operators keep in this worker goes. Workers live on from stage to stage, so it would add up."""
    others = [kept for name, kept in _kept.items() if kept and name != own]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Return memory that this worker has freed to the system: workers live on from stage to stage, what they keep adds up."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces_of(batch, column: int, most: int = 2_000_000) -> Iterator:
    """An Arrow batch in slices whose values of a string or binary column have about so many bytes, a longer value alone."""
    import pyarrow.compute as pc

    if not len(batch):
        yield batch
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def held_out(doc_id: Column) -> Column:
    """True for rows that learning must not see (null ids count as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT_REMAINDER, F.lit(True))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salts_for(rows: Column, rows_a_salt: int = 2048) -> Column:
    """How many sub-groups a group of so many rows is dealt to."""
    return F.ceil(rows / F.lit(rows_a_salt)).cast("long")


def gapless_index(df: DataFrame, group: str, salts: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without a task that holds a whole group.

    `salts` is a column with the group's number of sub-groups (see salts_for), the same in all its rows.
    Rows are numbered within (group, salt), and the sizes of the sub-groups before are added. The order
    is pseudo-random but repeatable; rows that are equal in every column of `order` may swap places.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.col(salts)))
    cells = salted.groupBy(group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(group, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(group, "__salt").orderBy(*[F.col(c) for c in order])
    numbered = salted.withColumn("__rn", F.row_number().over(within))
    return (
        numbered.join(cells, [group, "__salt"])
        .withColumn(out, (F.col("__start") + F.col("__rn") - 1).cast("long"))
        .drop("__salt", "__rn", "__start", salts)
    )
