"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

A source's rows are dealt to blocks of `block_rows`. Its k-th block (from 0) in a phase is released at
k / w and due at (k + 1) / w, w its exact share of the phase; earliest deadline first among released blocks
then keeps every source within less than one block of its target at every slot. Each slot follows from the one
before, so the driver lays out the blocks one by one, in whole numbers, and writes the plan in parts of PLAN_ROWS. Blocks
grow with the table, so that they are about PLAN_BLOCKS at most and one more a source: the driver's time is bounded
however large the table is. Each source that runs out starts the schedule anew, so its time grows with the square of the
number of sources. The rows meet the plan in a join. When a source runs
out, the others go on in a new phase with their weights scaled up: every row gets a place, none is dropped or repeated.

Nulls: a null source counts as the source ''. Sources without a target share by their number of rows.
An empty table gives an empty table. Repeated rows each get their own place.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless_index, salts_for, shared_dir

#: Blocks of the plan that the driver holds at a time.
PLAN_ROWS = 1 << 16
#: Rows a block, and about how many blocks the driver lays out at most: of more rows the blocks are longer.
BLOCK_ROWS, PLAN_BLOCKS = 16, 1 << 20
RESULTS = ("mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def edf(weights: dict[str, float]) -> Iterator[tuple[str, int, int, int]]:
    """(source, k, release, deadline) of slot after slot without end, by earliest deadline first at the exact weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * unit) for s, w in exact.items()}
    total = sum(parts.values())
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, str, int, int]] = []
    for s in parts:
        heapq.heappush(waiting, (0, s, 0))
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-((-(k + 1) * total) // parts[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline
        heapq.heappush(waiting, ((k + 1) * total // parts[s], s, k + 1))
        slot += 1


def edf_period(parts: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """The first sum(parts) slots of edf, after which it repeats."""
    return list(islice(edf(parts), sum(parts.values())))


def phases(
    blocks: dict[str, int], weights: dict[str, float], slot: int = 0, place: Callable[[str, int, int, int, int], None] | None = None
) -> list[dict]:
    """The phases, each up to the slot in which a source runs out: first slot, and by source its first block and parts.

    Each block is handed to `place` as (source, block, slot, release, deadline); slots count from `slot`.
    """
    left, done, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        first, at = {s: done[s] for s in left}, slot
        for s, k, release, deadline in edf({s: weights[s] for s in left}):
            if place:
                place(s, first[s] + k, at, slot + release, slot + deadline)
            at += 1
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        out.append({"slot": slot, "cycles": 1, "parts": {s: done[s] - n for s, n in first.items()}, "first": first})
        slot = at
    return out


def placed(docs: DataFrame, weights: dict[str, float] | None, source_col: str, id_col: str, block_rows: int | None) -> DataFrame:
    """__user, a struct of the columns of docs, with the columns RESULTS under names of their own (__mix_...): none can clash."""
    spark = docs.sparkSession
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__user"), F.col(id_col).alias("__id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__mix_source"))
    counts = named.groupBy("__mix_source").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a source
    rows = {r[0]: r[1] for r in counts}
    total = sum(rows.values())
    size = block_rows or max(BLOCK_ROWS, -(-total // PLAN_BLOCKS))
    if bad := [s for s, w in (weights or {}).items() if not 0 <= w < float("inf")]:
        raise ValueError(f"weights have to be finite and not negative: {bad}")
    target = {s: float((weights or {}).get(s, n**0.5 if not weights else n / max(1, total))) for s, n in rows.items()}
    blocks = {s: -(-n // size) for s, n in rows.items()}
    # Literals, parsed by the JVM: nothing of the plan passes through Python workers.
    path, held = f"{shared_dir(spark)}/eventloom/mix-plan-{uuid.uuid4().hex}", []
    kinds = "s string, k long, n long, r long, d long"

    def write() -> None:
        rows_of = F.from_json(F.lit(json.dumps(held)), "array<struct<s:string,k:long,n:long,r:long,d:long>>")
        spark.range(1).select(F.inline(rows_of)).write.mode("append").parquet(path)
        held.clear()

    def place(*block) -> None:
        held.append(dict(zip("sknrd", block)))
        if len(held) >= PLAN_ROWS:
            write()

    phases({s: n for s, n in blocks.items() if target[s]}, target, 0, place)
    behind = {s: n for s, n in blocks.items() if not target[s]}  # a weight of 0: behind all others, in proportion to their rows
    phases(behind, {s: float(rows[s]) for s in behind}, sum(blocks.values()) - sum(behind.values()), place)
    write()
    plan = spark.read.schema(kinds).parquet(path).toDF("__mix_s", "__mix_k", "__mix_slot", "__mix_release", "__mix_deadline")
    salts = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps([{"s": s, "c": n} for s, n in rows.items()])), "array<struct<s:string,c:long>>"))
    ).select(F.col("s").alias("__mix_source"), salts_for(F.col("c")).alias("__salts"))
    salted = named.join(F.broadcast(salts), "__mix_source")  # one row a source
    indexed = gapless_index(salted, "__mix_source", "__salts", ["__id"], "__mix_at").withColumn("__mix_block", F.floor(F.col("__mix_at") / F.lit(size)))
    met = indexed.join(plan, (F.col("__mix_source") == F.col("__mix_s")) & (F.col("__mix_block") == F.col("__mix_k")))
    return met.withColumn("__mix_position", F.col("__mix_slot") * F.lit(size) + F.col("__mix_at") % F.lit(size))


def pfair_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int | None = None,
) -> DataFrame:
    """Every row of docs with mix_source, mix_block, mix_slot, mix_release, mix_deadline and mix_position.

    mix_slot is the slot of the row's block; mix_position sorts the rows. weights None: tempered, the square root of a
    source's rows. block_rows None: BLOCK_ROWS, or as many more as keep the plan at PLAN_BLOCKS blocks. A source that
    weights don't name weighs its share of rows; one of weight 0 stands behind all others; a weight that is negative or not
    finite is an error. A column of docs that is named like a result gives way to it.
    """
    out = placed(docs, weights, source_col, id_col, block_rows)
    own = [F.col(f"__user.`{c}`") for c in docs.columns if c not in RESULTS]
    return out.select(*own, *[F.col(f"__{c}").alias(c) for c in RESULTS])


def in_mixed_order(
    docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int | None = None
) -> DataFrame:
    """docs with its columns and all its rows, in the order of the mix: files and rows within them follow the position."""
    mixed = placed(docs, weights, source_col, id_col, block_rows)
    return mixed.repartitionByRange("__mix_position").sortWithinPartitions("__mix_position").select("__user.*")


def with_file_position(docs: DataFrame, out: str = "mix_position") -> DataFrame:
    """docs, read from the files of in_mixed_order, with each row's place from 0: files by name, rows by index.

    Readers pack files by size, so the order of the rows they return says nothing. Only the counts of the files are sorted:
    one row a file goes through the window.
    """
    at = docs.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = at.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    files = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return at.join(F.broadcast(files), "__file").select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("__start") + F.col("__row")).alias(out))
