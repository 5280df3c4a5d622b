"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts), largest first, go to the least-loaded shard through a heap. Groups of
at least a HEAVY-th part of all bytes are scheduled each by itself. The rest is hashed to bundles, which are
scheduled with them, so that what the driver holds is bounded whatever the input: HEAVY groups and BUNDLES bundles.
Two equal texts always share a group, so a group never splits; a bundle holds more than one group only where these are
less than 1 / HEAVY of the bytes, and no bundle has much more than 1 / BUNDLES of them beside that.

Nulls: a null text counts as the empty text (0 bytes, so size 1); a null doc_id is an ordinary value.
An empty table gives an empty table. Columns named like the results are not read and do not clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_index, materialize, salts_for

HEAVY, BUNDLES = 4_096, 16_384
LAWS = ("bytes", "rows", "key")


def schedule(loads: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(item, load) pairs to item -> shard: largest load first to the least-loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        least, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (least + load, shard))
    return out


def lpt_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bundles: int = BUNDLES, heavy: int = HEAVY
) -> DataFrame:
    """Every row's size, text_crc32, law, shard, slot and grown_shard, under the law `bytes`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    )
    narrow = materialize(narrow, "shard-sizes")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = narrow.groupBy("content").agg(F.sum("size").alias("load"))
    large = groups.where(F.col("load") * F.lit(heavy) >= F.lit(total)).collect()  # at most `heavy` rows
    # Items: bundles from 0, then the heavy groups in order of their content.
    own = spark.createDataFrame([(r[0], bundles + n) for n, r in enumerate(sorted(large))], "content long, heavy int")
    item = F.coalesce("heavy", F.pmod(F.xxhash64("content"), F.lit(bundles)).cast("int")).alias("item")
    narrow = narrow.join(F.broadcast(own), "content", "left").select("doc_id", "size", "text_crc32", item)
    items = narrow.groupBy("item").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).collect()  # at most `heavy` + `bundles` rows
    shard_of = schedule([(r.item, r.load) for r in items], shards)
    # Shards are numbered through their items: a shard's items lie one after the other.
    plan, filled = [], [0] * shards
    for r in sorted(items):
        plan.append((r.item, shard_of[r.item], r.n, filled[shard_of[r.item]]))
        filled[shard_of[r.item]] += r.n
    plan = spark.createDataFrame(plan, "item int, shard int, n long, begin long").withColumn("salts", salts_for(F.greatest("n", F.lit(1)))).drop("n")
    sharded = narrow.join(F.broadcast(plan), "item")
    indexed = gapless_index(sharded, "item", "salts", ["doc_id", "text_crc32"], "__at")
    return indexed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("begin") + F.col("__at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
