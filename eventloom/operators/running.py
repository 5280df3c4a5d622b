"""Running sums and previous rows over long orders, without a task that holds a whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1_024


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False, inclusive: bool = True, totals: bool = False) -> DataFrame:
    """df with a running sum of column sums[name] as `name`, in the order of a number that is unique within `by`.

    The order is cut to RANGES equal ranges between its ends; totals of the ranges before are added to what runs within
    one. totals: the sum over all as `name`_total too.
    """
    key = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(1))
    ends = rows.groupBy(*key).agg(F.min(order).cast("double").alias("__low"), F.max(order).cast("double").alias("__high"))  # one row a group
    part = F.when(F.col("__high") > F.col("__low"), F.floor((F.col(order).cast("double") - F.col("__low")) / (F.col("__high") - F.col("__low")) * RANGES)).otherwise(0)
    rows = rows.join(ends, key).withColumn("__part", part).drop("__low", "__high")
    parts = rows.groupBy(*key, "__part").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    along = lambda c: F.desc(c) if descending else F.asc(c)
    before = Window.partitionBy(*key).orderBy(along("__part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"__t_{n}").over(Window.partitionBy(*key)).alias(f"{n}_total") for n in sums] if totals else []
    parts = parts.select(*key, "__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums], *whole)
    within = Window.partitionBy(*key, "__part").orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({f"__w_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(parts, [*key, "__part"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__w_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums], *[f"{n}_total" for n in sums if totals])


def previous(df: DataFrame, key: str, bucket: Column, order: list[str], columns: dict[str, str]) -> DataFrame:
    """df with column columns[name] of the row before, by key and order, as `name`; null for a key's first row.

    bucket: a coarse part of the order, such as its day. A bucket's first row takes the last row of the bucket before, so a
    hot key is as many tasks as it has buckets.
    """
    rows = df.withColumn("__bucket", bucket)
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    lasts = rows.groupBy(key, "__bucket").agg(F.max_by(row, F.struct(*order)).alias("__row"))
    lasts = lasts.select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), F.lag("__row").over(Window.partitionBy(key).orderBy("__bucket")).alias("__carried"))  # a row a bucket
    seen = rows.withColumn("__before", F.lag(row).over(Window.partitionBy(key, "__bucket").orderBy(*order)))
    out = seen.join(lasts, seen[key].eqNullSafe(F.col("__key")) & seen["__bucket"].eqNullSafe(F.col("__of")), "left").withColumn("__before", F.coalesce("__before", "__carried"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__before.{n}").alias(n) for n in columns])
