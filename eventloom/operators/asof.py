"""As-of joins by one sort: both sides are laid in one order and the last (or next) bar is carried along.

Key and time bucket make the partitions, so that a hot key is many tasks. A summary, one bar per key and bucket, says
what each bucket inherits from those before it; inside a bucket a window with an unbounded-preceding frame (linear)
carries bars along. No range join. Rows at equal times are placed by strictness. A tolerance voids a match that is too
far; it never moves on to another bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, out: str,
    forward: bool = True, strict: bool | Column = False, tolerance_s: float | None = None, bucket_s: int = 86_400,
) -> DataFrame:
    """left with `out` (the matched bar's value) and `out`_at (its time); both null where nothing matches.

    forward: the first bar after (at, unless strict) left_time; else the last before. strict may be a column of left. A null
    left time matches nothing, and neither does a null key.
    """
    key = on or ["__all"]
    if not on:
        left, right = left.withColumn("__all", F.lit(1)), right.withColumn("__all", F.lit(1))
    strict = strict if isinstance(strict, Column) else F.lit(strict)
    # A row looks back in the order of windows, so what it may match at its own time has to stand before it.
    rows = left.select("*", F.col(left_time).alias("__t"), F.when(strict, 0).otherwise(2).alias("__tie"))
    bars = right.dropna(subset=[*key, right_time]).select(
        *key, F.col(right_time).alias("__t"), F.lit(1).alias("__tie"), F.struct(F.col(value).alias("v"), F.col(right_time).alias("t")).alias("__bar")
    )
    both = rows.unionByName(bars, allowMissingColumns=True)
    both = both.withColumn("__b", F.floor(F.unix_seconds(F.col("__t").cast("timestamp")) / bucket_s))
    when, bucket = (F.col("__t").desc(), F.col("__b").desc()) if forward else (F.col("__t").asc(), F.col("__b").asc())
    back = (Window.unboundedPreceding, -1)
    edge = (F.min_by if forward else F.max_by)("__bar", F.when(F.col("__bar").isNotNull(), F.col("__t")))
    ends = both.groupBy(*key, "__b").agg(edge.alias("__end"))
    heirs = ends.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(key)], F.col("__b").alias("__c"), F.last("__end", ignorenulls=True).over(Window.partitionBy(*key).orderBy(bucket).rowsBetween(*back)).alias("__old"))
    same = [both[k].eqNullSafe(heirs[f"__k{n}"]) for n, k in enumerate(key)]
    both = both.join(heirs, [*same, both["__b"].eqNullSafe(heirs["__c"])], "left")
    frame = Window.partitionBy(*key, "__b").orderBy(when, "__tie").rowsBetween(*back)
    seen = both.withColumn("__hit", F.coalesce(F.last("__bar", ignorenulls=True).over(frame), "__old")).where("__tie <> 1")
    usable = F.col("__t").isNotNull() & F.col("__hit").isNotNull()
    if tolerance_s is not None:
        lag = F.abs(F.unix_micros(F.col("__hit.t").cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp")))
        usable = usable & (lag <= int(tolerance_s * 1_000_000))
    kept = [c for c in left.columns if c != "__all"]
    return seen.select(*kept, F.when(usable, F.col("__hit.v")).alias(out), F.when(usable, F.col("__hit.t")).alias(f"{out}_at"))


def goal_values(
    left: DataFrame, row_id: str, right: DataFrame, on: list[str], right_time: str, value: str, goals: dict[str, tuple], forward: bool = True, strict: bool = False
) -> DataFrame:
    """row_id, on, a value and its time (`name`, `name`_at) for each goal: name -> (time column, tolerance in seconds[, strict]).

    A row for each row of left that has the time of any goal. All goals go through one as-of pass, so the bars are laid out
    once; row_id is unique in left.
    """
    each = F.array(*[F.struct(F.lit(name).alias("goal"), F.col(time).alias("t"), F.lit(tolerance).alias("tolerance"), F.lit(own[0] if own else strict).alias("strict")) for name, (time, tolerance, *own) in goals.items()])
    rows = left.select(row_id, *on, F.explode(each).alias("g")).select(row_id, *on, "g.*").where("t IS NOT NULL")  # a goal without a time matches nothing
    hit = asof_join(rows, right, on, "t", right_time, value, "v", forward, F.col("strict"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = F.abs(micros("v_at") - micros("t")) <= F.col("tolerance").cast("long") * 1_000_000
    of = lambda name, c: F.max(F.when((F.col("goal") == name) & near, F.col(c)))
    return hit.groupBy(row_id).agg(*[F.max(k).alias(k) for k in on], *[a for name in goals for a in (of(name, "v").alias(name), of(name, "v_at").alias(f"{name}_at"))])


def asof_goals(
    left: DataFrame, row_id: str, right: DataFrame, on: list[str], right_time: str, value: str, goals: dict[str, tuple], forward: bool = True, strict: bool = False
) -> DataFrame:
    """left with the columns of goal_values.

    left is read twice, and thrice by the next such step on its result: where steps build on each other, take goal_values of
    narrow tables instead, and join once.
    """
    return left.join(goal_values(left, row_id, right, on, right_time, value, goals, forward, strict).drop(*on), row_id, "left")
