"""Walk-forward folds by calendar month, in which later partitions win groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_folds(df: DataFrame, time: str, known: str, group: str, months: list[str], validation_months: int = 2, embargo: str = "72 HOURS") -> DataFrame:
    """df with fold and part (train, validation, test), a row for each fold that takes it.

    A fold tests a month ("2024-05"). Validation is the months before it, up to the embargo before the test, of rows whose
    label was `known` by then; training is all before the validation's beginning less the embargo, known by then as well.
    Rows of a group that a later partition of the fold has too go from the earlier one. Rows without a group conflict with
    none; rows without a time or a known label are in no training or validation.

    What a group has in a fold is one aggregate, combined before the shuffle, and comes back by one join.
    """
    day = lambda m: F.to_timestamp_ntz(F.lit(f"{m}-01 00:00:00"))
    fold = F.explode(F.array(*[F.struct(F.lit(m).alias("fold"), day(m).alias("begin")) for m in sorted(set(months))])).alias("__fold")
    begin, t, ready = F.col("__fold.begin"), F.col(time).cast("timestamp_ntz"), F.col(known).cast("timestamp_ntz")
    gap = F.expr(f"INTERVAL {embargo}")
    first = begin - F.make_ym_interval(F.lit(0), F.lit(validation_months))
    test = (t >= begin) & (t < begin + F.make_ym_interval(F.lit(0), F.lit(1)))
    validation = (t >= first) & (t < begin - gap) & (ready <= begin - gap)
    train = (t < first - gap) & (ready <= first - gap)
    part = F.when(test, "test").when(validation, "validation").when(train, "train")
    placed = df.select("*", fold).withColumn("__part", part).where("__part IS NOT NULL").withColumn("__name", F.col("__fold.fold"))
    has = placed.where(F.col(group).isNotNull()).groupBy(F.col("__name").alias("__n"), F.col(group).alias("__g")).agg(F.max(F.col("__part") == "test").alias("__t"), F.max(F.col("__part") == "validation").alias("__v"))
    both = placed.join(has.where("__t OR __v"), (F.col("__name") == F.col("__n")) & (F.col(group) == F.col("__g")), "left")
    later = F.when(F.col("__part") == "validation", F.col("__t")).when(F.col("__part") == "train", F.col("__t") | F.col("__v"))
    kept = both.where(~F.coalesce(later, F.lit(False)))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__name").alias("fold"), F.col("__part").alias("part"))
