"""Evaluation metrics as aggregates: hit rates, calibration, ranking quality, intervals, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval; null where n is 0."""
    p, z2 = F.try_divide(successes.cast("double"), n.cast("double")), Z95 * Z95
    centre = (p + F.try_divide(F.lit(z2), 2 * n)) / (1 + F.try_divide(F.lit(z2), n))
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / (1 + F.try_divide(F.lit(z2), n))
    some = n > 0  # greatest and least would pass over a null
    return F.when(some, F.greatest(centre - half, F.lit(0.0))), F.when(some, F.least(centre + half, F.lit(1.0)))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area by mid-ranks of distinct scores: counts per score first, so the ordered part is small; null for one class."""
    by = by or []
    points = df.groupBy(*by, score).agg(F.sum(label).cast("double").alias("__p"), F.count(F.lit(1)).cast("double").alias("__n"))
    ranked = running_sums(points, score, {"before": "__n"}, by, inclusive=False)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("__p") * (F.col("before") + (F.col("__n") + 1) / 2)).alias("r"), F.sum("__p").alias("p"), F.sum("__n").alias("n"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(*by, area.alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over distinct scores, high to low, of precision times the step in recall."""
    points = df.groupBy(score).agg(F.sum(label).cast("double").alias("__p"), F.count(F.lit(1)).cast("double").alias("__n"))
    run = running_sums(points, score, {"tp": "__p", "m": "__n"}, descending=True)
    return run.agg(F.try_divide(F.sum(F.col("__p") * F.col("tp") / F.col("m")), F.sum("__p")).alias("pr_auc"))


def bootstrap_means(df: DataFrame, cluster: str, total: Column, count: Column, replicates: int) -> DataFrame:
    """Ratio of sums per replicate, whole clusters drawn with hash-based Poisson(1) multiplicities.

    Clusters are summed first; the multiplicity of (replicate, cluster) depends on both alone, so any engine repeats it.
    """
    sums = df.groupBy(cluster).agg(total.alias("s"), count.alias("c"))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    m = multiplicity(F.col("rep"), F.col(cluster))
    return drawn.withColumn("m", m).groupBy("rep").agg(F.try_divide(F.sum(F.col("m") * F.col("s")).cast("double"), F.sum(F.col("m") * F.col("c")).cast("double")).alias("ratio"))


def multiplicity(rep: Column, cluster: Column) -> Column:
    """How often a replicate draws a cluster: Poisson(1) by the hash of both."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", rep.cast("string"), cluster.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def rank_bootstrap(df: DataFrame, cluster: str, label: str, scores: list[str], replicates: int) -> DataFrame:
    """rep, and for each score column s its auc_s and ap_s over whole clusters drawn anew; null where a replicate has one class.

    Rows are counted by cluster and score first, so that a replicate weighs counts, not rows: drawn counts meet by (replicate,
    score), and ranks are running sums of them. A null cluster is a cluster.
    """
    each = df.select(F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("c"), F.col(label).cast("long").alias("y"), F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("s")) for s in scores])).alias("x"))
    counts = each.groupBy("c", "x.model", "x.s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    drawn = counts.select("c").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("m", multiplicity(F.col("rep"), F.col("c"))).where("m > 0")
    points = counts.join(drawn, "c").groupBy("model", "rep", "s").agg(F.sum(F.col("m") * F.col("pos")).cast("double").alias("pos"), F.sum(F.col("m") * F.col("n")).cast("double").alias("n"))
    up = running_sums(points, "s", {"upto": "n", "hits": "pos"}, ["model", "rep"], totals=True)
    # The same sums from the top: what isn't below.
    top, tp = F.col("upto_total") - F.col("upto") + F.col("n"), F.col("hits_total") - F.col("hits") + F.col("pos")
    sums = up.groupBy("model", "rep").agg(
        F.sum(F.col("pos") * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)).alias("r"), F.sum(F.col("pos") * tp / top).alias("a"), F.sum("pos").alias("p"), F.sum("n").alias("n")
    )
    two = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    auc = F.when(two, (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))))
    wide = [F.max(F.when(F.col("model") == s, v)).alias(f"{name}_{s}") for s in scores for name, v in (("auc", F.col("auc")), ("ap", F.col("ap")))]
    return sums.select("rep", "model", auc.alias("auc"), F.when(two, F.col("a") / F.col("p")).alias("ap")).groupBy("rep").agg(*wide)
