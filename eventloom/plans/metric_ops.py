"""Evaluation reports over labelled documents and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.metrics import average_precision, bootstrap_means, rank_bootstrap, roc_auc, wilson
from ..operators.running import running_sums
from ..sources.fixtures import signals, table
from .registry import query

#: label, p and cluster of each labelled document, as the fixture mapping has them.
SCORED = "WITH x AS (SELECT d.doc_id, l.quality AS y, l.toxic, d.source AS cluster, (d.n_chars % 101) / CAST(100 AS DOUBLE) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def scored(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", F.col("quality").alias("y"), "toxic", F.col("source").alias("cluster"), ((F.col("n_chars") % 101) / 100).alias("p"))


CONFUSION = """ SELECT count(*) AS n, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn,
round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(greatest(avg(y), 1 - avg(y)), 6) AS majority FROM x"""


@query("materiality_report", SCORED + CONFUSION, base=False)
def materiality_report(spark, d):
    """Confusion, accuracy and the majority baseline."""
    hit, y = F.col("p") >= 0.5, F.col("y") == 1
    return scored(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
        F.round(F.avg(F.when(hit == y, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.greatest(F.avg("y"), 1 - F.avg("y")), 6).alias("majority"),
    )


@query("roc_auc", SCORED + """, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM x GROUP BY p), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / CAST(2 AS DOUBLE) AS mid FROM g)
SELECT round((sum(pos * mid) - sum(pos) * (sum(pos) + 1) / CAST(2 AS DOUBLE)) / (sum(pos) * (sum(n) - sum(pos))), 4) AS auc FROM r""", base=False)
def roc_auc_query(spark, d):
    """A10."""
    return roc_auc(scored(spark, d), "p", "y").select(F.round("auc", 4).alias("auc"))


@query("per_fold_auc", SCORED + """, g AS (SELECT cluster, p, sum(y) AS pos, count(*) AS n FROM x GROUP BY cluster, p), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cluster ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / CAST(2 AS DOUBLE) AS mid FROM g)
SELECT cluster, round((sum(pos * mid) - sum(pos) * (sum(pos) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 4) AS auc FROM r GROUP BY cluster""", base=False)
def per_fold_auc(spark, d):
    """AUC by fold, null for folds of one class."""
    return roc_auc(scored(spark, d), "p", "y", ["cluster"]).select("cluster", F.round("auc", 4).alias("auc"))


@query("pr_auc", SCORED + """, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM x GROUP BY p), r AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m FROM g)
SELECT round(sum(pos * tp / CAST(m AS DOUBLE)) / sum(pos), 4) AS pr_auc FROM r""", base=False)
def pr_auc(spark, d):
    """Average precision over distinct scores."""
    return average_precision(scored(spark, d), "p", "y").select(F.round("pr_auc", 4).alias("pr_auc"))


@query("brier", SCORED + " SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM x", base=False)
def brier(spark, d):
    """A11."""
    return scored(spark, d).agg(F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"))


@query("reliability_bins", SCORED + """, b AS (SELECT least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, p, y FROM x)
SELECT CAST(r.bin AS INTEGER) AS bin, count(b.bin) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON r.bin = b.bin GROUP BY r.bin""", base=False)
def reliability_bins(spark, d):
    """Ten bins, the empty ones kept."""
    b = scored(spark, d).groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("a"), F.avg("y").alias("b"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"), F.round("a", 6).alias("mean_p"), F.round("b", 6).alias("rate"))


@query("ece", SCORED + """, b AS (SELECT least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS r FROM x GROUP BY 1) SELECT round(sum(n * abs(a - r)) / sum(n), 6) AS ece FROM b""", base=False)
def ece(spark, d):
    """Expected calibration error."""
    b = scored(spark, d).groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("a"), F.avg("y").alias("r"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("r"))) / F.sum("n"), 6).alias("ece"))


@query("probability_diagnostics", SCORED + """, c AS (SELECT y, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM x)
SELECT count(*) AS n, round(-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 4) AS log_loss, round((avg(CASE WHEN q >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (y = 1) + avg(CASE WHEN q < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (y = 0)) / 2, 6) AS balanced FROM c""", base=False)
def probability_diagnostics(spark, d):
    """Log-loss with clipping and balanced accuracy."""
    c = scored(spark, d).withColumn("q", F.greatest(F.least("p", F.lit(1 - 1e-15)), F.lit(1e-15)))
    right = lambda y, hit: F.avg(F.when(F.col("y") == y, F.when(hit, 1.0).otherwise(0.0)))
    return c.agg(
        F.count(F.lit(1)).alias("n"), F.round(-F.avg(F.when(F.col("y") == 1, F.log("q")).otherwise(F.log(1 - F.col("q")))), 4).alias("log_loss"),
        F.round((right(1, F.col("q") >= 0.5) + right(0, F.col("q") < 0.5)) / 2, 6).alias("balanced"),
    )




@query("wilson_interval", SCORED + """, s AS (SELECT cluster, CAST(count(*) AS DOUBLE) AS n, avg(y) AS c, 1.959963984540054 AS z FROM x GROUP BY cluster),
t AS (SELECT cluster, (c + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(c * (1 - c) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM s)
SELECT cluster, round(greatest(m - h, 0), 6) AS low, round(least(m + h, 1), 6) AS high FROM t""", base=False)
def wilson_interval(spark, d):
    """95 % interval of the positive share by cluster."""
    s = scored(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return s.select("cluster", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("return_distribution", " SELECT ticker, count(*) AS n, round(avg(score), 6) AS mean, median(score) AS p50, quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.95) AS p95, min(score) AS low, max(score) AS high FROM sig GROUP BY ticker")
def return_distribution(spark, d):
    """Exact linear percentiles."""
    p = lambda q: F.percentile("score", q)
    return signals(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), p(0.5).alias("p50"), p(0.05).alias("p05"), p(0.95).alias("p95"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("eval_relationships", " SELECT ticker, CASE WHEN count(*) >= 3 AND count(DISTINCT k) >= 2 AND count(DISTINCT user_id) >= 2 THEN round(corr(k, user_id), 3) END AS r, CASE WHEN count(*) < 8 THEN 'insufficient' WHEN abs(corr(k, user_id)) < 0.2 THEN 'weak' WHEN abs(corr(k, user_id)) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength FROM sig GROUP BY ticker")
def eval_relationships(spark, d):
    """Guarded correlation and its reading."""
    g = signals(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("a"), F.count_distinct("user_id").alias("b"), F.corr("k", "user_id").alias("c"))
    text = F.when(F.col("n") < 8, "insufficient").when(F.abs("c") < 0.2, "weak").when(F.abs("c") < 0.5, "moderate").otherwise("strong")
    return g.select("ticker", F.when((F.col("n") >= 3) & (F.col("a") >= 2) & (F.col("b") >= 2), F.round("c", 3)).alias("r"), text.alias("strength"))


@query("coverage_threshold", SCORED + ", r AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS n FROM x), t AS (SELECT c, p FROM r, (SELECT unnest([5, 10, 25, 50]) AS c) WHERE rn = greatest(1, CAST(ceil(n * c / 100.0) AS BIGINT))) SELECT CAST(c AS INTEGER) AS coverage, p AS threshold, (SELECT count(*) FROM x WHERE x.p >= t.p) AS selected FROM t", base=False)
def coverage_threshold(spark, d):
    """The k-th largest score by coverage, and what ties make of it; over counts per score."""
    g = scored(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(g, "p", {"m": "n"}, descending=True, totals=True).withColumnRenamed("m_total", "total")
    c = r.withColumn("coverage", F.explode(F.array(*map(F.lit, (5, 10, 25, 50)))))
    k = F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("coverage") / 100))
    return c.where((F.col("m") >= k) & (F.col("m") - F.col("n") < k)).select("coverage", F.col("p").alias("threshold"), F.col("m").alias("selected"))


@query("best_f1_threshold", SCORED + """, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM x GROUP BY p), r AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m, sum(pos) OVER () AS t FROM g)
SELECT p AS threshold, round(2 * tp / CAST(m + t AS DOUBLE), 6) AS f1 FROM r ORDER BY 2 * tp / CAST(m + t AS DOUBLE) DESC, abs(p - 0.5), p LIMIT 1""", base=False)
def best_f1_threshold(spark, d):
    """The threshold of best F1, ties to the nearest to one half."""
    g = scored(spark, d).groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    r = running_sums(g, "p", {"tp": "pos", "m": "n"}, descending=True, totals=True).withColumnRenamed("tp_total", "t")
    r = r.withColumn("f", 2 * F.col("tp") / (F.col("m") + F.col("t")).cast("double"))
    return r.orderBy(F.desc("f"), F.abs(F.col("p") - 0.5), "p").limit(1).select(F.col("p").alias("threshold"), F.round("f", 6).alias("f1"))


@query("paired_hits", SCORED + " SELECT cluster, count(*) FILTER ((p >= 0.5) = (y = 1) AND toxic = 0) AS both, count(*) FILTER ((p >= 0.5) = (y = 1) AND toxic = 1) AS a_only, count(*) FILTER ((p >= 0.5) <> (y = 1) AND toxic = 0) AS b_only, count(*) FILTER ((p >= 0.5) <> (y = 1) AND toxic = 1) AS neither FROM x GROUP BY cluster", base=False)
def paired_hits(spark, d):
    """Two systems' hits by cluster."""
    a, b = (F.col("p") >= 0.5) == (F.col("y") == 1), F.col("toxic") == 0
    return scored(spark, d).groupBy("cluster").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))


@query("leave_one_out", SCORED + ", g AS (SELECT cluster, sum(y) AS s, count(*) AS n FROM x GROUP BY cluster) SELECT cluster, round(((SELECT sum(s) FROM g) - s) / CAST((SELECT sum(n) FROM g) - n AS DOUBLE), 6) AS rate FROM g", base=False)
def leave_one_out(spark, d):
    """The rate without each cluster."""
    g = scored(spark, d).groupBy("cluster").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(1))
    return g.select("cluster", F.round(F.try_divide((F.sum("s").over(all_) - F.col("s")).cast("double"), F.sum("n").over(all_) - F.col("n")), 6).alias("rate"))


@query("bootstrap_ci", SCORED + """, g AS (SELECT cluster, sum(y) AS s, count(*) AS c FROM x GROUP BY cluster), r AS (SELECT rep, s, c, CAST('0x' || substr(md5(CAST(rep AS VARCHAR) || '|' || cluster), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM g, (SELECT unnest(range(200)) AS rep)),
m AS (SELECT rep, s, c, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS w FROM r),
q AS (SELECT rep, sum(w * s) / CAST(nullif(sum(w * c), 0) AS DOUBLE) AS ratio FROM m GROUP BY rep) SELECT round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high, count(ratio) AS n FROM q""", base=False)
def bootstrap_ci(spark, d):
    """Percentile interval over whole clusters; multiplicities come from hashes, so engines agree."""
    r = bootstrap_means(scored(spark, d), "cluster", F.sum("y"), F.count(F.lit(1)), 200)
    return r.agg(F.round(F.percentile("ratio", 0.025), 6).alias("low"), F.round(F.percentile("ratio", 0.975), 6).alias("high"), F.count("ratio").alias("n"))


_M = " + ".join(f"(u >= {x})::INT" for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))


@query("paired_rank_bootstrap", f"""WITH x AS (SELECT coalesce(d.source, '') AS c, l.quality AS y, (d.n_chars % 101) / CAST(100 AS DOUBLE) AS a, (d.n_chars % 89) / CAST(88 AS DOUBLE) AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT 'a' AS model, c, a AS s, sum(y) AS pos, count(*) AS n FROM x GROUP BY c, a UNION ALL SELECT 'b', c, b, sum(y), count(*) FROM x GROUP BY c, b),
u AS (SELECT c, rep, CAST('0x' || substr(md5(CAST(rep AS VARCHAR) || '|' || c), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM (SELECT DISTINCT c FROM x), (SELECT unnest(range(200)) AS rep)),
w AS (SELECT model, rep, s, sum(m * pos) AS pos, sum(m * n) AS n FROM k JOIN (SELECT c, rep, {_M} AS m FROM u) USING (c) WHERE m > 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER (PARTITION BY model, rep ORDER BY s DESC) AS top, sum(pos) OVER (PARTITION BY model, rep ORDER BY s DESC) AS tp FROM w),
q AS (SELECT rep, model, sum(pos) AS p, sum(n) AS n, (sum(pos * (below + (n + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / CAST(nullif(sum(pos) * (sum(n) - sum(pos)), 0) AS DOUBLE) AS auc, CASE WHEN sum(pos) BETWEEN 1 AND sum(n) - 1 THEN sum(pos * tp / CAST(top AS DOUBLE)) / sum(pos) END AS ap FROM r GROUP BY rep, model),
d AS (SELECT a.auc - b.auc AS auc, a.ap - b.ap AS ap FROM q a JOIN q b ON a.rep = b.rep AND a.model = 'a' AND b.model = 'b')
SELECT round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high, round(quantile_cont(ap, 0.025), 6) AS ap_low, round(quantile_cont(ap, 0.975), 6) AS ap_high, count(auc) AS valid, 200 - count(auc) AS skipped FROM d""", base=False)
def paired_rank_bootstrap(spark, d):
    """Percentile intervals of the differences of two models' AUC and average precision over 200 draws of whole clusters."""
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    x = x.select("source", "quality", ((F.col("n_chars") % 101) / 100).alias("a"), ((F.col("n_chars") % 89) / 88).alias("b"))
    r = rank_bootstrap(x, "source", "quality", ["a", "b"], 200)
    r = r.select((F.col("auc_a") - F.col("auc_b")).alias("auc"), (F.col("ap_a") - F.col("ap_b")).alias("ap"))
    ends = [F.round(F.percentile(c, share), 6).alias(f"{c}_{name}") for c in ("auc", "ap") for name, share in (("low", 0.025), ("high", 0.975))]
    return r.agg(*ends, F.count("auc").alias("valid"), (200 - F.count("auc")).alias("skipped"))


@query("router_quality", SCORED + " SELECT round(count(*) FILTER (p >= 0.5 AND y = 1) / CAST(nullif(count(*) FILTER (p >= 0.5), 0) AS DOUBLE), 6) AS precision, round(count(*) FILTER (p >= 0.5 AND y = 1) / CAST(nullif(count(*) FILTER (y = 1), 0) AS DOUBLE), 6) AS recall FROM x", base=False)
def router_quality(spark, d):
    """A23."""
    tp = F.count_if((F.col("p") >= 0.5) & (F.col("y") == 1))
    return scored(spark, d).agg(F.round(F.try_divide(tp, F.count_if(F.col("p") >= 0.5)), 6).alias("precision"), F.round(F.try_divide(tp, F.count_if(F.col("y") == 1)), 6).alias("recall"))


@query("delivery_lag_stats", " SELECT ticker, CAST(max(k) FILTER (rn = CAST(round((n - 1) * 0.9) AS BIGINT) + 1) AS INTEGER) AS p90, median(k) AS p50 FROM (SELECT ticker, k, row_number() OVER (PARTITION BY ticker ORDER BY k) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM sig) GROUP BY ticker")
def delivery_lag_stats(spark, d):
    """Nearest-rank percentile beside the median."""
    values = signals(spark, d).groupBy("ticker", "k").agg(F.count(F.lit(1)).alias("c"))  # counts by value, which ranks are read from
    s = running_sums(values, "k", {"upto": "c"}, ["ticker"], totals=True)
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("k")))
    n = F.col("upto_total")
    return s.groupBy("ticker").agg(at(F.round((n - 1) * 0.9).cast("long") + 1).alias("p90"), ((at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2).alias("p50"))


@query("split_overlap_audit", " SELECT user_id, count(DISTINCT ticker) AS parts FROM sig GROUP BY user_id HAVING count(DISTINCT ticker) > 1")
def split_overlap_audit(spark, d):
    """Identities that several partitions hold."""
    return signals(spark, d).groupBy("user_id").agg(F.count_distinct("ticker").alias("parts")).where("parts > 1")


@query("dataset_report", " SELECT direction, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT ticker) AS tickers FROM sig GROUP BY direction")
def dataset_report(spark, d):
    """A26, A34."""
    return signals(spark, d).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("ticker").alias("tickers"))


@query("group_weights", SCORED + ", w AS (SELECT doc_id, 1.0 / count(*) OVER (PARTITION BY cluster) AS w FROM x) SELECT doc_id, round(w * (SELECT count(*) FROM w) / (SELECT sum(w) FROM w), 6) AS weight FROM w", base=False)
def group_weights(spark, d):
    """Equal weight for groups, mean one; sizes are aggregated and joined, so no group is windowed."""
    x = scored(spark, d)
    sizes = x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg((F.sum("n") / F.count(F.lit(1))).alias("scale"))
    return x.join(sizes, "cluster").join(F.broadcast(whole)).select("doc_id", F.round(F.col("scale") / F.col("n"), 6).alias("weight"))


@query("df_vocabulary", "WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT w, count(*) AS df FROM t WHERE length(w) > 2 GROUP BY w ORDER BY df DESC, w LIMIT 200", base=False)
def df_vocabulary(spark, d):
    """The terms of greatest document frequency."""
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where(F.length("w") > 2)
    return t.groupBy("w").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "w").limit(200)


@query("baseline_majority", " SELECT ticker, CASE WHEN count(*) FILTER (direction = 'down') > count(*) FILTER (direction = 'up') THEN 'down' ELSE 'up' END AS majority FROM sig GROUP BY ticker")
def baseline_majority(spark, d):
    """Up wins ties."""
    n = lambda x: F.count_if(F.col("direction") == x)
    return signals(spark, d).groupBy("ticker").agg(F.when(n("down") > n("up"), "down").otherwise("up").alias("majority"))


@query("fold_metrics", SCORED + ", f AS (SELECT cluster, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a, avg(y) AS b FROM x GROUP BY cluster) SELECT count(*) AS folds, count(*) FILTER (a > b) AS positive, round(avg(a - b), 6) AS mean_delta FROM f", base=False)
def fold_metrics(spark, d):
    """Fold deltas against a baseline."""
    f = scored(spark, d).groupBy("cluster").agg(F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)).alias("a"), F.avg("y").alias("b"))
    return f.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("a") > F.col("b")).alias("positive"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_delta"))


@query("calibration_offset")
def calibration_offset(spark, d):
    """M3: the logit shift at which the mean probability is the label rate, by bisection over counts per score."""
    g = scored(spark, d).groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("s"))
    q = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    packed = g.agg(F.collect_list(F.struct(F.log(q / (1 - q)).alias("z"), "n")).alias("a"), (F.sum("s") / F.sum("n")).alias("rate"), F.sum("n").alias("total"))  # one entry a distinct score

    def half(state, _):
        mid = (state["lo"] + state["hi"]) / 2
        mean = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["n"] / (1 + F.exp(-(x["z"] + mid)))) / F.col("total")
        return F.struct(F.when(mean < F.col("rate"), mid).otherwise(state["lo"]).alias("lo"), F.when(mean < F.col("rate"), state["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-20.0).alias("lo"), F.lit(20.0).alias("hi")), half)
    return packed.select(F.round((found["lo"] + found["hi"]) / 2, 6).alias("offset"))
