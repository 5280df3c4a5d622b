"""Walk-forward benchmarks, artifacts and their checks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import roc_auc
from ..operators.models import check_partitions, fit_logistic, score_logistic, seal, unseal, walk_forward
from ..operators.sparse_models import RowEncoder, TextEncoder, fit_sparse, group_weights, score_sparse
from ..operators.trees import fit_trees
from ..sources.fixtures import signals, table
from ..sources.shared import kept as kept_table
from .metric_ops import SCORED
from .registry import query

MODELS = {"prior": [], "length": ["length"], "text": ["length", "digits", "marks"]}


def rows(spark, d):
    """Labelled documents in order of id as time; a label is known 72 rows later."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", (F.col("doc_id") + 72).alias("known"), F.col("quality").alias("y"), (F.col("n_chars") / 1000).alias("length"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"), F.regexp_count("text", F.lit("[!?]")).alias("marks"))


def edges(x) -> list[int]:
    last = x.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
    return [last * n // 10 for n in (4, 6, 8, 10)]


@query("benchmark")
def benchmark(spark, d):
    """Each fold's rows and area under the curve by model, fitted on what was known before."""
    x = rows(spark, d)
    scored = walk_forward(x, "doc_id", "known", edges(x), MODELS, "y").withColumn("p", F.round("p", 9))
    sizes = scored.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.avg("y").alias("rate"))
    return sizes.join(roc_auc(scored, "p", "y", ["fold", "model"]), ["fold", "model"])


@query("artifact_scores")
def artifact_scores(spark, d):
    """The latest fold's model, sealed, read back with its checks, and applied to every document."""
    x = rows(spark, d)
    begin, features = edges(x)[-2], MODELS["text"]
    weights = fit_logistic(x.where(F.col("known") < begin), features, "y")
    model = unseal(seal({"features": features, "weights": [float(w) for w in weights], "trained_through": int(begin)}), features)
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("length"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"), F.regexp_count("text", F.lit("[!?]")).alias("marks"))
    return score_logistic(docs, model["weights"], features).select("doc_id", F.round("p", 6).alias("p"), F.lit(model["trained_through"]).alias("trained_through"))


@query("partition_checks", """, p AS (SELECT *, CASE WHEN decision_at < TIMESTAMP '2024-01-11 00:00:00' THEN 1 WHEN decision_at < TIMESTAMP '2024-01-21 00:00:00' THEN 2 ELSE 3 END AS part FROM sig), s AS (SELECT part, min(decision_at) AS a, max(decision_at) AS b FROM p GROUP BY part)
SELECT 'shared_keys' AS check, count(*) AS violations FROM (SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT part) > 1) UNION ALL SELECT 'time_order', count(*) FROM s x JOIN s y ON x.part < y.part AND y.a <= x.b""")
def partition_checks(spark, d):
    """Keys that several partitions share, and partitions out of order."""
    at = lambda day: F.col("decision_at") < F.expr(f"TIMESTAMP_NTZ '2024-01-{day} 00:00:00'")
    p = signals(spark, d).withColumn("part", F.when(at("11"), 1).when(at("21"), 2).otherwise(3))
    return check_partitions(p, "part", "user_id", "decision_at")



@query("materiality_rates", SCORED + """, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM x)
SELECT round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 6) AS specificity, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1 FROM c""", base=False)
def materiality_rates(spark, d):
    """Precision, recall, specificity and F1; null where nothing is to divide by."""
    from .metric_ops import scored

    hit, y = F.col("p") >= 0.5, F.col("y") == 1
    c = scored(spark, d).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    rate = lambda a, *b: F.round(F.try_divide(a.cast("double"), sum(b[1:], b[0])), 6)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(rate(tp, tp, fp).alias("precision"), rate(tp, tp, fn).alias("recall"), rate(tn, tn, fp).alias("specificity"), rate(2 * tp, 2 * tp, fp, fn).alias("f1"))


_IDS = {"user": "CAST(user_id AS VARCHAR)", "ticker_day": "ticker || ':' || CAST(CAST(decision_at AS DATE) AS VARCHAR)", "user_ticker": "user_id || ':' || ticker", "signal": "CAST(signal_id AS VARCHAR)", "user_day": "user_id || ':' || CAST(CAST(decision_at AS DATE) AS VARCHAR)"}


@query("overlap_identities", ", p AS (SELECT *, k < 50 AS part FROM sig) " + " UNION ALL ".join(f"SELECT '{n}' AS identity, count(*) AS shared FROM (SELECT {e} AS v FROM p GROUP BY 1 HAVING count(DISTINCT part) > 1)" for n, e in _IDS.items()))
def overlap_identities(spark, d):
    """On five identities, how many values two partitions share; one pass lists them all."""
    text = lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    u, t, day = F.col("user_id"), F.col("ticker"), F.to_date("decision_at")
    ids = {"user": text(u), "ticker_day": text(t, day), "user_ticker": text(u, t), "signal": text(F.col("signal_id")), "user_day": text(u, day)}
    p = signals(spark, d).withColumn("part", F.col("k") < 50)
    each = p.select("part", F.explode(F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*ids.values()))).alias("identity", "v"))
    found = each.groupBy("identity", "v").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    return found.groupBy("identity").agg(F.count_if(F.col("a") != F.col("b")).alias("shared"))


def labelled(spark, d):
    """Labelled documents with numbers (some missing), categories and a ternary label: 0 or 1 by quality, 2 where toxic."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    digits = F.regexp_count("text", F.lit("[0-9]"))
    return x.select(
        "doc_id", "text", "lang", "source", F.col("quality").alias("y"), F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("three"),
        (F.col("n_chars") / 1000).alias("length"), F.when(digits > 0, digits).alias("digits"), F.regexp_count("text", F.lit("[!?]")).alias("marks"),
    )


@query("model_fit")
def model_fit(spark, d):
    """M2: coefficient and scale of every learned feature; groups (sources) count as one each, the intercept is penalized."""
    x = kept_table(labelled(spark, d).drop("text"), "labelled")
    encoder = RowEncoder(["length", "digits", "marks"], ["lang", "source"]).fit(x)
    weights = fit_sparse(encoder.transform(group_weights(x, "source")), len(encoder.names), c=0.1, penalize_intercept=True, weight="w")[0]
    scales = [*encoder.scales, *[1.0] * (len(encoder.names) - len(encoder.scales)), 1.0]
    rows = [(n, round(float(w), 6), round(s, 6)) for n, w, s in zip([*encoder.names, "intercept"], weights, scales)]
    return spark.createDataFrame(rows, "feature string, coefficient double, scale double")


@query("text_model")
def text_model(spark, d):
    """M6: every document's probabilities of three classes, from hashed words and pairs of words of the labelled ones."""
    x = labelled(spark, d).select("doc_id", "text", "three")
    encoder = TextEncoder(dims=1 << 14).fit(x, "text")
    weights = fit_sparse(encoder.transform(x, "text"), encoder.dims, classes=3, c=1.0, label="three", tolerance=1e-3, rounds=40)
    scored = score_sparse(encoder.transform(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text"), weights)
    p = lambda k: F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}")
    best = F.array_position("p", F.array_max("p")) - 1
    return scored.select("doc_id", p(0), p(1), p(2), best.cast("int").alias("predicted"))


@query("tree_model")
def tree_model(spark, d):
    """M6: every document's probability by boosted trees over numbers with gaps."""
    x = labelled(spark, d)
    model = fit_trees(x, ["length", "digits", "marks"], "y", trees=8, depth=3, rate=0.3, bins=16)
    digits = F.regexp_count("text", F.lit("[0-9]"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("length"), F.when(digits > 0, digits).alias("digits"), F.regexp_count("text", F.lit("[!?]")).alias("marks"))
    return docs.select("doc_id", F.round(model.probability(), 6).alias("p"))
