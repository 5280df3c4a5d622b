"""Clusters of news and predictions, and the instruments and figures in their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.cluster import Components, Representatives, clusters, leader_clusters
from ..sources.fixtures import table
from .registry import query
from .split_ops import NB
from .text_ops import titled


def news(spark, d) -> DataFrame:
    """Titled documents an hour apart, with title tokens, language as mark and length as weight."""
    t = titled(spark, d).withColumn("w", tokens(F.col("title")))
    return t.select("doc_id", "source", (F.col("doc_id") * 3600).cast("double").alias("t"), "w", F.array("lang").alias("marks"), F.col("n_chars").alias("weight"))


@query("cluster_events")
def cluster_events(spark, d):
    """K1: groups by their present representative, which a heavier item replaces."""
    return clusters(news(spark, d), "source", "t", "doc_id", "w", Representatives, weight="weight")


@query("eval_clusters")
def eval_clusters(spark, d):
    """K2: connected groups in order, with the veto of two-sided marks."""
    return clusters(news(spark, d), "source", "t", "doc_id", "w", Components, window_s=259_200, marks="marks")


@query("dedup_outcomes")
def dedup_outcomes(spark, d):
    """K3: the first of each cluster, with its size and distinct publishers."""
    c = eval_clusters(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return c.groupBy("leader_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("publishers"))


@query("dedup_predictions")
def dedup_predictions(spark, d):
    """K5: leader clusters of labelled documents."""
    n = news(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return leader_clusters(n, "source", "t", "doc_id", "w")


@query("audit_clusters")
def audit_clusters(spark, d):
    """K7: leader clusters in a window of 72 hours."""
    return leader_clusters(news(spark, d), "source", "t", "doc_id", "w", window_s=259_200)


@query("nb_score", NB.replace("SELECT term, round(", ", m AS (SELECT term, (").replace(", 6) AS weight FROM c, n", ") AS weight FROM c, n)") + " SELECT d.doc_id, round(sum(coalesce(m.weight, 0)), 4) AS score FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS term FROM documents) d LEFT JOIN m ON d.term = m.term GROUP BY d.doc_id", base=False)
def nb_score(spark, d):
    """M4: the sum of the weights of a document's terms."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("y"), F.array_distinct(F.split("text", " ")).alias("w"))
    n = x.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    c = x.select(F.explode("w").alias("term"), "y").groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).where("a + b >= 20")
    share = lambda k, m: F.log((F.col(k) + 1) / (F.col(m) + 2).cast("double"))
    m = c.join(F.broadcast(n)).select("term", (share("a", "n1") - share("b", "n0")).alias("weight"))
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("term"))
    return t.join(m, "term", "left").groupBy("doc_id").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 4).alias("score"))


@query("structured_features", "SELECT doc_id, len(regexp_extract_all(lower(text), 'tion')) AS roots, len(regexp_extract_all(text, '[0-9]+%')) AS percents, regexp_matches(text, '[0-9]+ (k|m|bn)') AS scaled, round(2 / (1 + exp(-2 * (len(regexp_extract_all(lower(text), 'tion')) / CAST(10 AS DOUBLE)))) - 1, 6) AS blend FROM documents", base=False)
def structured_features(spark, d):
    """Root counts, percent changes, scaled amounts and a tanh blend."""
    roots = F.regexp_count(F.lower("text"), F.lit("tion"))
    blend = 2 / (1 + F.exp(-2 * (roots / 10))) - 1
    return table(spark, d, "documents").select("doc_id", roots.cast("long").alias("roots"), F.regexp_count("text", F.lit("[0-9]+%")).cast("long").alias("percents"), F.col("text").rlike("[0-9]+ (k|m|bn)").alias("scaled"), F.round(blend, 6).alias("blend"))


@query("export_verify", "SELECT source, count(*) AS n, min(sha256(text)) AS low, max(sha256(text)) AS high, bit_xor(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) AS fingerprint FROM documents GROUP BY source", base=False)
def export_verify(spark, d):
    """Row counts and order-free digests that an export and its copy must share."""
    body = F.col("text").cast("binary")
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2(body, 256)).alias("low"), F.max(F.sha2(body, 256)).alias("high"), F.bit_xor(F.conv(F.substring(F.md5(body), 1, 8), 16, 10).cast("long")).alias("fingerprint"))
