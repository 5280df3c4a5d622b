"""Temporal splits, constraint checks, clusters, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.cluster import leader_clusters
from ..operators.running import previous
from ..operators.folds import monthly_folds
from ..sources.fixtures import bars, signals, table
from .registry import query

EDGES = ("2024-01-18 00:00:00", "2024-01-24 00:00:00")


@query("temporal_split", f""", g AS (SELECT ticker, user_id, min(decision_at) AS a, max(decision_at + INTERVAL 4 HOUR) AS b FROM sig GROUP BY ticker, user_id),
p AS (SELECT *, CASE WHEN b <= TIMESTAMP '{EDGES[0]}' THEN 'train' WHEN a >= TIMESTAMP '{EDGES[0]}' AND b <= TIMESTAMP '{EDGES[1]}' THEN 'validation' WHEN a >= TIMESTAMP '{EDGES[1]}' THEN 'test' ELSE 'purged' END AS part FROM g)
SELECT s.signal_id, p.part FROM sig s JOIN p ON s.ticker = p.ticker AND s.user_id = p.user_id""")
def temporal_split(spark, d):
    """Groups go whole to one part; those that straddle an edge are purged."""
    s = signals(spark, d)
    g = s.groupBy("ticker", "user_id").agg(F.min("decision_at").alias("a"), F.max(F.col("decision_at") + F.expr("INTERVAL '4' HOUR")).alias("b"))
    one, two = (F.expr(f"TIMESTAMP_NTZ '{e}'") for e in EDGES)
    part = F.when(F.col("b") <= one, "train").when((F.col("a") >= one) & (F.col("b") <= two), "validation").when(F.col("a") >= two, "test").otherwise("purged")
    return s.join(g.select("ticker", "user_id", part.alias("part")), ["ticker", "user_id"]).select("signal_id", "part")


@query("fraction_split", """, g AS (SELECT user_id, min(decision_at) AS a, max(decision_at) AS b FROM sig WHERE ticker = 'purchase' AND direction = 'up' GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY a, user_id) AS rn, count(*) OVER () AS n FROM g),
e AS (SELECT min(a) FILTER (rn > n * 0.6) AS e1, min(a) FILTER (rn > n * 0.8) AS e2 FROM r)
SELECT user_id, CASE WHEN a < e1 AND b < e1 THEN 'train' WHEN a >= e1 AND a < e2 AND b < e2 THEN 'validation' WHEN a >= e2 THEN 'test' ELSE 'purged' END AS part FROM r, e""")
def fraction_split(spark, d):
    """60/20/20 of the groups in order of their start; a group that reaches beyond its part's edge is purged.

    Edges come from a count of groups by start, so that no task orders all groups.
    """
    g = signals(spark, d).where("ticker = 'purchase' AND direction = 'up'").groupBy("user_id").agg(F.min("decision_at").alias("a"), F.max("decision_at").alias("b"))
    starts = g.groupBy("a").agg(F.count(F.lit(1)).alias("c")).withColumn("day", F.to_date("a"))
    days = starts.groupBy("day").agg(F.sum("c").alias("d"))  # one row a day
    one = Window.partitionBy(F.lit(1))
    days = days.select("day", F.coalesce(F.sum("d").over(one.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("d").over(one).alias("n"))
    upto = starts.join(days, "day").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("day").orderBy("a")))
    edge = lambda share: F.min(F.when(F.col("upto") > F.col("n") * share, F.col("a")))
    x = g.join(F.broadcast(upto.agg(edge(0.6).alias("e1"), edge(0.8).alias("e2"))))  # one row
    a, b, e1, e2 = (F.col(c) for c in ("a", "b", "e1", "e2"))
    return x.select("user_id", F.when((a < e1) & (b < e1), "train").when((a >= e1) & (a < e2) & (b < e2), "validation").when(a >= e2, "test").otherwise("purged").alias("part"))


@query("walk_forward_folds", """, w AS (SELECT CAST(v AS INTEGER) AS fold, TIMESTAMP '2024-01-08 00:00:00' + v * INTERVAL 7 DAY AS edge FROM (SELECT unnest([0, 1, 2]) AS v))
SELECT fold, count(*) FILTER (decision_at < edge - INTERVAL 72 HOUR) AS train, count(*) FILTER (decision_at >= edge AND decision_at < edge + INTERVAL 7 DAY) AS test FROM sig, w GROUP BY fold""")
def walk_forward_folds(spark, d):
    """Weekly folds with 72 hours of embargo."""
    w = signals(spark, d).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    w = w.withColumn("edge", F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00'") + F.make_dt_interval(days=F.col("fold") * 7))
    t = F.col("decision_at")
    return w.groupBy("fold").agg(F.count_if(t < F.col("edge") - F.expr("INTERVAL '72' HOUR")).alias("train"), F.count_if((t >= F.col("edge")) & (t < F.col("edge") + F.expr("INTERVAL '7' DAY"))).alias("test"))


_MONTHS = ["2000-03", "2000-06", "2000-09", "2000-12"]


@query("monthly_folds", f"""WITH f AS (SELECT m AS fold, CAST(m || '-01' AS TIMESTAMP) AS b FROM (SELECT unnest({_MONTHS}) AS m)),
p AS (SELECT fold, o_orderkey, o_custkey, CASE WHEN o_orderdate >= b AND o_orderdate < b + INTERVAL 1 MONTH THEN 'test'
  WHEN o_orderdate >= b - INTERVAL 2 MONTH AND o_orderdate < b - INTERVAL 72 HOUR AND o_orderdate + INTERVAL 10 DAY <= b - INTERVAL 72 HOUR THEN 'validation'
  WHEN o_orderdate < b - INTERVAL 2 MONTH - INTERVAL 72 HOUR AND o_orderdate + INTERVAL 10 DAY <= b - INTERVAL 2 MONTH - INTERVAL 72 HOUR THEN 'train' END AS part FROM orders, f),
v AS (SELECT * FROM p WHERE part = 'validation' AND NOT EXISTS (SELECT 1 FROM p t WHERE t.part = 'test' AND t.fold = p.fold AND t.o_custkey = p.o_custkey)),
late AS (SELECT fold, o_custkey FROM p WHERE part = 'test' UNION SELECT fold, o_custkey FROM v)
SELECT fold, part, o_orderkey FROM p WHERE part = 'test' UNION ALL SELECT fold, part, o_orderkey FROM v UNION ALL
SELECT fold, part, o_orderkey FROM p WHERE part = 'train' AND NOT EXISTS (SELECT 1 FROM late WHERE late.fold = p.fold AND late.o_custkey = p.o_custkey)""", base=False)
def monthly_folds_query(spark, d):
    """Four monthly folds of orders with two months of validation; a customer is in one partition of a fold."""
    o = table(spark, d, "orders").withColumn("known", F.col("o_orderdate") + F.expr("INTERVAL '10' DAY"))
    return monthly_folds(o, "o_orderdate", "known", "o_custkey", _MONTHS).select("fold", "part", "o_orderkey")


@query("check_unique", " SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", base=False)
def check_unique(spark, d):
    """V3: keys that occur twice."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("check_point_in_time", " SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate", base=False)
def check_point_in_time(spark, d):
    """V1: rows that break chronology."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber")


@query("check_leakage", """, p AS (SELECT user_id, CASE WHEN decision_at < TIMESTAMP '2024-01-18 00:00:00' THEN 'a' ELSE 'b' END AS part FROM sig) SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT part) > 1""")
def check_leakage(spark, d):
    """V5: groups on both sides of an edge."""
    p = signals(spark, d).withColumn("part", F.expr("decision_at < TIMESTAMP_NTZ '2024-01-18 00:00:00'"))
    return p.groupBy("user_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("user_id")


@query("check_returns", " SELECT bar_id FROM (SELECT bar_id, open, lag(open) OVER (PARTITION BY ticker ORDER BY bars.at, bar_id) AS prev FROM bars) WHERE abs((open / prev - 1) * 100) > 100")
def check_returns(spark, d):
    """V2: returns beyond a bound."""
    return previous(bars(spark, d), "ticker", F.to_date("at"), ["at", "bar_id"], {"prev": "open"}).where(F.abs((F.try_divide(F.col("open"), F.col("prev")) - 1) * 100) > 100).select("bar_id")


@query("dedup_eval_events")
def dedup_eval_events(spark, d):
    """K4: leader clusters of titles by source; documents are an hour apart."""
    t = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") * 3600).cast("double").alias("t"), tokens(F.split("text", "\n")[0]).alias("w"))
    return leader_clusters(t, "source", "t", "doc_id", "w")


@query("event_candidates", """, g AS (SELECT user_id, ticker, min(decision_at) AS first_at, arg_min(signal_id, (decision_at, signal_id)) AS primary_id FROM sig GROUP BY user_id, ticker)
SELECT g.primary_id, count(s.signal_id) AS members FROM g JOIN sig s ON s.user_id = g.user_id AND s.ticker = g.ticker AND s.decision_at <= g.first_at + INTERVAL 1 DAY GROUP BY g.primary_id""")
def event_candidates(spark, d):
    """K6: the earliest member is primary; only members available by the decision corroborate."""
    s = signals(spark, d)
    g = s.groupBy("user_id", "ticker").agg(F.min_by(F.struct("decision_at", "signal_id"), F.struct("decision_at", "signal_id")).alias("p"))
    near = s.join(g, ["user_id", "ticker"]).where(F.col("decision_at") <= F.col("p.decision_at") + F.expr("INTERVAL '1' DAY"))
    return near.groupBy(F.col("p.signal_id").alias("primary_id")).agg(F.count("signal_id").alias("members"))


#: A portable linear model: intercept, weight and scale by feature (a demonstration artifact).
WEIGHTS = {"n": (0.4, 1000.0), "bang": (-2.0, 1.0), "digits": (-0.5, 10.0)}


@query("model_score", "SELECT doc_id, round(1 / (1 + exp(-(0.3 + 0.4 * n_chars / CAST(1000 AS DOUBLE) - 2.0 * CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END - 0.5 * len(regexp_extract_all(text, '[0-9]')) / CAST(10 AS DOUBLE)))), 6) AS p FROM documents", base=False)
def model_score(spark, d):
    """M1: intercept plus weight times value over scale, through the logistic function."""
    value = {"n": F.col("n_chars"), "bang": F.when(F.col("text").contains("!!"), 1).otherwise(0), "digits": F.regexp_count("text", F.lit("[0-9]"))}
    z = F.lit(0.3)
    for name, (weight, scale) in WEIGHTS.items():
        z = z + weight * F.coalesce(value[name], F.lit(0)) / scale
    return table(spark, d, "documents").select("doc_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


NB = """WITH x AS (SELECT d.doc_id, l.quality AS y, list_distinct(string_split(text, ' ')) AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id), n AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM x),
t AS (SELECT unnest(w) AS term, y FROM x), c AS (SELECT term, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM t GROUP BY term HAVING count(*) >= 20)
SELECT term, round(ln((a + 1) / CAST(n1 + 2 AS DOUBLE)) - ln((b + 1) / CAST(n0 + 2 AS DOUBLE)), 6) AS weight FROM c, n"""


@query("nb_train", NB, base=False)
def nb_train(spark, d):
    """M4: Bernoulli weights with Laplace smoothing of terms in 20 documents at least."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("y"), F.array_distinct(F.split("text", " ")).alias("w"))
    n = x.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    c = x.select(F.explode("w").alias("term"), "y").groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).where("a + b >= 20")
    share = lambda k, m: F.log((F.col(k) + 1) / (F.col(m) + 2).cast("double"))
    return c.join(F.broadcast(n)).select("term", F.round(share("a", "n1") - share("b", "n0"), 6).alias("weight"))


@query("conversation_history", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, length(text) AS n FROM conversations", base=False)
def conversation_history(spark, d):
    """W6 over ordered turns."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev_role"), F.length("text").cast("long").alias("n"))
