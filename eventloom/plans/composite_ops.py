"""Read models, feature rows, refreshes and reports composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.asof import asof_goals, goal_values
from ..operators.metrics import wilson
from ..operators.running import running_sums
from ..sources.fixtures import bars, benchmark_bars, signals, table
from ..sources.shared import kept
from .gate_ops import hours, minutes
from .market import ENTRY, TARGET, change, entries, horizon
from .metric_ops import SCORED, scored
from .news_ops import SCOPED, scoped, scored_news
from .news_ops import SCORED as NEWS_SCORED
from .registry import query
from .text_ops import TOKENS

NOW, SEEN_AT = "2024-01-15 00:00:00", "2024-01-07 00:00:00"

# What a reader of events sees.
READ = NEWS_SCORED + f""", vs AS (SELECT *, title_noise OR recap AS noisy FROM sd WHERE source <> 'src3' AND published_at <= TIMESTAMP '{SEEN_AT}' AND published_at + INTERVAL 3 DAY >= TIMESTAMP '{SEEN_AT}'),
vm AS (SELECT *, 1 AS model FROM vs UNION ALL BY NAME SELECT * REPLACE (CASE WHEN direction = 'up' THEN 'neutral' ELSE direction END AS direction), 2 AS model FROM vs WHERE news_id % 3 = 0),
lt1 AS (SELECT news_id, ticker, arg_max(direction, model) AS direction, max(model) AS model FROM vm GROUP BY news_id, ticker)"""


@query("market_events", READ + f""", nest AS (SELECT news_id, string_agg(ticker || ':' || direction || ':' || model, ',' ORDER BY ticker) AS signals, count(*) AS n, bool_or(direction <> 'neutral') AS directional FROM lt1 GROUP BY news_id)
, {SCOPED[SCOPED.index(", sp AS (") + 2:]}
SELECT so.news_id, so.scope, nest.signals, nest.n, sha256(so.title || chr(10) || so.body) AS content_hash FROM so JOIN nest ON so.news_id = nest.news_id WHERE nest.directional OR so.kind <> 'other'""", base=False)
def market_events(spark, d):
    """Visible and fresh news, the latest model's signal of each ticker nested under them, the product gate, scope and evidence hash."""
    now = F.expr(f"TIMESTAMP_NTZ '{SEEN_AT}'")
    seen = scored_news(spark, d).where((F.col("source") != "src3") & (F.col("published_at") <= now) & (F.col("published_at") + F.expr("INTERVAL '3' DAY") >= now)).select("news_id", "ticker", "direction")
    newer = seen.where("news_id % 3 = 0").withColumn("direction", F.when(F.col("direction") == "up", "neutral").otherwise(F.col("direction")))
    latest = seen.withColumn("model", F.lit(1)).unionByName(newer.withColumn("model", F.lit(2))).groupBy("news_id", "ticker").agg(F.max_by("direction", "model").alias("direction"), F.max("model").alias("model"))
    one = F.concat_ws(":", "ticker", "direction", F.col("model").cast("string"))
    nested = latest.groupBy("news_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("signals"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("direction") != "neutral").alias("directional"))
    events = scoped(spark, d).select("news_id", "scope", "kind", F.sha2(F.concat("title", F.lit("\n"), "lead"), 256).alias("content_hash"))
    return events.join(nested, "news_id").where("directional OR kind <> 'other'").select("news_id", "scope", "signals", "n", "content_hash")


# The causal feature row, five minutes after publication.
_back = lambda prev, name, series, goal, tol: f"{name} AS (SELECT {prev}.*, CASE WHEN b.at >= {goal} - INTERVAL {tol} THEN b.open END AS p_{name} FROM {prev} ASOF LEFT JOIN {series[0]} b ON {series[1]}{goal} >= b.at)"
_M = ("bench", "")
_s = lambda prev: ("bars", f"{prev}.ticker = b.ticker AND ")
FEATURES = """, m0 AS (SELECT *, decision_at AS published_at, decision_at + INTERVAL 5 MINUTE AS cut FROM sig),
cs AS (SELECT m0.*, CASE WHEN b.at >= cut - INTERVAL 20 MINUTE THEN b.open END AS p_cs, CASE WHEN b.at >= cut - INTERVAL 20 MINUTE THEN b.at END AS cs_at FROM m0 ASOF LEFT JOIN bars b ON m0.ticker = b.ticker AND m0.cut > b.at),
cb AS (SELECT cs.*, CASE WHEN b.at >= cut - INTERVAL 20 MINUTE THEN b.open END AS p_cb, CASE WHEN b.at >= cut - INTERVAL 20 MINUTE THEN b.at END AS cb_at FROM cs ASOF LEFT JOIN bench b ON cs.cut > b.at),
""" + ", ".join([
    _back("cb", "h1", _s("cb"), "cs_at - INTERVAL 1 HOUR", "20 MINUTE"), _back("h1", "d1", _s("h1"), "cs_at - INTERVAL 1 DAY", "4 DAY"), _back("d1", "d5", _s("d1"), "cs_at - INTERVAL 5 DAY", "4 DAY"),
    _back("d5", "b1", _M, "cb_at - INTERVAL 1 HOUR", "20 MINUTE"), _back("b1", "sl", _s("b1"), "cut", "20 MINUTE").replace("AS p_sl", "AS p_sl, CASE WHEN b.at >= cut - INTERVAL 20 MINUTE THEN b.at END AS sl_at"),
    _back("sl", "bl", _M, "cut", "20 MINUTE").replace("AS p_bl", "AS p_bl, CASE WHEN b.at >= cut - INTERVAL 20 MINUTE THEN b.at END AS bl_at"),
]) + """, sf AS (SELECT bl.*, CASE WHEN b.at <= published_at + INTERVAL 20 MINUTE THEN b.open END AS p_sf, CASE WHEN b.at <= published_at + INTERVAL 20 MINUTE THEN b.at END AS sf_at FROM bl ASOF LEFT JOIN bars b ON bl.ticker = b.ticker AND bl.published_at <= b.at),
bf AS (SELECT sf.*, CASE WHEN b.at <= published_at + INTERVAL 20 MINUTE THEN b.open END AS p_bf, CASE WHEN b.at <= published_at + INTERVAL 20 MINUTE THEN b.at END AS bf_at FROM sf ASOF LEFT JOIN bench b ON sf.published_at <= b.at),
dd AS (SELECT ticker, CAST(bars.at AS DATE) AS day, arg_max(open, (bars.at, bar_id)) AS o FROM bars GROUP BY 1, 2), dq AS (SELECT ticker, day, o / lag(o) OVER (PARTITION BY ticker ORDER BY day) - 1 AS r FROM dd),
dm AS (SELECT CAST(bench.at AS DATE) AS day, arg_max(open, bench.at) AS o FROM bench GROUP BY 1), dn AS (SELECT day, o / lag(o) OVER (ORDER BY day) - 1 AS m FROM dm),
dj AS (SELECT dq.ticker, dq.day, r, m FROM dq LEFT JOIN dn ON dq.day = dn.day), rk AS (SELECT ticker, day + 1 AS day, CASE WHEN count(r) OVER w20 >= 3 THEN stddev_samp(r) OVER w20 * 100 END AS vol,
  CASE WHEN count(r) OVER w60 >= 20 AND var_samp(m) OVER w60 > 0 THEN greatest(-2, least(4, covar_samp(r, m) OVER w60 / var_samp(m) OVER w60)) END AS beta FROM dj
  WINDOW w20 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
rr AS (SELECT bf.*, vol, beta FROM bf LEFT JOIN rk ON bf.ticker = rk.ticker AND CAST(bf.cut AS DATE) = rk.day),
fr AS (SELECT signal_id, ticker, published_at, cut, k, confidence, (p_cs / p_h1 - 1) * 100 AS pre_1h, (p_cs / p_d1 - 1) * 100 AS pre_1d, (p_cs / p_d5 - 1) * 100 AS pre_5d, (p_cb / p_b1 - 1) * 100 AS bench_1h, vol, beta,
  CASE WHEN sf_at <= sl_at THEN (p_sl / p_sf - 1) * 100 END AS stock, CASE WHEN bf_at <= bl_at THEN (p_bl / p_bf - 1) * 100 END AS bench FROM rr),
fe AS (SELECT *, stock - bench AS abnormal, pre_1h - beta * bench_1h AS beta_adjusted, abs(stock) AS abs_stock, abs(bench) AS abs_bench, abs(stock - bench) AS abs_abnormal, abs(stock - bench) / greatest(vol, 0.05) AS reaction_ratio,
  sin(2 * pi() * hour(cut) / 24) AS hour_sin, cos(2 * pi() * hour(cut) / 24) AS hour_cos, isodow(cut) - 1 AS weekday, month(cut) AS month, CASE WHEN hour(published_at) < 7 THEN 'pre_open' WHEN hour(published_at) * 60 + minute(published_at) < 950 THEN 'main' ELSE 'post_close' END AS session FROM fr)
"""
NUMERIC = "pre_1h pre_1d pre_5d bench_1h vol beta beta_adjusted stock bench abnormal abs_stock abs_bench abs_abnormal reaction_ratio hour_sin hour_cos".split()
REACTION = "stock bench abnormal abs_stock abs_bench abs_abnormal reaction_ratio".split()


def daily_risk(spark, d) -> DataFrame:
    """ticker, day, vol of 20 and beta of 60 daily returns known before the day."""
    day = F.to_date("at").alias("day")
    back = lambda key: Window.partitionBy(*key).orderBy("day")
    own = bars(spark, d).groupBy("ticker", day).agg(F.max_by("open", F.struct("at", "bar_id")).alias("o"))
    own = own.select("ticker", "day", (F.try_divide(F.col("o"), F.lag("o").over(back(["ticker"]))) - 1).alias("r"))
    index = benchmark_bars(spark, d).groupBy(day).agg(F.max_by("open", "at").alias("o"))
    index = index.select("day", (F.try_divide(F.col("o"), F.lag("o").over(back([F.lit(1)]))) - 1).alias("m"))  # one row a day
    j = own.join(index, "day", "left")
    w20, w60 = (back(["ticker"]).rowsBetween(1 - n, 0) for n in (20, 60))
    var = F.var_samp("m").over(w60)
    beta = F.when((F.count("r").over(w60) >= 20) & (var > 0), F.greatest(F.lit(-2.0), F.least(F.lit(4.0), F.covar_samp("r", "m").over(w60) / var)))
    return j.select("ticker", F.date_add("day", 1).alias("day"), F.when(F.count("r").over(w20) >= 3, F.stddev_samp("r").over(w20) * 100).alias("vol"), beta.alias("beta"))


def feature_rows(spark, d) -> DataFrame:
    """C3 of every signal: momentum, benchmark, risk, time, and the first reaction."""
    x = signals(spark, d).withColumnRenamed("decision_at", "published_at").withColumn("cut", F.col("published_at") + minutes(5))
    own, index = bars(spark, d), kept(benchmark_bars(spark, d), "benchmark")
    stock = lambda df, goals, **o: goal_values(df, "signal_id", own, ["ticker"], "at", "open", goals, **o)
    market = lambda df, goals, **o: goal_values(df, "signal_id", index, [], "at", "open", goals, **o)
    # What later steps build on is written once; chained, each step would work out all those before it again, several times.
    now = kept(stock(x, {"cs": ("cut", 1200, True), "sl": ("cut", 1200)}, forward=False), "stock-now")
    then = kept(market(x, {"cb": ("cut", 1200, True), "bl": ("cut", 1200)}, forward=False), "market-now")
    back = now.select("signal_id", "ticker", (F.col("cs_at") - hours(1)).alias("t1"), (F.col("cs_at") - F.expr("INTERVAL '1' DAY")).alias("t2"), (F.col("cs_at") - F.expr("INTERVAL '5' DAY")).alias("t3"))
    parts = [
        now, then, stock(back, {"h1": ("t1", 1200), "d1": ("t2", 345_600), "d5": ("t3", 345_600)}, forward=False),
        market(then.select("signal_id", (F.col("cb_at") - hours(1)).alias("t4")), {"b1": ("t4", 1200)}, forward=False),
        stock(x, {"sf": ("published_at", 1200)}), market(x, {"bf": ("published_at", 1200)}),
    ]
    for part in parts:
        x = x.join(part.drop("ticker"), "signal_id", "left")
    x = x.withColumn("day", F.to_date("cut")).join(daily_risk(spark, d), ["ticker", "day"], "left")
    x = x.withColumns({
        "pre_1h": change("cs", "h1") * 100, "pre_1d": change("cs", "d1") * 100, "pre_5d": change("cs", "d5") * 100, "bench_1h": change("cb", "b1") * 100,
        "stock": F.when(F.col("sf_at") <= F.col("sl_at"), change("sl", "sf") * 100), "bench": F.when(F.col("bf_at") <= F.col("bl_at"), change("bl", "bf") * 100),
    }).withColumn("abnormal", F.col("stock") - F.col("bench"))
    angle = 2 * F.pi() * F.hour("cut") / 24
    opened = F.hour("published_at")
    return x.withColumns({
        "beta_adjusted": F.col("pre_1h") - F.col("beta") * F.col("bench_1h"), "abs_stock": F.abs("stock"), "abs_bench": F.abs("bench"), "abs_abnormal": F.abs("abnormal"),
        "reaction_ratio": F.when(F.col("vol").isNotNull(), F.abs("abnormal") / F.greatest("vol", F.lit(0.05))).otherwise(F.abs("abnormal") / 0.05), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "weekday": F.weekday("cut").cast("long"), "month": F.month("cut").cast("long"),
        "session": F.when(opened < 7, "pre_open").when(opened * 60 + F.minute("published_at") < 950, "main").otherwise("post_close"),
    })


_rounded_sql = ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC)

def _round_all():
    return [F.round(c, 6).alias(c) for c in NUMERIC]


@query("materiality_features", FEATURES + f"SELECT signal_id, ticker, session, weekday, month, {_rounded_sql} FROM fe")
def materiality_features(spark, d):
    """C3."""
    return feature_rows(spark, d).select("signal_id", "ticker", "session", "weekday", "month", *_round_all())


@query("add_context", FEATURES + "SELECT signal_id, round(pre_1h, 6) AS pre_1h, round(bench_1h, 6) AS bench_1h, k >= 66 AS label FROM fe")
def add_context(spark, d):
    """Context before the event joined to labelled rows, whose labels and number stay as they were."""
    return feature_rows(spark, d).select("signal_id", F.round("pre_1h", 6).alias("pre_1h"), F.round("bench_1h", 6).alias("bench_1h"), (F.col("k") >= 66).alias("label"))


_view_sql = lambda view, react: f"SELECT signal_id, '{view}' AS view, " + ", ".join((f"round({c}, 6)" if react or c not in REACTION else "CAST(NULL AS DOUBLE)") + f" AS {c}" for c in NUMERIC) + f", {'round((k - 50) / 50.0 * abnormal, 6)' if react else 'CAST(NULL AS DOUBLE)'} AS polarity_reaction FROM fe"


@query("feature_views", FEATURES + _view_sql("publication", False) + " UNION ALL " + _view_sql("update_5m", True))
def feature_views(spark, d):
    """The row as known at publication (no reaction) and five minutes later, with polarity times reaction."""
    x = feature_rows(spark, d).withColumn("view", F.explode(F.array(F.lit("publication"), F.lit("update_5m"))))
    known = F.col("view") == "update_5m"
    cells = [F.when(known, F.round(c, 6)).alias(c) if c in REACTION else F.round(c, 6).alias(c) for c in NUMERIC]
    return x.select("signal_id", "view", *cells, F.when(known, F.round((F.col("k") - 50) / 50.0 * F.col("abnormal"), 6)).alias("polarity_reaction"))


@query("materiality_refresh", FEATURES + f""", du AS (SELECT *, CASE WHEN cut > TIMESTAMP '{NOW}' THEN 'not_due' WHEN abnormal IS NULL THEN 'no_reaction' WHEN pre_1h IS NULL THEN 'no_momentum' WHEN vol IS NULL THEN 'no_risk' END AS why FROM fe)
SELECT signal_id, CASE WHEN why IS NULL THEN 'scored' ELSE 'deferred' END AS status, why AS reason, CASE WHEN why IS NULL THEN round(1 / (1 + exp(-(-0.4 + 0.6 * reaction_ratio + 0.02 * abs(pre_1h) + 0.3 * confidence))), 6) END AS p FROM du WHERE coalesce(why, '') <> 'not_due'""")
def materiality_refresh(spark, d):
    """C4: due rows are scored, or deferred under the first input that is missing; the newest state of an id is what an upsert keeps."""
    why = F.when(F.col("cut") > F.expr(f"TIMESTAMP_NTZ '{NOW}'"), "not_due").when(F.col("abnormal").isNull(), "no_reaction").when(F.col("pre_1h").isNull(), "no_momentum").when(F.col("vol").isNull(), "no_risk")
    x = feature_rows(spark, d).withColumn("reason", why).where("coalesce(reason, '') <> 'not_due'")
    z = F.lit(-0.4) + 0.6 * F.col("reaction_ratio") + 0.02 * F.abs("pre_1h") + 0.3 * F.col("confidence")
    done = F.col("reason").isNull()
    return x.select("signal_id", F.when(done, "scored").otherwise("deferred").alias("status"), "reason", F.when(done, F.round(1 / (1 + F.exp(-z)), 6)).alias("p"))


@query("research_frame", FEATURES + "SELECT signal_id, ticker, session, round(abs_stock, 6) AS abs_stock, round(abs_abnormal, 6) AS abs_abnormal, abnormal > 0 AS up, abs_abnormal >= 1 AS material, abs(abnormal - (stock - bench)) <= 0.02 AS consistent FROM fe WHERE abnormal IS NOT NULL")
def research_frame(spark, d):
    """Flat rows with absolute features, label flags and the invariant that ties them."""
    x = feature_rows(spark, d).where("abnormal IS NOT NULL")
    return x.select("signal_id", "ticker", "session", F.round("abs_stock", 6).alias("abs_stock"), F.round("abs_abnormal", 6).alias("abs_abnormal"), (F.col("abnormal") > 0).alias("up"), (F.col("abs_abnormal") >= 1).alias("material"), (F.abs(F.col("abnormal") - (F.col("stock") - F.col("bench"))) <= 0.02).alias("consistent"))


_cut_sql = ", ".join(f"c{n} AS (SELECT {p}.*, CASE WHEN b.at + INTERVAL 1 MINUTE >= {t} - INTERVAL 3 MINUTE THEN b.open END AS q{n} FROM {p} ASOF LEFT JOIN {series} b ON {f'{p}.ticker = b.ticker AND ' if series == 'bars' else ''}{t} - INTERVAL 1 MINUTE >= b.at)"
                     for n, (p, t, series) in enumerate([("w0", "pub", "bars"), ("c0", "upd", "bars"), ("c1", "early", "bars"), ("c2", "pub", "bench"), ("c3", "upd", "bench"), ("c4", "early", "bench")]))


@query("market_features", f""", w0 AS (SELECT signal_id, ticker, decision_at AS pub, decision_at + INTERVAL 5 MINUTE AS upd, decision_at - INTERVAL 30 MINUTE AS early FROM sig), {_cut_sql},
v AS (SELECT *, (q0 / q2 - 1) * 100 AS s_pub, (q1 / q2 - 1) * 100 AS s_upd, (q3 / q5 - 1) * 100 AS b_pub, (q4 / q5 - 1) * 100 AS b_upd FROM c5)
SELECT signal_id, round(s_pub, 6) AS stock_pub, round(s_upd, 6) AS stock_upd, round(b_pub, 6) AS bench_pub, round(b_upd, 6) AS bench_upd, round(s_pub - b_pub, 6) AS abnormal_pub, round(s_upd - b_upd, 6) AS abnormal_upd, round(abs(s_upd - b_upd), 6) AS abs_upd FROM v""")
def market_features(spark, d):
    """Half-hour moves of completed bars up to publication and five minutes later, of stock, benchmark and their difference."""
    x = signals(spark, d).select("signal_id", "ticker", F.col("decision_at").alias("pub"), (F.col("decision_at") + minutes(5)).alias("upd"), (F.col("decision_at") - minutes(30)).alias("early"))
    goals = lambda p: {f"{p}_{t}": (t, 180) for t in ("pub", "upd", "early")}
    done = lambda df: df.withColumn("done", F.col("at") + minutes(1))
    x = asof_goals(x, "signal_id", done(bars(spark, d)), ["ticker"], "done", "open", goals("s"), forward=False)
    x = asof_goals(x, "signal_id", done(benchmark_bars(spark, d)), [], "done", "open", goals("b"), forward=False)
    move = lambda p, t: change(f"{p}_{t}", f"{p}_early") * 100
    gap = lambda t: move("s", t) - move("b", t)
    r = lambda c, n: F.round(c, 6).alias(n)
    return x.select("signal_id", r(move("s", "pub"), "stock_pub"), r(move("s", "upd"), "stock_upd"), r(move("b", "pub"), "bench_pub"), r(move("b", "upd"), "bench_upd"), r(gap("pub"), "abnormal_pub"), r(gap("upd"), "abnormal_upd"), r(F.abs(gap("upd")), "abs_upd"))


# Reports.
@query("coverage_lift", SCORED + """, c AS (SELECT p, count(*) AS n, sum(y) AS hits FROM x GROUP BY p), r AS (SELECT p, sum(n) OVER w AS m, sum(hits) OVER w AS h, sum(n) OVER () AS total, sum(hits) OVER () AS pos FROM c WINDOW w AS (ORDER BY p DESC)),
g AS (SELECT CAST(unnest([5, 10, 25, 50, 100]) AS INTEGER) AS coverage), t AS (SELECT coverage, min(m) AS m FROM r, g WHERE m >= greatest(1, ceil(total * coverage / 100.0)) GROUP BY coverage)
SELECT t.coverage, CAST(r.m AS BIGINT) AS selected, round(r.m / CAST(r.total AS DOUBLE), 6) AS share, round(r.h / CAST(r.m AS DOUBLE), 6) AS precision, round((r.h / CAST(r.m AS DOUBLE)) / (r.pos / CAST(r.total AS DOUBLE)), 6) AS lift FROM t JOIN r ON t.m = r.m""", base=False)
def coverage_lift(spark, d):
    """At each coverage (ties in), the share selected, its precision and the lift over prevalence."""
    c = scored(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))  # one row a distinct score
    r = running_sums(c, "p", {"m": "n", "h": "hits"}, descending=True, totals=True).withColumnsRenamed({"m_total": "total", "h_total": "pos"})
    g = r.withColumn("coverage", F.explode(F.array(*map(F.lit, (5, 10, 25, 50, 100))))).where("m >= greatest(1, ceil(total * coverage / 100.0))")
    t = g.groupBy("coverage").agg(F.min_by(F.struct("m", "h", "total", "pos"), "m").alias("x")).select("coverage", "x.*")
    precision = F.col("h") / F.col("m")
    return t.select("coverage", F.col("m").alias("selected"), F.round(F.col("m") / F.col("total"), 6).alias("share"), F.round(precision, 6).alias("precision"), F.round(precision / (F.col("pos") / F.col("total")), 6).alias("lift"))


_W = "(({h} / CAST({n} AS DOUBLE)) + 3.841458820694124 / (2 * {n}) - 1.959963984540054 * sqrt(({h} / CAST({n} AS DOUBLE)) * (1 - {h} / CAST({n} AS DOUBLE)) / {n} + 3.841458820694124 / (4.0 * {n} * {n}))) / (1 + 3.841458820694124 / {n})"


@query("direction_controls", SCORED + f""", a AS (SELECT y, p, unnest(['model', 'always_up', 'always_down', 'coin']) AS arm, unnest([(p >= 0.5) = (y = 1), y = 1, y = 0, doc_id % 2 = y]) AS hit, cluster FROM x),
f AS (SELECT arm, cluster, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS r FROM a GROUP BY arm, cluster), fc AS (SELECT arm, count(*) FILTER (r > 0.5) AS good_folds FROM f GROUP BY arm)
SELECT t.arm, t.n, t.hits, round(t.hits / CAST(t.n AS DOUBLE), 6) AS rate, round({_W.format(h='t.hits', n='t.n')}, 6) AS low, fc.good_folds FROM (SELECT arm, count(*) AS n, count(*) FILTER (hit) AS hits FROM a GROUP BY arm) t JOIN fc ON t.arm = fc.arm""", base=False)
def direction_controls(spark, d):
    """The model beside always-up, always-down and coin, with the interval's low end and the folds above one half."""
    arm = lambda n, hit: F.struct(F.lit(n).alias("arm"), hit.alias("hit"))
    y, p = F.col("y"), F.col("p")
    a = scored(spark, d).select("cluster", F.explode(F.array(arm("model", (p >= 0.5) == (y == 1)), arm("always_up", y == 1), arm("always_down", y == 0), arm("coin", F.col("doc_id") % 2 == y))).alias("a")).select("cluster", "a.*")
    f = a.groupBy("arm", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    t = f.groupBy("arm").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") * 2 > F.col("n")).alias("good_folds"))
    return t.select("arm", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(wilson(F.col("hits"), F.col("n"))[0], 6).alias("low"), "good_folds")


@query("deploy_gate", SCORED + f""", f AS (SELECT cluster, count(*) AS n, count(*) FILTER ((p >= 0.5) = (y = 1)) AS h FROM x GROUP BY cluster), t AS (SELECT sum(n) AS n, sum(h) AS h, count(*) FILTER (h * 2 > n) AS good, count(*) AS folds FROM f)
SELECT h / CAST(n AS DOUBLE) >= 0.58 AS hit_rate, {_W.format(h='h', n='n')} > 0.5 AS interval_low, good * 7 >= folds * 5 AS folds_positive, h / CAST(n AS DOUBLE) >= 0.58 AND {_W.format(h='h', n='n')} > 0.5 AND good * 7 >= folds * 5 AS deploy FROM t""", base=False)
def deploy_gate(spark, d):
    """Hit rate of .58, interval above one half, and five sevenths of the folds positive; all must hold."""
    f = scored(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("h"))
    t = f.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.count_if(F.col("h") * 2 > F.col("n")).alias("good"), F.count(F.lit(1)).alias("folds"))
    g = t.select((F.col("h") / F.col("n") >= 0.58).alias("hit_rate"), (wilson(F.col("h"), F.col("n"))[0] > 0.5).alias("interval_low"), (F.col("good") * 7 >= F.col("folds") * 5).alias("folds_positive"))
    return g.withColumn("deploy", F.col("hit_rate") & F.col("interval_low") & F.col("folds_positive"))


# Pairs of news.
_pair = f"""WITH t AS (SELECT doc_id AS id, source, doc_id AS h, {TOKENS.format(x="string_split(coalesce(text, ''), chr(10))[1]")} AS w FROM documents)"""


def titled_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", tokens(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("w"))


@query("eval_event_pairs", _pair + """ SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.source = b.source AND a.id < b.id AND b.h - a.h <= 72 AND len(a.w) > 0 AND len(b.w) > 0
WHERE (list_sort(a.w) = list_sort(b.w) OR len(list_intersect(a.w, b.w)) / CAST(least(len(a.w), len(b.w)) AS DOUBLE) >= 0.6) AND NOT (list_contains(a.w, 'the') AND NOT list_contains(b.w, 'the') AND list_contains(b.w, 'que') AND NOT list_contains(a.w, 'que'))
AND NOT (list_contains(a.w, 'que') AND NOT list_contains(b.w, 'que') AND list_contains(b.w, 'the') AND NOT list_contains(a.w, 'the'))""", base=False)
def eval_event_pairs(spark, d):
    """Titles of one source within 72 hours with equal tokens, or 0.6 of the smaller set shared, and no place on one side only against another.

    They meet on their rarest shared tokens: each side's prefix under one order by frequency, as long as an overlap of 0.6 needs.
    """
    t = titled_tokens(spark, d).where("size(w) > 0")
    df = t.select(F.explode("w").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("f"))
    ranked = t.select("id", "source", F.size("w").alias("n"), F.explode("w").alias("k")).join(df, "k").groupBy("id", "source", "n").agg(F.array_sort(F.collect_list(F.struct("f", "k"))).alias("o"))
    # Two sets that share 0.6 of the smaller one may differ in size without bound, so only the smaller side can cut its prefix.
    short = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * 0.6) + 1).cast("int"))
    slot = F.floor(F.col("id") / 72)
    small = ranked.select("source", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(short).alias("e"))
    small = small.select("source", F.col("e.k").alias("k"), "a", "na", F.explode(F.array(F.floor(F.col("a") / 72) - 1, F.floor(F.col("a") / 72), F.floor(F.col("a") / 72) + 1)).alias("slot"))
    large = ranked.select("source", F.col("id").alias("b"), F.col("n").alias("nb"), F.explode("o").alias("e"), slot.alias("slot")).select("source", F.col("e.k").alias("k"), "b", "nb", "slot")
    met = small.join(large, ["source", "k", "slot"]).where("a <> b AND abs(a - b) <= 72 AND (na < nb OR na = nb AND a < b)").select("a", "b").distinct()
    words = t.select("id", "w")
    both = met.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    share = F.size(F.array_intersect("wa", "wb")) / F.least(F.size("wa"), F.size("wb"))
    only = lambda w, v, p: F.array_contains(w, p) & ~F.array_contains(v, p)
    clash = only("wa", "wb", "the") & only("wb", "wa", "que") | only("wa", "wb", "que") & only("wb", "wa", "the")
    return both.where((share >= 0.6) & ~clash).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


@query("event_pairs", SCOPED + """, q AS (SELECT news_id, scope, kind, published_at, list_transform(m, lambda x: x.ticker) AS tickers, sectors FROM so WHERE len(m) > 0)
SELECT a.news_id AS x, b.news_id AS y FROM q a JOIN q b ON a.scope = b.scope AND a.kind = b.kind AND a.news_id < b.news_id AND b.published_at <= a.published_at + INTERVAL 48 HOUR WHERE list_has_any(a.tickers, b.tickers) AND (len(a.sectors) = 0 OR len(b.sectors) = 0 OR list_has_any(a.sectors, b.sectors))""", base=False)
def event_pairs(spark, d):
    """News of one scope and type within 48 hours that share a ticker, and a sector where both name any.

    They meet on scope, type, ticker and a 48-hour slot, the later side in its own slot and the one before.
    """
    q = scoped(spark, d).where("size(m) > 0").select("news_id", "scope", "kind", "published_at", F.transform("m", lambda x: x["ticker"]).alias("tickers"), "sectors")
    slot = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / 172_800)
    a = q.select("scope", "kind", F.col("news_id").alias("x"), F.col("published_at").alias("ta"), F.col("sectors").alias("sa"), F.explode("tickers").alias("ticker"), slot.alias("slot"))
    b = q.select("scope", "kind", F.col("news_id").alias("y"), F.col("published_at").alias("tb"), F.col("sectors").alias("sb"), F.explode("tickers").alias("ticker"), slot.alias("s")).withColumn("slot", F.explode(F.array("s", F.col("s") - 1)))
    met = a.join(b, ["scope", "kind", "ticker", "slot"]).where((F.col("x") < F.col("y")) & (F.col("tb") <= F.col("ta") + F.expr("INTERVAL '48' HOUR")))
    return met.where((F.size("sa") == 0) | (F.size("sb") == 0) | F.arrays_overlap("sa", "sb")).select("x", "y").distinct()


# Ingest, lineage, archives.
@query("ingest_conflicts", "SELECT source, n_chars, count(DISTINCT md5(text)) AS payloads, min(doc_id) AS first_id FROM documents GROUP BY source, n_chars HAVING count(DISTINCT md5(text)) > 1", base=False)
def ingest_conflicts(spark, d):
    """One idempotency key (here source and length) under several payload hashes."""
    h = F.md5(F.col("text").cast("binary"))
    return table(spark, d, "documents").groupBy("source", "n_chars").agg(F.count_distinct(h).alias("payloads"), F.min("doc_id").alias("first_id")).where("payloads > 1")


@query("replace_benchmark", ENTRY + TARGET.format(h="4 HOUR") + """, o AS (SELECT signal_id, entry, target, 'old' AS bench_id, 1.0 AS bench FROM h), n AS (SELECT signal_id, entry, target, 'new' AS bench_id, CAST(user_id % 7 AS DOUBLE) AS bench FROM h)
SELECT n.signal_id, n.bench_id, n.bench, o.entry IS NOT DISTINCT FROM n.entry AND o.target IS NOT DISTINCT FROM n.target AS core_equal FROM o JOIN n ON o.signal_id = n.signal_id""")
def replace_benchmark(spark, d):
    """V6: rows under a new benchmark, each with whether all other fields equal the old row's, nulls included."""
    h = horizon(entries(spark, d), spark, d, 4, "target").select("signal_id", "entry", "target", "user_id")
    old = h.select("signal_id", F.col("entry").alias("e0"), F.col("target").alias("t0"))
    new = h.select("signal_id", "entry", "target", F.lit("new").alias("bench_id"), (F.col("user_id") % 7).cast("double").alias("bench"))
    return new.join(old, "signal_id").select("signal_id", "bench_id", "bench", (F.col("entry").eqNullSafe(F.col("e0")) & F.col("target").eqNullSafe(F.col("t0"))).alias("core_equal"))


@query("production_examples", ENTRY + TARGET.format(h="4 HOUR") + """, ep AS (SELECT user_id, max(model) AS model FROM sig GROUP BY user_id), r AS (SELECT h.*, CASE WHEN h.model <> ep.model THEN 'old_epoch' WHEN direction = 'neutral' THEN 'neutral' WHEN e.value IS NULL THEN 'no_features' WHEN entry IS NULL THEN 'no_entry' WHEN target IS NULL THEN 'no_outcome' END AS reason
FROM h JOIN ep ON h.user_id = ep.user_id LEFT JOIN events e ON h.signal_id = e.event_id AND h.decision_at = e.ts) SELECT coalesce(reason, 'example') AS reason, count(*) AS n, min(signal_id) AS first_id FROM r GROUP BY 1""")
def production_examples(spark, d):
    """C20: stored outcomes of the latest epoch with their exact feature set become examples, others go under their first reason."""
    epochs = signals(spark, d).groupBy("user_id").agg(F.max("model").alias("newest"))
    sets = table(spark, d, "events").select(F.col("event_id").alias("signal_id"), F.col("ts").alias("decision_at"), "value")
    h = horizon(entries(spark, d), spark, d, 4, "target").join(epochs, "user_id").join(sets, ["signal_id", "decision_at"], "left")
    reason = F.when(F.col("model") != F.col("newest"), "old_epoch").when(F.col("direction") == "neutral", "neutral").when(F.col("value").isNull(), "no_features").when(F.col("entry").isNull(), "no_entry").when(F.col("target").isNull(), "no_outcome").otherwise("example")
    return h.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("signal_id").alias("first_id"))


@query("archive_candidates", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source || ':' || doc_id AS external_id, md5(text) AS content_md5, 'archive' AS origin, 'v2' AS schema_version, contains(text, 'edited') AS edited FROM r WHERE rn = 1""", base=False)
def archive_candidates(spark, d):
    """The first archive row of each payload as a candidate, with where it comes from."""
    h = F.md5(F.col("text").cast("binary"))
    first = table(spark, d, "documents").groupBy("source", h.alias("content_md5")).agg(F.min_by(F.struct("doc_id", F.col("text").contains("edited").alias("edited")), "doc_id").alias("r"))
    return first.select("r.doc_id", F.concat_ws(":", "source", F.col("r.doc_id").cast("string")).alias("external_id"), "content_md5", F.lit("archive").alias("origin"), F.lit("v2").alias("schema_version"), "r.edited")
