"""Market outcomes of signals, and the reports over them.

`outcomes` gives a row a signal: whether it was made in time, its entry, what was seen at each horizon, verdicts and states.
The reports take such rows. Returns are held in whole hundredths of a per cent (`bp_*`, halves away from zero), so that sums,
means and medians of them are exact and don't depend on the order of rows.

Signals: signal_id (unique), ticker, as_of, data_cutoff_at, created_at, news_id, direction, score, confidence, model_version,
config_version. News: news_id (unique), source_id, url, published_at, received_at. Bars: ticker, at, open, close, at most one a
ticker and time; bars without a time, or whose open is null, are none. Signals without a ticker or without a decision time have
no entry. A signal that lacks one of its own three times is retrospective, by reason missing_time. Empty tables give no
outcomes, and reports in which every fixed line stands with zeros and null rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_goals, asof_join
from .metrics import wilson

#: Hours after the entry. The verdict goes by the first of PRIMARY that has a return.
HORIZONS = {"1h": 1, "4h": 4, "1d": 24, "3d": 72}
PRIMARY = ("4h", "1h")
#: Lower ends of the bands of confidence.
BANDS = {"<60%": 0.0, "60-70%": 0.6, "70-80%": 0.7, ">=80%": 0.8}
COHORTS = ("all", "live", "retrospective")
FOREVER = 2_000_000_000  # seconds


def _seconds(late: str, early: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.round((micros(late) - micros(early)) / 1_000_000).cast("long")


def _hundredths(new: str, old: str) -> Column:
    return F.round((F.try_divide(F.col(new), F.col(old)) - 1) * 10_000).cast("long")


def _span(hours: int = 0, seconds: int = 0) -> Column:
    return F.make_dt_interval(hours=F.lit(hours), secs=F.lit(seconds))


def eligibility(signals: DataFrame, news: DataFrame, live_lag_s: int = 900) -> DataFrame:
    """signals with their news, reason (null: made in time), cohort, live_decision_at, decision_at, evaluation_anchor, processing_lag_seconds.

    Late signals are judged from when their evidence could be known, not from when they were made.
    """
    s = signals.join(news.withColumn("found", F.lit(True)), "news_id", "left")
    s = s.withColumn("known_at", F.greatest("as_of", "data_cutoff_at"))
    after = lambda a, b: F.col(a) > F.col(b)
    reason = (
        F.when(F.col("as_of").isNull() | F.col("data_cutoff_at").isNull() | F.col("created_at").isNull(), "missing_time")
        .when(after("as_of", "created_at"), "signal_as_of_after_creation").when(after("data_cutoff_at", "created_at"), "data_cutoff_after_creation")
        .when(F.col("found").isNull(), "missing_evidence").when(after("published_at", "created_at"), "evidence_published_after_signal")
        .when(after("received_at", "created_at"), "evidence_received_after_signal").when(F.col("created_at") > F.col("known_at") + _span(seconds=live_lag_s), "retrospective_signal")
    )
    s = s.withColumn("reason", reason)
    live, replayed = F.col("reason").isNull(), F.col("reason").isNotNull() & F.col("found").isNotNull()
    return s.select(
        "*", F.when(live, "live").otherwise("retrospective").alias("cohort"), F.greatest("known_at", "created_at").alias("live_decision_at"),
        F.when(replayed, F.greatest("known_at", "received_at")).otherwise(F.greatest("known_at", "created_at")).alias("decision_at"),
        F.when(replayed, "evidence_cutoff_replay").otherwise("live_decision").alias("evaluation_anchor"),
        *[F.when(lag.isNotNull(), F.greatest(F.lit(0), lag)).alias(f"{name}_lag_seconds") for name, lag in (("processing", _seconds("created_at", "known_at")), ("delivery", _seconds("received_at", "published_at")))],  # null of unknown times
    ).drop("found", "known_at")


def outcomes(signals: DataFrame, news: DataFrame, bars: DataFrame, now: Column, observation_lag_s: int = 1200, quiet_bp: int = 50) -> DataFrame:
    """A row a signal. Two as-of passes: the entry strictly after the decision, then all horizons at once.

    A horizon's observation is the first bar at or after it, timely within observation_lag_s; only a timely one gives a return.
    """
    own = bars.where("open IS NOT NULL")
    copies = signals.where("news_id IS NOT NULL").groupBy("ticker", "news_id").agg(F.count(F.lit(1)).alias("copies"))
    x = eligibility(signals, news).join(copies, ["ticker", "news_id"], "left")
    x = x.withColumn("raw_observation_count", F.coalesce("copies", F.lit(1))).drop("copies")
    x = asof_join(x, own, ["ticker"], "decision_at", "at", "open", "entry", strict=True)
    x = x.withColumns({f"target_{h}": F.col("entry_at") + _span(hours) for h, hours in HORIZONS.items()})
    x = asof_goals(x, "signal_id", own, ["ticker"], "at", "open", {f"seen_{h}": (f"target_{h}", FOREVER) for h in HORIZONS})
    latest = own.where("at IS NOT NULL").groupBy("ticker").agg(F.max_by("close", "at").alias("latest"))
    x = x.join(latest, "ticker", "left").withColumn("latest", F.when(F.col("entry").isNotNull(), F.col("latest")))
    for h in HORIZONS:
        x = x.withColumn(f"delay_{h}", _seconds(f"seen_{h}_at", f"target_{h}")).withColumn(f"timely_{h}", F.col(f"seen_{h}_at") <= F.col(f"target_{h}") + _span(seconds=observation_lag_s))
        x = x.withColumn(f"bp_{h}", F.when(F.col(f"timely_{h}"), _hundredths(f"seen_{h}", "entry")))

    past = lambda h: F.coalesce(now > F.col(f"target_{h}") + _span(seconds=observation_lag_s), F.lit(False))
    untimely = [F.coalesce(~F.col(f"timely_{h}"), F.lit(False)) for h in PRIMARY]
    x = x.withColumn("bp", F.coalesce(*[F.col(f"bp_{h}") for h in PRIMARY])).withColumn("status", F.when(F.col("entry").isNull(), "unavailable").when(F.col("bp_3d").isNotNull(), "evaluated").otherwise("partial"))
    neutral, none, missed = F.col("direction") == "neutral", F.col("entry").isNull(), untimely[0] | untimely[1] | past("1h")
    open_ = F.when(none, "unavailable").when(missed, "missed_window").otherwise("pending")
    verdict = F.when(F.col("direction") == "up", F.col("bp") > 0).when(F.col("direction") == "down", F.col("bp") < 0)
    return x.select(
        "*", verdict.alias("verdict"), F.when(neutral, "not_applicable").when(verdict.isNotNull(), "evaluated").otherwise(open_).alias("verdict_status"),
        F.when(neutral & F.col("bp").isNotNull(), F.when(F.abs("bp") < quiet_bp, "quiet").otherwise("material_move")).when(neutral, open_).alias("neutral_move_status"),
        (F.col("bp_3d").isNotNull() | past("3d")).alias("outcome_terminal"), _hundredths("latest", "entry").alias("bp_latest"),
    )


def share(part: Column, whole: Column) -> Column:
    """Per cent to one decimal; null of nothing."""
    return F.round(F.try_divide(part * 1000, whole)) / 10


def _rates(bp: Column) -> dict[str, Column]:
    signed = F.when(F.col("direction") == "up", bp).when(F.col("direction") == "down", -bp)
    return {
        "hit_rate_pct": share(F.count_if(signed > 0), F.count(signed)), "average_signed_return_pct": F.round(F.try_divide(F.sum(signed), F.count(signed))) / 100,
        "median_signed_return_pct": F.round(F.median(signed)) / 100,
    }


def _with_fixed(rows: DataFrame, fixed: list[dict]) -> DataFrame:
    """rows and, for each fixed group, a row of nulls, which counts of signal_id pass over."""
    return rows.unionByName(rows.sparkSession.createDataFrame(fixed, ", ".join(f"{c} string" for c in fixed[0])), allowMissingColumns=True)


def cohort_summary(done: DataFrame, methodology: str = "directional_up_down_only_v1") -> DataFrame:
    """Counts by state, rates and coverage of live, retrospective and all outcomes, in one pass."""
    rows = _with_fixed(done.withColumn("cohort", F.explode(F.array("cohort", F.lit("all")))), [{"cohort": c} for c in COHORTS])
    signed = F.col("direction").isin("up", "down")
    state = lambda s: F.count_if(signed & (F.col("verdict_status") == s))
    decided = F.count_if(signed & F.col("verdict").isNotNull())
    neutral = F.count_if(F.col("direction") == "neutral")
    out = rows.groupBy("cohort").agg(
        F.count("signal_id").alias("signals_total"), F.count_if(signed).alias("directional_signals"), neutral.alias("neutral_signals"), neutral.alias("not_applicable"),
        decided.alias("evaluated"), F.count_if(F.col("status") == "evaluated").alias("complete"), F.count_if(signed & (F.col("status") == "partial") & F.col("verdict").isNotNull()).alias("partial"),
        state("pending").alias("pending"), state("missed_window").alias("missed_window"), state("unavailable").alias("unavailable"),
        *[v.alias(k) for k, v in _rates(F.col("bp")).items()], F.coalesce(share(decided, F.count_if(signed)), F.lit(0.0)).alias("coverage_pct"),
    )
    return out.withColumn("quality_methodology", F.lit(methodology))


def exclusions(done: DataFrame) -> DataFrame:
    """Retrospective outcomes by the reason that they aren't live."""
    return done.where("cohort = 'retrospective'").groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def headline(done: DataFrame) -> DataFrame:
    """One row: the live cohort's rates beside both cohorts' sizes and coverage."""
    of = lambda cohort, c: F.max(F.when(F.col("cohort") == cohort, F.col(c)))
    live = [of("live", c).alias(c) for c in ("hit_rate_pct", "average_signed_return_pct", "median_signed_return_pct", "coverage_pct")]
    return cohort_summary(done).agg(
        F.lit("live").alias("metric_scope"), *live, of("live", "signals_total").alias("live_eligible"), of("retrospective", "signals_total").alias("research_only"),
        of("live", "evaluated").alias("live_evaluated"), of("retrospective", "evaluated").alias("research_evaluated"),
        of("live", "coverage_pct").alias("live_coverage_pct"), of("retrospective", "coverage_pct").alias("research_coverage_pct"),
    )


def breakdowns(done: DataFrame) -> DataFrame:
    """The metric slice by horizon, direction, ticker and band of confidence, in one pass; fixed groups stand even when empty."""
    c = F.col("confidence")
    ends = list(BANDS.values())[1:] + [1.01]
    band = F.coalesce(*[F.when((c >= low) & (c < high), name) for (name, low), high in zip(BANDS.items(), ends)])
    line = lambda dimension, value, bp: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"), F.col(bp).alias("r"))
    lines = [line("horizon", F.lit(h), f"bp_{h}") for h in HORIZONS] + [line("direction", F.col("direction"), "bp"), line("ticker", F.col("ticker"), "bp"), line("confidence", band, "bp")]
    rows = done.select("signal_id", "direction", F.inline(F.array(*lines))).where("value IS NOT NULL")
    fixed = [("horizon", h) for h in HORIZONS] + [("direction", s) for s in ("up", "down", "neutral")] + [("confidence", b) for b in BANDS]
    rows = _with_fixed(rows, [{"dimension": d, "value": v} for d, v in fixed])
    signed = F.col("direction").isin("up", "down")
    return rows.groupBy("dimension", "value").agg(
        F.count("signal_id").alias("signals"), F.count_if(signed).alias("directional_signals"), F.count_if(F.col("direction") == "neutral").alias("neutral_signals"),
        F.count_if(signed & F.col("r").isNotNull()).alias("observations"), *[v.alias(k) for k, v in _rates(F.col("r")).items()],
    )


def payoffs(done: DataFrame) -> DataFrame:
    """By cohort and arm, over four-hour returns of directional signals: rows, hits, rates with their 95 % interval, and the distribution.

    Arms: the system, always up and always down on its rows, and raw returns where it said up or down.
    """
    r, up = F.col("bp_4h"), F.col("direction") == "up"
    arm = lambda name, value: F.struct(F.lit(name).alias("arm"), value.alias("v"))
    arms = F.array(arm("system", F.when(up, r).otherwise(-r)), arm("always_up", r), arm("always_down", -r), arm("said_up", F.when(up, r)), arm("said_down", F.when(~up, r)))
    rows = done.where("direction IN ('up', 'down') AND bp_4h IS NOT NULL").select(F.explode(F.array("cohort", F.lit("all"))).alias("cohort"), arms.alias("arms"))
    g = rows.select("cohort", F.inline("arms")).where("v IS NOT NULL").groupBy("cohort", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 0).alias("hits"), F.sum("v").alias("total"), F.median("v").alias("mid"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    ends = wilson(F.col("hits"), F.col("n"))
    return g.select(
        "cohort", "arm", F.col("n").alias("observations"), "hits", share(F.col("hits"), F.col("n")).alias("hit_rate_pct"), *[F.round(e * 100, 4).alias(f"wilson_{side}_pct") for e, side in zip(ends, ("low", "high"))],
        F.round(F.col("total") / F.col("n") / 100, 6).alias("mean_pct"), (F.col("mid") / 100).alias("median_pct"), (F.col("low") / 100).alias("minimum_pct"), (F.col("high") / 100).alias("maximum_pct"),
    )


def cost_scenarios(done: DataFrame, costs_bps: tuple[int, ...] = (0, 10, 25, 50)) -> DataFrame:
    """By cohort and round-trip cost, over signed four-hour returns: sum, mean and event Sharpe after the cost, and the cost at which the mean is nothing."""
    r = F.when(F.col("direction") == "up", F.col("bp_4h")).otherwise(-F.col("bp_4h"))
    rows = done.where("direction IN ('up', 'down') AND bp_4h IS NOT NULL").select(F.explode(F.array("cohort", F.lit("all"))).alias("cohort"), r.alias("r"))
    g = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total"), F.stddev_samp("r").alias("spread"))
    c = g.withColumn("cost_bps", F.explode(F.array(*map(F.lit, costs_bps)))).withColumn("mean", F.col("total") / F.col("n") - F.col("cost_bps"))
    return c.select(
        "cohort", "cost_bps", F.col("n").alias("observations"), ((F.col("total") - F.col("n") * F.col("cost_bps")) / 100).alias("sum_pct"), F.round(F.col("mean") / 100, 6).alias("mean_pct"),
        F.round(F.try_divide(F.col("mean"), F.col("spread")), 6).alias("event_sharpe"), F.round(F.col("total") / F.col("n"), 6).alias("break_even_bps"),
    )


def export_columns(done: DataFrame, benchmark: str, methodology: str) -> DataFrame:
    """The flat form that files take: times in RFC 3339, returns in per cent."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    per_cent = lambda c: F.col(c) / 100
    return done.select(
        "signal_id", "ticker", text("as_of").alias("signal_as_of"), text("data_cutoff_at").alias("signal_data_cutoff_at"), text("created_at").alias("signal_created_at"),
        text("decision_at").alias("decision_at"), text("live_decision_at").alias("live_decision_at"), "evaluation_anchor", "processing_lag_seconds", F.lit(methodology).alias("evaluation_methodology"),
        F.col("reason").isNull().alias("evaluation_eligible"), F.col("reason").alias("exclusion_reason"), F.col("cohort").alias("eligibility_cohort"), "direction", "score", "confidence",
        "model_version", "config_version", F.lit(benchmark).alias("evaluation_benchmark"), "status", "news_id", F.col("source_id").alias("news_source_id"), F.col("url").alias("news_url"),
        text("published_at").alias("news_published_at"), text("received_at").alias("news_received_at"), "delivery_lag_seconds", text("entry_at").alias("entry_at"), F.round("entry", 4).alias("entry_price"),
        _seconds("entry_at", "decision_at").alias("entry_delay_seconds"), *[per_cent(f"bp_{h}").alias(f"return_{h}_pct") for h in HORIZONS], *[text(f"seen_{h}_at").alias(f"observed_{h}_at") for h in HORIZONS],
        *[F.col(f"delay_{h}").alias(f"observation_{h}_delay_seconds") for h in HORIZONS], F.round("latest", 4).alias("latest_price"), per_cent("bp_latest").alias("latest_return_pct"), "verdict", "verdict_status",
        "neutral_move_status", "outcome_terminal", "raw_observation_count",
    )
