"""Assessments of instruments: what prices, volumes and reports say, alone or under a signal.

Contributions and scores are held in whole hundredths (halves away from zero), so they add up exactly, and leave as points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clip(x: Column, low: float, high: float) -> Column:
    """x within its bounds; null stays null, which greatest and least would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _whole(x: Column) -> Column:
    return F.round(x).cast("long")


def market_state(daily: DataFrame, days: int = 21, sufficient_value: float = 5_000.0) -> DataFrame:
    """A row a ticker from its days (ticker, day, close, volume, value; one row a day, nulls allowed).

    one_day and five_day: changes in per cent over closes; volume_ratio: the last volume to the median of up to `days` - 1 before it,
    volumes of nothing left out; volatility: deviation of log returns in per cent over the last `days`, two returns at least;
    liquidity by the last day's value. Each is null (unavailable) where its days are too few. Ranks cut each ticker to its last days.
    """
    closed, traded = F.col("close") > 0, F.coalesce(F.col("volume") > 0, F.lit(False))
    newest = Window.partitionBy("ticker").orderBy(F.desc("day"))
    prices = daily.where(closed & F.col("day").isNotNull()).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= days + 1)
    prices = prices.withColumn("x", F.log(F.col("close") / F.lead("close").over(newest)))
    at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    change = lambda n: (F.try_divide(at(1, "close"), at(n, "close")) - 1) * 100
    liquidity = F.when(at(1, "value") >= sufficient_value, "sufficient").when(at(1, "value").isNotNull(), "limited").otherwise("unavailable")
    seen = prices.groupBy("ticker").agg(
        F.max("day").alias("as_of"), at(1, "close").alias("last_price"), change(2).alias("one_day"), change(6).alias("five_day"), F.when(F.count("x") >= 2, F.stddev_samp("x") * 100).alias("volatility"), liquidity.alias("liquidity")
    )
    volumes = daily.where(traded & F.col("day").isNotNull()).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= days)
    usual = volumes.groupBy("ticker").agg(F.try_divide(at(1, "volume"), F.median(F.when(F.col("n") > 1, F.col("volume")))).alias("volume_ratio"))
    return seen.join(usual, "ticker", "left")


def assess(requested: DataFrame, instruments: DataFrame, market: DataFrame, reports: DataFrame, active: DataFrame, threshold: float = 18.0, bias: float = 5.0) -> DataFrame:
    """A row for each requested ticker (unique), or its error.

    instruments: tickers that exist (unique); market: `market_state`; reports: ticker, published_at, news_id, balance (good less bad
    terms), of which the newest counts, ties to the larger news_id; active: at most one signal a ticker (ticker, signal_id, direction,
    score, confidence). A signal weighs 65 parts of a hundred, the rest 35. Only a directional signal gives a direction; without one
    the score stays a bias.
    """
    latest = reports.where("balance IS NOT NULL AND published_at IS NOT NULL").groupBy("ticker").agg(F.max_by(F.struct("balance", "news_id"), F.struct("published_at", "news_id")).alias("r"))
    signal = active.select("ticker", "signal_id", F.col("direction").alias("said"), _whole(F.col("score") * 100).alias("sh"), _whole(F.col("confidence") * 100).alias("ch"))
    x = requested.join(instruments.withColumn("known", F.lit(True)), "ticker", "left").join(market, "ticker", "left")
    x = x.join(latest.select("ticker", F.col("r.balance").alias("balance"), F.col("r.news_id").alias("report_id")), "ticker", "left").join(signal, "ticker", "left")
    one, five, ratio, vol = (F.col(c) for c in ("one_day", "five_day", "volume_ratio", "volatility"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = x.withColumn("reaction", zero(one) * 0.55 + zero(five) * 0.45).withColumns({
        "ph": _whole(_clip(zero(one) / 3 * 20 + zero(five) / 6 * 20, -40.0, 40.0) * 100),
        "vh": F.coalesce(_whole(F.signum("reaction") * 15 * _clip((ratio - 1) / 1.5, 0.0, 1.0) * 100), F.lit(0)),
        "rh": F.coalesce(_whole(_clip(F.col("balance") * 700, -2000, 2000)), F.lit(0)),
    })
    there = [one.isNotNull() | five.isNotNull(), ratio.isNotNull(), vol.isNotNull(), F.col("liquidity") != "unavailable", F.col("balance").isNotNull()]
    sure = 40 + 6 * sum(F.coalesce(t, F.lit(False)).cast("int") for t in there) + F.when(F.col("liquidity") == "sufficient", 8).when(F.col("liquidity") == "limited", -8).otherwise(0)
    sure = sure - F.when(vol > 4, F.least((vol - 4) * 2.5, F.lit(12.0))).otherwise(0.0)
    x = x.withColumn("qh", F.col("ph") + F.col("vh") + F.col("rh")).withColumn("qc", _whole(_clip(sure, 25.0, 85.0)))

    hybrid = F.col("signal_id").isNotNull()
    mix = lambda mine, rest: F.when(hybrid, _whole((F.col(mine) * 65 + F.col(rest) * 35) / 100)).otherwise(F.col(rest))
    x = x.withColumn("score_h", mix("sh", "qh")).withColumn("sure_h", mix("ch", "qc"))
    side = lambda c, edge: F.when(F.col(c) >= int(edge * 100), "up").when(F.col(c) <= -int(edge * 100), "down").otherwise("neutral")
    direction = F.when(F.col("said").isin("up", "down"), side("score_h", threshold)).otherwise("neutral")
    error = F.when(F.col("known").isNull(), "INSTRUMENT_NOT_FOUND").when(F.col("last_price").isNull(), "MARKET_DATA_UNAVAILABLE")
    part = lambda c, weight=35: F.when(hybrid, _whole(F.col(c) * weight / 100)).otherwise(F.col(c)) / 100
    columns = {
        "as_of": F.col("as_of"), "last_price": F.col("last_price"), "reaction_pct": _whole(F.col("reaction") * 100) / 100, "volume_ratio": _whole(ratio * 100) / 100, "volatility_pct": _whole(vol * 100) / 100, "liquidity": F.col("liquidity"),
        "report_balance": F.col("balance"), "report_id": F.col("report_id"), "price_part": part("ph"), "volume_part": part("vh"), "report_part": part("rh"), "signal_part": F.when(hybrid, _whole(F.col("sh") * 65 / 100) / 100), "signal_id": F.col("signal_id"),
        "assessment_type": F.when(hybrid, "hybrid").otherwise("quant"), "market_score": F.col("qh") / 100, "market_confidence": F.col("qc") / 100, "market_bias": side("qh", bias), "score": F.col("score_h") / 100, "confidence": F.col("sure_h") / 100,
        "direction": direction, "bias_direction": side("score_h", bias), "action": F.when(direction == "up", "consider_buy").when(direction == "down", "review_position").otherwise("no_action"),
        "agreement": F.when(hybrid, F.when(F.col("qh") * F.col("sh") > 0, "confirms").otherwise("differs")),
    }
    return x.select("ticker", error.alias("error"), *[F.when(error.isNull(), c).alias(name) for name, c in columns.items()])
