"""Market profiles: what the last bars of each series say about volatility, trend, momentum, volume, cycle, correlation.

All indicators begin anew inside the tail, so the tail is taken first; a series is then a hundred rows, whatever its
history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import cosine
from tickloom.operators import indicators as ind
from tickloom.operators import recurrence as rec

SERIES = ("symbol", "timeframe")
LOOKBACK = 100


def tail(bars: DataFrame, n: int = LOOKBACK) -> DataFrame:
    """The last n bars of each series, numbered n_back from the end (1 is the last) and i from the first (1), with their count."""
    t = bars.withColumn("n_back", F.row_number().over(ind.series().orderBy(F.desc("time")))).filter(F.col("n_back") <= n)
    return t.withColumn("n", F.count("*").over(ind.series())).withColumn("i", F.col("n") - F.col("n_back") + 1)


def latest(c: str) -> Column:
    return F.max_by(c, "i")


def recent(c: str, n: int, skip: int = 0) -> Column:
    """Mean of c over the last n bars, the last `skip` of them left out."""
    return F.avg(F.when((F.col("n_back") <= n) & (F.col("n_back") > skip), F.col(c)))


def three_way(now: Column, before: Column, up: float, down: float) -> Column:
    return F.when(now > before * up, 1).when(now < before * down, -1).otherwise(0)


def default(c: Column, least: int, value: float, digits: int) -> Column:
    """c rounded, or value for series of under `least` bars or where c is null."""
    return F.when(F.col("n") >= least, F.coalesce(F.round(c, digits), F.lit(float(value)))).otherwise(float(value))


def volatility(t: DataFrame) -> DataFrame:
    t = ind.with_atr(t, 14).withColumn("ret", ind.returns())
    t = t.withColumn("vol", ind.deviation(F.col("ret"), 14))
    t = t.withColumn("vol_now", F.last("vol").over(ind.series().orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    a = t.groupBy(*SERIES).agg(F.first("n").alias("n"), (latest("atr") / latest("close") * 100).alias("atr_pct"), (F.count_if(F.col("vol") < F.col("vol_now")) / F.count("vol") * 100).alias("pct"), latest("vol").alias("vol"), F.stddev_samp("ret").alias("all_vol"), recent("vol", 5).alias("r"), recent("vol", 20, 5).alias("o"))
    pct = F.coalesce(F.col("pct"), F.lit(50.0))
    return a.select(*SERIES, default(F.col("atr_pct"), 20, 0, 4).alias("atr_pct"), F.when(F.col("n") < 20, 1).when(pct < 25, 0).when(pct > 75, 2).otherwise(1).alias("vol_regime"), default(F.col("pct"), 20, 50, 2).alias("vol_percentile"), F.when((F.col("n") >= 20) & (F.col("r") > F.col("o") * 1.1), 1).otherwise(0).alias("vol_expanding"), default(F.when(F.col("all_vol") > 0, F.col("vol") / F.col("all_vol")).otherwise(1.0), 20, 1, 4).alias("vol_ratio"))


def slope(c: str, n: int) -> Column:
    """Least-squares slope of c over the last n bars."""
    return F.regr_slope(F.when(F.col("n_back") <= n, F.col(c)), F.when(F.col("n_back") <= n, F.col("i").cast("double")))


def trend(t: DataFrame) -> DataFrame:
    t = ind.with_efficiency(t, 20).withColumn("s10", ind.sma(F.col("close"), 10)).withColumn("s30", ind.sma(F.col("close"), 30))
    top = lambda f, c: f(F.when(F.col("n_back") <= 20, F.col(c)))
    a = t.groupBy(*SERIES).agg(F.first("n").alias("n"), latest("efficiency").alias("er"), latest("s10").alias("s10"), latest("s30").alias("s30"), slope("close", 20).alias("slope"), (top(F.max, "close") - top(F.min, "close")).alias("rng"))
    angle = F.when(F.col("rng") > 0, F.degrees(F.atan(F.col("slope") / F.col("rng") * 20))).otherwise(0.0)
    return a.select(*SERIES, default(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("er"))), 30, 0.5, 4).alias("efficiency_ratio"), F.when(F.col("n") >= 30, three_way(F.col("s10"), F.col("s30"), 1.01, 0.99)).otherwise(0).alias("trend_direction"), default(angle, 30, 0, 2).alias("trend_angle"))


def volume(t: DataFrame) -> DataFrame:
    t = ind.with_obv(t.withColumn("ret", ind.returns()))
    a = t.groupBy(*SERIES).agg(F.first("n").alias("n"), (latest("volume") / F.avg("volume")).alias("ratio"), recent("volume", 10).alias("v10"), recent("volume", 30, 10).alias("v30"), F.corr("ret", F.when(F.col("ret").isNotNull(), F.col("volume"))).alias("corr"), recent("obv", 10).alias("o10"), recent("obv", 30).alias("o30"))
    known = F.col("n") >= 20
    return a.select(*SERIES, default(F.col("ratio"), 20, 1, 4).alias("volume_ratio"), F.when(known, three_way(F.col("v10"), F.col("v30"), 1.2, 0.8)).otherwise(0).alias("volume_trend"), default(F.col("corr"), 20, 0, 4).alias("vp_correlation"), F.when(known & (F.col("ratio") > 2), 1).otherwise(0).alias("volume_climax"), F.when(known, three_way(F.col("o10"), F.col("o30"), 1.05, 0.95)).otherwise(0).alias("obv_trend"))


def cycle(t: DataFrame) -> DataFrame:
    t = ind.with_bollinger(ind.with_atr(t, 20), 20, 2.0).withColumn("s50", ind.sma(F.col("close"), 50))
    at = lambda c, back: F.max(F.when(F.col("n_back") == back, F.col(c)))
    a = t.groupBy(*SERIES).agg(F.first("n").alias("n"), *[latest(c).alias(c) for c in ("close", "bb_mid", "bb_upper", "bb_lower", "atr", "s50")], at("bb_mid", 10).alias("before"))
    c, mid, before, wide = F.col("close"), F.col("bb_mid"), F.col("before"), F.col("bb_upper") - F.col("bb_lower")
    phase = F.when((c > mid) & (mid > F.col("s50")) & (mid > before), 1).when((c > mid) & (mid < before), 2).when((c < mid) & (mid < F.col("s50")) & (mid < before), 3).otherwise(0)
    return a.select(*SERIES, F.when(F.col("n") >= 30, phase).otherwise(0).alias("cycle_phase"), default(F.when(wide > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - F.col("bb_lower")) / wide))), 30, 0.5, 4).alias("bb_position"), default(F.when(mid > 0, wide / mid * 100), 30, 0, 4).alias("bb_width"), F.when((F.col("n") >= 30) & (wide < 3 * F.col("atr")), 1).otherwise(0).alias("squeeze"), default(F.when(c > 0, (c - mid) / c * 100), 30, 0, 4).alias("squeeze_momentum"))


def correlation(t: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Correlation of returns with those one bar earlier, and with the benchmark symbol's at the same times."""
    t = t.withColumn("ret", ind.returns()).withColumn("before", F.lag("ret").over(ind.by_time()))
    if benchmark is not None:
        other = t.filter(F.col("symbol") == benchmark).select("timeframe", "time", F.col("ret").alias("bench"))
        t = t.join(other, ["timeframe", "time"], "left")
    else:
        t = t.withColumn("bench", F.lit(None).cast("double"))
    pair = lambda c: F.when(F.count(F.when(F.col("ret").isNotNull() & F.col(c).isNotNull(), 1)) > 10, F.corr("ret", F.col(c)))
    a = t.groupBy(*SERIES).agg(F.first("n").alias("n"), pair("before").alias("auto"), pair("bench").alias("bench"))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return a.select(*SERIES, default(real("auto"), 30, 0, 4).alias("auto_correlation"), default(real("bench"), 30, 0, 4).alias("benchmark_correlation"))


def profile(bars: DataFrame, lookback: int = LOOKBACK, benchmark: str | None = None) -> DataFrame:
    """One row per series with all clusters; the sides are a row per series each."""
    t = tail(bars, lookback)
    out = volatility(t)
    for part in (trend(t), exponentials(t), volume(t), cycle(t), correlation(t, benchmark)):
        out = out.join(part, list(SERIES))
    return out


def regime(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """The five-field profile and the regime that a decision tree gives; series without lookback bars are ranging."""
    t = tail(bars, lookback)
    t = ind.with_volatility(ind.with_rsi(ind.with_adx(t, 14), 14, epsilon=1e-10), 20)
    a = t.groupBy(*SERIES).agg(F.first("n").alias("n"), (latest("atr") / latest("close") * 100).alias("atr_pct"), latest("adx").alias("adx"), latest("volatility").alias("volatility"), (F.count_if(F.col("ret") > 0) / F.count("ret")).alias("trend_ratio"), recent("rsi", 20).alias("rsi_mean"))
    a = a.select(*SERIES, default(F.col("atr_pct"), lookback, 0, 4).alias("atr_pct"), F.when(F.col("n") >= lookback, F.round(F.coalesce("adx", F.lit(20.0)), 2)).otherwise(0.0).alias("adx"), F.when(F.col("n") >= lookback, F.round(F.coalesce("volatility", F.lit(0.3)), 4)).otherwise(0.0).alias("volatility"), default(F.col("trend_ratio"), lookback, 0.5, 4).alias("trend_ratio"), default(F.col("rsi_mean"), lookback, 50, 2).alias("rsi_mean"), "n")
    strong = F.col("adx") > 25
    kind = F.when(F.col("n") < lookback, "ranging").when(F.col("volatility") > 0.5, "volatile").when(F.col("volatility") < 0.15, "low_volatility").when(strong & (F.col("trend_ratio") > 0.6), "trending_up").when(strong & (F.col("trend_ratio") < 0.4), "trending_down").otherwise("ranging")
    return a.withColumn("regime", kind).drop("n")


def consensus(regimes: DataFrame, share: float = 0.6) -> DataFrame:
    """Per symbol the most frequent regime over its timeframes (ties by name) and whether `share` of them agree."""
    n = regimes.groupBy("symbol", "regime").agg(F.count("*").alias("c"))
    by = W.partitionBy("symbol")
    t = n.withColumn("_all", F.sum("c").over(by)).withColumn("_n", F.row_number().over(by.orderBy(F.desc("c"), "regime"))).filter("_n = 1")
    return t.select("symbol", F.col("regime").alias("dominant"), (F.col("c") >= share * F.col("_all")).alias("consensus"))


def similarity(a: Column, b: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(a, b))), 4)


EXPONENTIALS = (
    "rsi_current double, rsi_mean double, rsi_std double, rsi_slope double, overbought_pct double, oversold_pct double, macd_histogram double, macd_trend int, "
    "adx double, plus_di double, minus_di double, trend_strength_pct double"
)


def _exponentials(f: pd.DataFrame) -> dict:
    """RSI, MACD and directional index of one tail in time order, with the defaults of a short one."""
    out = {"rsi_current": 50.0, "rsi_mean": 50.0, "rsi_std": 10.0, "rsi_slope": 0.0, "overbought_pct": 0.0, "oversold_pct": 0.0, "macd_histogram": 0.0, "macd_trend": 0, "adx": 20.0, "plus_di": 25.0, "minus_di": 25.0, "trend_strength_pct": 0.0}
    high, low, close = (f[c].to_numpy() for c in ("high", "low", "close"))
    if len(close) < 30:
        return out
    d = np.diff(close, prepend=close[:1])
    rsi = 100 - 100 / (1 + rec.ema(np.where(d > 0, d, 0.0), 14) / (rec.ema(np.where(d < 0, -d, 0.0), 14) + 1e-10))
    line = rec.ema(close, 12) - rec.ema(close, 26)
    hist = line - rec.ema(line, 9)
    now, before = hist[-5:].mean(), hist[-15:-5].mean()
    out |= {"rsi_current": round(rsi[-1], 2), "rsi_mean": round(rsi.mean(), 2), "rsi_std": round(rsi.std(ddof=1), 2), "rsi_slope": round(np.polyfit(np.arange(10), rsi[-10:], 1)[0], 4)}
    out |= {"overbought_pct": round((rsi > 70).mean() * 100, 2), "oversold_pct": round((rsi < 30).mean() * 100, 2), "macd_histogram": round(hist[-1], 6), "macd_trend": 1 if now > before * 1.1 else -1 if now < before * 0.9 else 0}
    adx, plus, minus = rec.directional(high, low, close, 14)
    strength = abs(plus[-1] - minus[-1]) / (plus[-1] + minus[-1]) * 100 if plus[-1] + minus[-1] > 0 else 0.0
    return out | {"adx": round(adx[-1], 2), "plus_di": round(plus[-1], 2), "minus_di": round(minus[-1], 2), "trend_strength_pct": round(strength, 2)}


def exponentials(t: DataFrame) -> DataFrame:
    """What exponential means that begin in the tail say: one small group per series."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("time")
        return pd.DataFrame([{"symbol": f["symbol"].iloc[0], "timeframe": f["timeframe"].iloc[0]} | _exponentials(f)])

    return t.select(*SERIES, "time", "high", "low", "close").groupBy(*SERIES).applyInPandas(run, f"symbol string, timeframe string, {EXPONENTIALS}")


DIRECTIONAL = ("adx", "plus_di", "minus_di", "trend_strength_pct")


def momentum(t: DataFrame) -> DataFrame:
    return exponentials(t).drop(*DIRECTIONAL)


def directional(t: DataFrame) -> DataFrame:
    return exponentials(t).select(*SERIES, *DIRECTIONAL)


def summarised(profiles: DataFrame) -> DataFrame:
    """Adds regime, the scores of trend, volatility and momentum, and a condition in words, from all clusters."""
    c = F.col
    between = lambda lo, x, hi: F.round(F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)), 2)
    trending = F.when(c("adx") > 25, F.when(c("trend_direction") > 0, "trending_up").when(c("trend_direction") < 0, "trending_down"))
    regime = F.when(c("vol_regime") == 2, "volatile").when(c("vol_regime") == 0, "low_volatility").otherwise(F.coalesce(trending, F.lit("ranging")))
    trend_score = c("adx") * 0.4 + c("efficiency_ratio") * 50 * 0.3 + c("trend_strength_pct") * 0.2 + (c("macd_trend") + 1) * 25 * 0.1
    vol_score = c("vol_percentile") * 0.6 + F.least(c("vol_ratio") * 30, F.lit(30.0)) * 0.3 + c("vol_expanding") * 10 * 0.1
    slope_part = F.least(F.lit(20.0), F.greatest(F.lit(-20.0), c("rsi_slope") * 50))
    momentum_score = (c("rsi_current") - 50) * 2 * 0.5 + c("macd_trend") * 20 * 0.3 + slope_part * 0.2
    named = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    side = F.when(c("trend_direction") > 0, "bullish").when(c("trend_direction") < 0, "bearish").otherwise("neutral")
    words = F.concat_ws("_", named(("accumulation", "markup", "distribution", "markdown"), c("cycle_phase")), named(("quiet", "normal", "volatile"), c("vol_regime")), F.when(c("squeeze") == 1, "squeeze"), side)
    return profiles.select("*", regime.alias("regime"), between(0, trend_score, 100).alias("trend_score"), between(0, vol_score, 100).alias("volatility_score"), between(-100, momentum_score, 100).alias("momentum_score"), words.alias("market_condition"))


def simplified(profiles: DataFrame) -> DataFrame:
    """The five-field form of older records."""
    return profiles.select(*SERIES, "atr_pct", "adx", (F.col("vol_percentile") / 100).alias("volatility"), (0.5 + F.col("trend_direction") * 0.25).alias("trend_ratio"), "rsi_mean")


#: The 32 coordinates of a profile's vector: column, what is added, divisor, and whether it stops at 1.
COORDINATES = (
    ("atr_pct", 0, 5, True), ("vol_regime", 0, 2, False), ("vol_percentile", 0, 100, False), ("vol_expanding", 0, 1, False), ("vol_ratio", 0, 3, True),
    ("adx", 0, 100, True), ("plus_di", 0, 100, True), ("minus_di", 0, 100, True), ("efficiency_ratio", 0, 1, False), ("trend_direction", 1, 2, False), ("trend_strength_pct", 0, 100, False), ("trend_angle", 90, 180, False),
    ("rsi_current", 0, 100, False), ("rsi_mean", 0, 100, False), ("rsi_std", 0, 30, True), ("rsi_slope", 5, 10, False), ("overbought_pct", 0, 100, False), ("oversold_pct", 0, 100, False), ("macd_histogram", 0.01, 0.02, False), ("macd_trend", 1, 2, False),
    ("volume_ratio", 0, 3, True), ("volume_trend", 1, 2, False), ("vp_correlation", 1, 2, False), ("volume_climax", 0, 1, False), ("obv_trend", 1, 2, False),
    ("cycle_phase", 0, 3, False), ("bb_position", 0, 1, False), ("bb_width", 0, 10, True), ("squeeze", 0, 1, False), ("squeeze_momentum", 5, 10, False),
    ("auto_correlation", 1, 2, False), ("benchmark_correlation", 1, 2, False),
)


def vector() -> Column:
    """The profile as 32 numbers, most of them between 0 and 1."""
    place = lambda c, add, by: (F.col(c).cast("double") + add) / by
    return F.array(*[F.least(F.lit(1.0), place(c, add, by)) if stops else place(c, add, by) for c, add, by, stops in COORDINATES])


def similarities(x: np.ndarray, good: np.ndarray, q: np.ndarray, fine: np.ndarray) -> list[np.ndarray]:
    """similarity of every row of q to every row of x; 0 where a vector has no length or isn't whole."""
    with np.errstate(all="ignore"):
        a, b = (np.sqrt((m * m).sum(axis=1)) for m in (q, x))
        cosine = np.maximum(0.0, np.fmin(1.0, (q @ x.T) / (a[:, None] * b)))
    cosine[~fine | (a <= 0)] = 0.0
    cosine[:, ~good | (b <= 0)] = 0.0
    return [np.floor(cosine * 1e4 + 0.5) / 1e4]
