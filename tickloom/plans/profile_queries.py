"""Queries for market profiles and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import profile as pf
from tickloom.operators.blocks import all_pairs
from tickloom.plans import state_sql
from tickloom.plans.registry import REGISTERED, query
from tickloom.sources import derived as d

G = "PARTITION BY symbol, timeframe ORDER BY time"


def rows(n: int) -> str:
    return f"OVER ({G} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(c: str, f: str, n: int) -> str:
    return f"CASE WHEN count({c}) {rows(n)} = {n} THEN {f}({c}) {rows(n)} END"


TAIL = f"""WITH {d.WALK_SQL}, tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY time DESC) AS n_back FROM walk) WHERE n_back <= 100),
t AS (SELECT *, count(*) OVER (PARTITION BY symbol, timeframe) AS n, close / lag(close) OVER ({G}) - 1 AS ret, greatest(high - low, abs(high - lag(close) OVER ({G})), abs(low - lag(close) OVER ({G}))) AS tr FROM tb)"""


@query("volatility_cluster", f"""{TAIL}, v AS (SELECT *, {full('tr', 'avg', 14)} AS atr, {full('ret', 'stddev_samp', 14)} AS vol FROM t), w AS (SELECT *, last_value(vol) OVER ({G} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM v),
a AS (SELECT symbol, timeframe, arg_max(atr, time) / arg_max(close, time) * 100 AS ap, count(*) FILTER (vol < now) / count(vol) * 100 AS pct, arg_max(vol, time) / stddev_samp(ret) AS vr, avg(vol) FILTER (n_back <= 5) AS r, avg(vol) FILTER (n_back <= 20 AND n_back > 5) AS o FROM w GROUP BY 1, 2)
SELECT symbol, timeframe, round(ap, 4) AS atr_pct, CASE WHEN pct < 25 THEN 0 WHEN pct > 75 THEN 2 ELSE 1 END AS vol_regime, round(pct, 2) AS vol_percentile, CASE WHEN r > o * 1.1::DOUBLE THEN 1 ELSE 0 END AS vol_expanding, round(vr, 4) AS vol_ratio FROM a""")
def volatility_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.volatility(pf.tail(d.bars_walk(spark, sf_dir)))


@query("trend_cluster", f"""{TAIL}, c AS (SELECT *, abs(close - lag(close) OVER ({G})) AS ch, abs(close - lag(close, 20) OVER ({G})) AS way, {full('close', 'avg', 10)} AS s10, {full('close', 'avg', 30)} AS s30 FROM t), e AS (SELECT *, way / ({full('ch', 'sum', 20)} + 1e-10) AS er FROM c),
a AS (SELECT symbol, timeframe, arg_max(er, time) AS er, arg_max(s10, time) AS s10, arg_max(s30, time) AS s30, regr_slope(close, -n_back) FILTER (n_back <= 20) AS sl, max(close) FILTER (n_back <= 20) - min(close) FILTER (n_back <= 20) AS rng FROM e GROUP BY 1, 2)
SELECT symbol, timeframe, round(least(1, greatest(0, er)), 4) AS efficiency_ratio, CASE WHEN s10 > s30 * 1.01::DOUBLE THEN 1 WHEN s10 < s30 * 0.99::DOUBLE THEN -1 ELSE 0 END AS trend_direction, round(CASE WHEN rng > 0 THEN degrees(atan(sl / rng * 20)) ELSE 0 END, 2) AS trend_angle FROM a""")
def trend_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.trend(pf.tail(d.bars_walk(spark, sf_dir)))


@query("volume_cluster", f"""{TAIL}, o AS (SELECT *, sum(s) OVER ({G}) AS obv FROM (SELECT *, coalesce(sign(close - lag(close) OVER ({G})) * volume, 0) AS s FROM t)),
a AS (SELECT symbol, timeframe, arg_max(volume, time) / avg(volume) AS vr, avg(volume) FILTER (n_back <= 10) AS v10, avg(volume) FILTER (n_back <= 30 AND n_back > 10) AS v30, corr(ret, volume) AS c, avg(obv) FILTER (n_back <= 10) AS o10, avg(obv) FILTER (n_back <= 30) AS o30 FROM o GROUP BY 1, 2)
SELECT symbol, timeframe, round(vr, 4) AS volume_ratio, CASE WHEN v10 > v30 * 1.2::DOUBLE THEN 1 WHEN v10 < v30 * 0.8::DOUBLE THEN -1 ELSE 0 END AS volume_trend, round(coalesce(c, 0), 4) AS vp_correlation, CASE WHEN vr > 2 THEN 1 ELSE 0 END AS volume_climax, CASE WHEN o10 > o30 * 1.05::DOUBLE THEN 1 WHEN o10 < o30 * 0.95::DOUBLE THEN -1 ELSE 0 END AS obv_trend FROM a""")
def volume_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.volume(pf.tail(d.bars_walk(spark, sf_dir)))


@query("cycle_cluster", f"""{TAIL}, b AS (SELECT *, {full('tr', 'avg', 20)} AS atr, {full('close', 'avg', 20)} AS mid, {full('close', 'stddev_samp', 20)} AS sd, {full('close', 'avg', 50)} AS s50 FROM t),
a AS (SELECT symbol, timeframe, arg_max(close, time) AS c, arg_max(mid, time) AS mid, arg_max(mid + 2 * sd, time) - arg_max(mid - 2 * sd, time) AS wide, arg_max(mid - 2 * sd, time) AS low, arg_max(atr, time) AS atr, arg_max(s50, time) AS s50, max(mid) FILTER (n_back = 10) AS bf FROM b GROUP BY 1, 2)
SELECT symbol, timeframe, CASE WHEN c > mid AND mid > s50 AND mid > bf THEN 1 WHEN c > mid AND mid < bf THEN 2 WHEN c < mid AND mid < s50 AND mid < bf THEN 3 ELSE 0 END AS cycle_phase, round(CASE WHEN wide > 0 THEN least(1, greatest(0, (c - low) / wide)) ELSE 0.5 END, 4) AS bb_position,
  round(wide / mid * 100, 4) AS bb_width, CASE WHEN wide < 3 * atr THEN 1 ELSE 0 END AS squeeze, round((c - mid) / c * 100, 4) AS squeeze_momentum FROM a""")
def cycle_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.cycle(pf.tail(d.bars_walk(spark, sf_dir)))


@query("correlation_cluster", f"""{TAIL}, p AS (SELECT *, lag(ret) OVER ({G}) AS bf FROM t), j AS (SELECT p.*, q.ret AS br FROM p LEFT JOIN p q ON q.symbol = 'view' AND q.timeframe = p.timeframe AND q.time = p.time)
SELECT symbol, timeframe, round(corr(ret, bf), 4) AS auto_correlation, round(corr(ret, br), 4) AS benchmark_correlation FROM j GROUP BY 1, 2""")
def correlation_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.correlation(pf.tail(d.bars_walk(spark, sf_dir)), benchmark="view")


def _whole() -> str:
    """All clusters' statements side by side."""
    names = ("volatility_cluster", "trend_cluster", "momentum", "directional", "volume_cluster", "cycle_cluster", "correlation_cluster")
    own = {n: REGISTERED[n][1] for n in names if n.endswith("_cluster")} | {n: f"{TAIL}, {state_sql.MOMENTUM}, {state_sql.DIRECTIONAL} SELECT * FROM {n}" for n in ("momentum", "directional")}
    joined = " ".join(f"JOIN {n} USING (symbol, timeframe)" for n in names[1:])
    return f"WITH {', '.join(f'{n} AS ({own[n]})' for n in names)}, whole AS (SELECT * FROM {names[0]} {joined})"


@query("directional_cluster", f"{TAIL}, {state_sql.MOMENTUM}, {state_sql.DIRECTIONAL} SELECT * FROM directional")
def directional_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADX with both directional indices, by exponential means that begin in the tail."""
    return pf.directional(pf.tail(d.bars_walk(spark, sf_dir)))


SUMMARY = """SELECT symbol, timeframe, CASE WHEN vol_regime = 2 THEN 'volatile' WHEN vol_regime = 0 THEN 'low_volatility' WHEN adx > 25 AND trend_direction > 0 THEN 'trending_up' WHEN adx > 25 AND trend_direction < 0 THEN 'trending_down' ELSE 'ranging' END AS regime,
  round(least(100, greatest(0, adx * 0.4::DOUBLE + efficiency_ratio * 50 * 0.3::DOUBLE + trend_strength_pct * 0.2::DOUBLE + (macd_trend + 1) * 25 * 0.1::DOUBLE)), 2) AS trend_score,
  round(least(100, greatest(0, vol_percentile * 0.6::DOUBLE + least(vol_ratio * 30, 30) * 0.3::DOUBLE + vol_expanding * 10 * 0.1::DOUBLE)), 2) AS volatility_score,
  round(least(100, greatest(-100, (rsi_current - 50) * 2 * 0.5::DOUBLE + macd_trend * 20 * 0.3::DOUBLE + least(20, greatest(-20, rsi_slope * 50)) * 0.2::DOUBLE)), 2) AS momentum_score,
  concat_ws('_', ['accumulation', 'markup', 'distribution', 'markdown'][cycle_phase + 1], ['quiet', 'normal', 'volatile'][vol_regime + 1], CASE WHEN squeeze = 1 THEN 'squeeze' END, CASE WHEN trend_direction > 0 THEN 'bullish' WHEN trend_direction < 0 THEN 'bearish' ELSE 'neutral' END) AS market_condition FROM whole"""


@query("profile_summary", f"{_whole()} {SUMMARY}")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = pf.summarised(pf.profile(d.bars_walk(spark, sf_dir), benchmark="view"))
    return whole.select(*pf.SERIES, "regime", "trend_score", "volatility_score", "momentum_score", "market_condition")


@query("simple_profile", f"{_whole()} SELECT symbol, timeframe, atr_pct, adx, vol_percentile / 100 AS volatility, 0.5::DOUBLE + trend_direction * 0.25::DOUBLE AS trend_ratio, rsi_mean FROM whole")
def simple_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.simplified(pf.profile(d.bars_walk(spark, sf_dir), benchmark="view"))


PLACES = ", ".join(f"least(1, ({c} + {a}::DOUBLE) / {b}::DOUBLE)" if stops else f"({c} + {a}::DOUBLE) / {b}::DOUBLE" for c, a, b, stops in pf.COORDINATES)


@query("profile_vector", f"{_whole()} SELECT symbol, timeframe, generate_subscripts(v, 1)::INT AS place, round(unnest(v), 6) AS value FROM (SELECT symbol, timeframe, [{PLACES}] AS v FROM whole)")
def profile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pf.profile(d.bars_walk(spark, sf_dir), benchmark="view")
    places = t.select(*pf.SERIES, F.posexplode(pf.vector()).alias("place", "value"))
    return places.select(*pf.SERIES, (F.col("place") + 1).alias("place"), F.round("value", 6).alias("value"))


@query("market_profile", f"{_whole()} SELECT * FROM whole")
def market_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.profile(d.bars_walk(spark, sf_dir), benchmark="view")


REGIME = f"""{TAIL}, v AS (SELECT *, {full('tr', 'avg', 14)} AS atr, high - lag(high) OVER ({G}) AS up, lag(low) OVER ({G}) - low AS dn, close - lag(close) OVER ({G}) AS dl FROM t),
p AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM v), q AS (SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS mdm, {full('atr', 'sum', 14)} AS ra, avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) {rows(14)} AS g, avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) {rows(14)} AS l FROM p),
di AS (SELECT *, 100 * sum(pdm) {rows(14)} / ra AS pdi, 100 * sum(mdm) {rows(14)} / ra AS mdi FROM q), dx AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10) AS dx FROM di),
ad AS (SELECT *, {full('dx', 'avg', 14)} AS adx, {full('ret', 'stddev_samp', 20)} * sqrt(252) AS vo, CASE WHEN row_number() OVER ({G}) >= 14 THEN 100 - 100 / (1 + g / (l + 1e-10)) END AS rsi FROM dx),
a AS (SELECT symbol, timeframe, round(arg_max(atr, time) / arg_max(close, time) * 100, 4) AS atr_pct, round(arg_max(adx, time), 2) AS adx, round(arg_max(vo, time), 4) AS volatility, round(count(*) FILTER (ret > 0) / count(ret), 4) AS trend_ratio, round(avg(rsi) FILTER (n_back <= 20), 2) AS rsi_mean FROM ad GROUP BY 1, 2),
rg AS (SELECT *, CASE WHEN volatility > 0.5 THEN 'volatile' WHEN volatility < 0.15 THEN 'low_volatility' WHEN adx > 25 AND trend_ratio > 0.6 THEN 'trending_up' WHEN adx > 25 AND trend_ratio < 0.4 THEN 'trending_down' ELSE 'ranging' END AS regime FROM a)"""


@query("market_regime", f"{REGIME} SELECT * FROM rg")
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.regime(d.bars_walk(spark, sf_dir))


TWO = REGIME.replace("FROM walk)", "FROM (SELECT * FROM walk UNION ALL SELECT * FROM walk4))").replace(d.WALK_SQL, f"{d.WALK_SQL}, {d.WALK4_SQL}")


@query("regime_consensus", f"{TWO}, m AS (SELECT symbol, regime, count(*) AS c FROM rg GROUP BY 1, 2), k AS (SELECT *, sum(c) OVER (PARTITION BY symbol) AS total, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, regime) AS n FROM m) SELECT symbol, regime AS dominant, c >= 0.6 * total AS consensus FROM k WHERE n = 1")
def regime_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.consensus(pf.regime(d.bars_walk(spark, sf_dir)).unionByName(pf.regime(d.bars_walk(spark, sf_dir, "4h"))))


@query("profile_similarity", f"WITH {d.PROFILES_SQL} SELECT a.id AS query_id, b.id, round(least(1, greatest(0, list_cosine_similarity(a.vec, b.vec))), 4) AS similarity FROM profiles a, profiles b WHERE a.id % 50 = 0")
def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.profiles(spark, sf_dir)
    return all_pairs(p, p.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), pf.similarities, ["similarity"])
