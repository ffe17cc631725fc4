"""Queries over bars: cleaning, ranges, as-of joins, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.operators import indicators as ind
from tickloom.operators import recurrence as rec
from tickloom.plans import state_sql
from tickloom.plans.registry import query
from tickloom.sources import derived as d

B, WALK = f"WITH RECURSIVE {d.BARS_SQL}", f"WITH RECURSIVE {d.WALK_SQL}"
G = "PARTITION BY symbol, timeframe ORDER BY time"
KEY = ("symbol", "timeframe", "time")


def rows(n: int) -> str:
    return f"OVER ({G} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*KEY, *[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in columns])


@query("bars", f"{B} SELECT * FROM bars")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.bars(spark, sf_dir)


@query("price_sources", f"{B} SELECT symbol, timeframe, time, round((high + low) / 2, 6) AS hl2, round((high + low + close) / 3, 6) AS hlc3, round((open + high + low + close) / 4, 6) AS ohlc4 FROM bars")
def price_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(d.bars(spark, sf_dir).select(*KEY, *ind.price_sources()), "hl2", "hlc3", "ohlc4")


TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({G})), abs(low - lag(close) OVER ({G}))) AS tr, row_number() OVER ({G}) AS n FROM bars)"
ATR = f"{TR}, atr AS (SELECT *, CASE WHEN n >= 14 THEN avg(tr) {rows(14)} END AS atr FROM tr)"


@query("true_range_atr", f"{B}, {ATR} SELECT symbol, timeframe, time, round(tr, 6) AS tr, round(atr, 6) AS atr FROM atr")
def true_range_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_atr(d.bars(spark, sf_dir)), "tr", "atr")


@query("sma", f"{B} SELECT symbol, timeframe, time, round(avg(close) {rows(20)}, 6) AS sma_partial, round(CASE WHEN row_number() OVER ({G}) >= 20 THEN avg(close) {rows(20)} END, 6) AS sma FROM bars")
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(d.bars(spark, sf_dir).select("*", ind.sma(F.col("close"), 20, strict=False).alias("sma_partial"), ind.sma(F.col("close"), 20).alias("sma")), "sma_partial", "sma")


RSI = f"""dl AS (SELECT *, close - lag(close) OVER ({G}) AS dl, row_number() OVER ({G}) AS n FROM {{source}}),
gl AS (SELECT *, avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) {rows(14)} AS g, avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) {rows(14)} AS l FROM dl),
rs AS (SELECT *, CASE WHEN n < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END AS rsi FROM gl)"""


@query("rsi", f"{B}, {RSI.format(source='bars')} SELECT symbol, timeframe, time, round(rsi, 6) AS rsi FROM rs")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_rsi(d.bars(spark, sf_dir)), "rsi")


CROSS = f"""{RSI.format(source='walk')}, ma AS (SELECT *, CASE WHEN rsi IS NOT NULL THEN avg(rsi) {rows(9)} END AS rsi_ma FROM rs),
cr AS (SELECT *, coalesce(lag(rsi) OVER ({G}) <= lag(rsi_ma) OVER ({G}) AND rsi > rsi_ma, false) AS cross_up, coalesce(lag(rsi) OVER ({G}) >= lag(rsi_ma) OVER ({G}) AND rsi < rsi_ma, false) AS cross_down FROM ma)"""


@query("rsi_cross", f"{WALK}, {CROSS} SELECT symbol, timeframe, time, round(rsi_ma, 6) AS rsi_ma, cross_up, cross_down FROM cr")
def rsi_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_rsi_cross(d.bars_walk(spark, sf_dir)), "rsi_ma", "cross_up", "cross_down")


@query("rsi_divergence", f"""{WALK}, {CROSS}, sg AS (SELECT *, sum(cross_down::INT) OVER ({G}) AS seg FROM cr), en AS (SELECT *, min(CASE WHEN cross_up THEN time END) OVER (PARTITION BY symbol, timeframe, seg) AS done FROM sg),
sm AS (SELECT symbol, timeframe, seg, min(rsi) AS rsi, arg_min(low, (rsi, time)) AS low, any_value(done) AS time FROM en WHERE seg > 0 AND done IS NOT NULL AND time < done GROUP BY 1, 2, 3),
pv AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol, timeframe ORDER BY seg) AS r0, lag(low) OVER (PARTITION BY symbol, timeframe ORDER BY seg) AS l0 FROM sm)
SELECT symbol, timeframe, time, CASE WHEN low < l0 THEN 'regular' ELSE 'hidden' END AS kind FROM pv WHERE (low < l0 AND rsi > r0) OR (low > l0 AND rsi < r0)""")
def rsi_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.rsi_segments(d.bars_walk(spark, sf_dir))


@query("rsi_bear_divergence", f"""{WALK}, {CROSS}, sg AS (SELECT *, sum(cross_up::INT) OVER ({G}) AS seg FROM cr), en AS (SELECT *, min(CASE WHEN cross_down THEN time END) OVER (PARTITION BY symbol, timeframe, seg) AS done FROM sg),
sm AS (SELECT symbol, timeframe, seg, max(rsi) AS rsi, arg_min(high, (-rsi, time)) AS high, any_value(done) AS time FROM en WHERE seg > 0 AND done IS NOT NULL AND time < done GROUP BY 1, 2, 3),
pv AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol, timeframe ORDER BY seg) AS r0, lag(high) OVER (PARTITION BY symbol, timeframe ORDER BY seg) AS h0 FROM sm)
SELECT symbol, timeframe, time, CASE WHEN high > h0 THEN 'regular' ELSE 'hidden' END AS kind FROM pv WHERE (high > h0 AND rsi < r0) OR (high < h0 AND rsi > r0)""")
def rsi_bear_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.rsi_segments(d.bars_walk(spark, sf_dir), bull=False)


@query("adx", f"""{B}, {ATR}, mv AS (SELECT *, high - lag(high) OVER ({G}) AS up, lag(low) OVER ({G}) - low AS dn FROM atr), p AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM mv),
q AS (SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS mdm, CASE WHEN count(atr) {rows(14)} = 14 THEN sum(atr) {rows(14)} END AS ra FROM p),
di AS (SELECT *, 100 * sum(pdm) {rows(14)} / ra AS pdi, 100 * sum(mdm) {rows(14)} / ra AS mdi FROM q), dx AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10) AS dx FROM di)
SELECT symbol, timeframe, time, round(CASE WHEN count(dx) {rows(14)} = 14 THEN avg(dx) {rows(14)} END, 6) AS adx FROM dx""")
def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_adx(d.bars(spark, sf_dir)), "adx")


@query("efficiency_ratio", f"""{B}, c AS (SELECT *, abs(close - lag(close) OVER ({G})) AS c, abs(close - lag(close, 20) OVER ({G})) AS way FROM bars)
SELECT symbol, timeframe, time, round(way / (CASE WHEN count(c) {rows(20)} = 20 THEN sum(c) {rows(20)} END + 1e-10), 6) AS efficiency FROM c""")
def efficiency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_efficiency(d.bars(spark, sf_dir)), "efficiency")


@query("obv", f"{B}, c AS (SELECT *, coalesce(sign(close - lag(close) OVER ({G})) * volume, 0) AS c FROM bars) SELECT symbol, timeframe, time, round(sum(c) OVER ({G}), 4) AS obv FROM c")
def obv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.with_obv(d.bars(spark, sf_dir)).select(*KEY, F.round("obv", 4).alias("obv"))


@query("bollinger", f"""{B}, c AS (SELECT *, row_number() OVER ({G}) AS n, avg(close) {rows(20)} AS m, stddev_samp(close) {rows(20)} AS sd FROM bars)
SELECT symbol, timeframe, time, round(m, 6) AS bb_mid, round(m + 2 * sd, 6) AS bb_upper, round(m - 2 * sd, 6) AS bb_lower FROM c WHERE n >= 20""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_bollinger(d.bars(spark, sf_dir)).filter("bb_mid is not null"), "bb_mid", "bb_upper", "bb_lower")


@query("volatility", f"""{B}, c AS (SELECT *, close / lag(close) OVER ({G}) - 1 AS ret FROM bars)
SELECT symbol, timeframe, time, round(CASE WHEN count(ret) {rows(20)} = 20 THEN stddev_samp(ret) {rows(20)} * sqrt(252) END, 6) AS volatility FROM c""")
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_volatility(d.bars(spark, sf_dir)), "volatility")


FLAGS = "f AS (SELECT *, close > open * 1.5 AS a, volume > 1000 AS b, row_number() OVER ({g}) AS n FROM bars)"


@query("dual_flip", f"""{B}, {FLAGS.format(g=G)}, w AS (SELECT *, n - max(CASE WHEN a THEN n END) OVER ({G}) AS na, n - max(CASE WHEN b THEN n END) OVER ({G}) AS nb FROM f)
SELECT symbol, timeframe, time, coalesce((a AND nb <= 8) OR (b AND na <= 8), false) AS dual_flip FROM w""")
def dual_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = d.bars(spark, sf_dir).withColumn("a", F.expr("close > open * 1.5")).withColumn("b", F.expr("volume > 1000"))
    return out(ind.dual_flip(flagged, "a", "b", 8), "dual_flip")


@query("range_with_warm_up", f"""{B}, n AS (SELECT *, row_number() OVER ({G}) AS n FROM bars WHERE time <= TIMESTAMP '2024-01-25'), f AS (SELECT *, min(CASE WHEN time >= TIMESTAMP '2024-01-20' THEN n END) OVER (PARTITION BY symbol, timeframe) AS f FROM n)
SELECT symbol, timeframe, time, n >= f AS executing FROM f WHERE n >= f - 300""")
def range_with_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.in_range(d.bars(spark, sf_dir), "2024-01-20", "2024-01-25").select(*KEY, "executing")


@query("last_positions", f"{B}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY time DESC) AS n FROM bars) SELECT symbol, timeframe, time, close FROM n WHERE n <= 100")
def last_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.positions(d.bars(spark, sf_dir), last_n=100).select(*KEY, "close")


@query("position_span", f"{B}, n AS (SELECT *, row_number() OVER ({G}) - 1 AS n FROM bars) SELECT symbol, timeframe, time, close FROM n WHERE n >= 10 AND n < 60")
def position_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.positions(d.bars(spark, sf_dir), span=(10, 60)).select(*KEY, "close")


@query("align_timeframes", f"{B}, {d.BARS4_SQL} SELECT b.symbol, b.timeframe, b.time, b.close, h.time AS htf_time, h.close AS htf_close FROM bars b ASOF LEFT JOIN bars4 h ON b.symbol = h.symbol AND b.time >= h.time")
def align_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.align(d.bars(spark, sf_dir).select(*KEY, "close"), d.bars(spark, sf_dir, "4h"), ["close"])


def _ema_sql(x: str, n: int, name: str, source: str) -> str:
    a = 2 / (n + 1)
    return f"{name} AS (SELECT symbol, n, {x} AS v FROM {source} WHERE n = 1 UNION ALL SELECT s.symbol, s.n, {a!r}::DOUBLE * s.{x} + {1 - a!r}::DOUBLE * e.v FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.n = e.n + 1)"


NUMBERED = f"num AS (SELECT *, row_number() OVER ({G}) AS n FROM bars)"


@query("ema", f"{B}, {NUMBERED}, {_ema_sql('close', 20, 'e20', 'num')} SELECT num.symbol, timeframe, time, round(v, 6) AS ema20 FROM num JOIN e20 ON e20.symbol = num.symbol AND e20.n = num.n")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(rec.exponential(d.bars(spark, sf_dir), ema20=20), "ema20")


@query("macd", f"""{B}, {NUMBERED}, {_ema_sql('close', 12, 'e12', 'num')}, {_ema_sql('close', 26, 'e26', 'num')}, ml AS (SELECT num.*, e12.v - e26.v AS line FROM num JOIN e12 USING (symbol, n) JOIN e26 USING (symbol, n)), {_ema_sql('line', 9, 'sg', 'ml')}
SELECT ml.symbol, timeframe, time, round(line, 6) AS macd, round(v, 6) AS macd_signal, round(line - v, 6) AS macd_hist FROM ml JOIN sg ON sg.symbol = ml.symbol AND sg.n = ml.n""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(rec.macd(d.bars(spark, sf_dir)), "macd", "macd_signal", "macd_hist")


@query("wilder", state_sql.WILDER)
def wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = out(rec.wilder(d.bars(spark, sf_dir)), "wilder_rsi", "wilder_atr")
    return t.withColumn("wilder_atr", F.when(~F.isnan("wilder_atr"), F.col("wilder_atr")))


@query("trend_states", state_sql.TREND_STATES)
def trend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(rec.trend_states(d.bars_walk(spark, sf_dir)), "up", "dn", "trend", "buy", "sell", "filter", "state", "flip_buy", "flip_sell")


@query("local_times", f"{B} SELECT symbol, timeframe, time, strftime(time + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, epoch(time)::BIGINT AS seconds FROM bars")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.bars(spark, sf_dir).select(*KEY, s.local_time(F.col("time")).alias("local_time"), s.epoch_seconds(F.col("time")).alias("seconds"))


@query("tick_sizes", f"{B}, f AS (SELECT symbol, arg_min(close, time) AS first_close FROM bars GROUP BY symbol) SELECT symbol, first_close, pow(10.0::DOUBLE, -length(regexp_extract(rtrim(printf('%.8f', first_close), '0'), '\\.([0-9]*)$', 1))) AS tick_size FROM f")
def tick_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = d.bars(spark, sf_dir).groupBy("symbol").agg(F.min_by("close", "time").alias("first_close"))
    return first.withColumn("tick_size", s.tick_size(F.col("first_close")))


@query("catalogue", f"{B}, {d.BARS4_SQL}, a AS (SELECT * FROM bars UNION ALL SELECT * FROM bars4) SELECT symbol, timeframe, count(*) AS n_bars, min(time) AS first_time, max(time) AS last_time FROM a GROUP BY 1, 2")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = d.bars(spark, sf_dir).unionByName(d.bars(spark, sf_dir, "4h"))
    return both.groupBy("symbol", "timeframe").agg(F.count("*").alias("n_bars"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
