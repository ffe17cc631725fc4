"""Bars, trades, equity, runs, genomes, profiles and the leaderboard, derived from the stored tables by Spark.

Beside each table stands the same definition as a DuckDB common table expression, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import epoch_seconds, from_epoch
from tickloom.operators.metrics import by_trade, run_metrics

INITIAL = 10_000.0
#: What walking prices are added to; the last digit keeps means that lie half way between two roundings off the middle.
BASE = 100.000000001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    hours = {"1h": 1, "4h": 4}[timeframe]
    time = from_epoch(F.floor(epoch_seconds(F.col("ts").cast("timestamp_ntz")) / (3600 * hours)) * (3600 * hours))
    return ticks.groupBy("symbol", F.lit(timeframe).alias("timeframe"), time.alias("time")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.round(F.sum("value"), 6).alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """OHLCV of the event values; symbol is the event type."""
    return _bars(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), "value"), timeframe)


def bars_walk(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Smooth bars: a tick's price is 100 plus the mean of the symbol's last 50 values."""
    last = W.partitionBy("event_type").orderBy("ts").rowsBetween(-49, 0)
    ticks = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("symbol"), F.round(BASE + F.avg("value").over(last), 4).alias("price"), "value")
    return _bars(ticks, timeframe)


def _bars_sql(source: str, timeframe: str) -> str:
    seconds = {"1h": 3600, "4h": 14400}[timeframe]
    return f"""
  SELECT symbol, '{timeframe}' AS timeframe, to_timestamp(floor(epoch(ts) / {seconds}) * {seconds})::TIMESTAMP AS time, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, round(sum(value), 6) AS volume
  FROM {source} GROUP BY 1, 2, 3"""


TICKS_SQL = "ticks AS (SELECT ts::TIMESTAMP AS ts, event_type AS symbol, value AS price, value FROM events)"
WALK_TICKS_SQL = f"walk_ticks AS (SELECT ts::TIMESTAMP AS ts, event_type AS symbol, round({BASE}::DOUBLE + avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 4) AS price, value FROM events)"
BARS_SQL = f"{TICKS_SQL}, bars AS ({_bars_sql('ticks', '1h')})"
BARS4_SQL = f"bars4 AS ({_bars_sql('ticks', '4h')})"
WALK_SQL = f"{WALK_TICKS_SQL}, walk AS ({_bars_sql('walk_ticks', '1h')})"
WALK4_SQL = f"walk4 AS ({_bars_sql('walk_ticks', '4h')})"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade between every two events that follow each other of one user."""
    by_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value", F.lag("ts").over(by_user).alias("entry_time"), F.lag("value").over(by_user).alias("entry_price"), F.row_number().over(by_user).alias("n"))
    sign = F.when(F.col("event_type").isin("error", "signup"), -1).otherwise(1)
    return events.filter("entry_time is not null").select(
        F.col("user_id").cast("long").alias("run_id"), (F.col("n") - 1).alias("trade_no"), F.when(sign < 0, "Short").otherwise("Long").alias("side"), "entry_time", F.col("ts").alias("exit_time"), "entry_price", F.col("value").alias("exit_price"),
        F.lit(1.0).alias("size"), F.round(sign * (F.col("value") - F.col("entry_price")), 6).alias("pnl"), (0.0004 * F.col("entry_price")).alias("entry_fee"), (0.0004 * F.col("value")).alias("exit_fee"),
    )


TRADES_SQL = """
steps AS (
  SELECT user_id, event_type, ts::TIMESTAMP AS ts, value, lag(ts::TIMESTAMP) OVER u AS entry_time, lag(value) OVER u AS entry_price, row_number() OVER u AS n FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
trades AS (
  SELECT user_id::BIGINT AS run_id, (n - 1)::INT AS trade_no, CASE WHEN event_type IN ('error', 'signup') THEN 'Short' ELSE 'Long' END AS side, entry_time, ts AS exit_time, entry_price, value AS exit_price, 1.0::DOUBLE AS size,
    round(CASE WHEN event_type IN ('error', 'signup') THEN entry_price - value ELSE value - entry_price END, 6) AS pnl, 0.0004::DOUBLE * entry_price AS entry_fee, 0.0004::DOUBLE * value AS exit_fee
  FROM steps WHERE entry_time IS NOT NULL)"""


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity after each trade."""
    return trades(spark, sf_dir).select("run_id", F.col("trade_no").alias("idx"), F.col("exit_time").alias("time"), F.round(INITIAL + F.sum("pnl").over(by_trade()), 6).alias("equity"))


EQUITY_SQL = f"equity AS (SELECT run_id, trade_no AS idx, exit_time AS time, round({INITIAL}::DOUBLE + sum(pnl) OVER (PARTITION BY run_id ORDER BY trade_no), 6) AS equity FROM trades)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: where it ran, with which parameters, and its metrics."""
    m = run_metrics(trades(spark, sf_dir).withColumn("equity", F.round(INITIAL + F.sum("pnl").over(by_trade()), 6)), INITIAL)
    k = F.col("run_id")
    return m.select(
        "*", F.concat(F.lit("S"), (k % 5).cast("string")).alias("symbol"), F.element_at(F.array(F.lit("30m"), F.lit("1h"), F.lit("4h")), (F.floor(k / 5) % 3 + 1).cast("int")).alias("timeframe"),
        (5 + k % 4).cast("int").alias("fast"), F.lit(20).alias("slow"),
    )


METRICS_SQL = f"""
curve AS (
  SELECT *, round({INITIAL}::DOUBLE + sum(pnl) OVER (PARTITION BY run_id ORDER BY trade_no), 6) AS equity FROM trades),
peaks AS (SELECT *, greatest({INITIAL}::DOUBLE, max(equity) OVER (PARTITION BY run_id ORDER BY trade_no)) AS peak FROM curve),
metrics AS (
  SELECT run_id, {INITIAL}::DOUBLE AS initial_equity, arg_max(equity, trade_no) AS final_equity, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS win_trades, count(*) FILTER (pnl < 0) AS loss_trades,
    coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, -coalesce(sum(pnl) FILTER (pnl < 0), 0) AS gross_loss, sum(pnl) AS total_pnl, least(0, min(equity - peak)) AS max_drawdown, greatest(0, max((peak - equity) / peak * 100)) AS max_drawdown_pct
  FROM peaks GROUP BY run_id),
summary AS (
  SELECT run_id, initial_equity, final_equity, round(final_equity - initial_equity, 6) AS net_profit, round((final_equity - initial_equity) / initial_equity * 100, 6) AS net_profit_pct, total_trades, win_trades, loss_trades,
    round(win_trades / total_trades * 100, 6) AS winrate, round(CASE WHEN gross_loss > 0 THEN least(gross_profit / gross_loss, 1e6) ELSE 1e6 END, 6) AS profit_factor, round(total_pnl / total_trades, 6) AS avg_trade,
    round(CASE WHEN win_trades > 0 THEN gross_profit / win_trades ELSE 0 END, 6) AS avg_win, round(CASE WHEN loss_trades > 0 THEN -gross_loss / loss_trades ELSE 0 END, 6) AS avg_loss,
    round((gross_profit - gross_loss) / total_trades, 6) AS expectancy, round(max_drawdown, 6) AS max_drawdown, round(max_drawdown_pct, 6) AS max_drawdown_pct
  FROM metrics)"""
RUNS_SQL = """
runs AS (
  SELECT *, 'S' || (run_id % 5) AS symbol, ['30m', '1h', '4h'][(run_id // 5) % 3 + 1] AS timeframe, (5 + run_id % 4)::INT AS fast, 20 AS slow FROM summary)"""
ALL_RUNS_SQL = f"{TRADES_SQL}, {METRICS_SQL}, {RUNS_SQL}"


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter set per part, by integer arithmetic on its key, partly outside the bounds."""
    k = F.col("p_partkey")
    n = lambda m, lo, step=1.0: (F.lit(lo) + (k * (m + 3) % m) * step)
    i = lambda m, lo: (F.lit(lo) + k * 7 % m).cast("int")
    return table(spark, sf_dir, "part").select(
        k.cast("long").alias("genome_id"),
        F.struct(i(22, 1).alias("st_atrPeriod"), n(13, 0.25, 0.5).alias("st_mult"), i(190, 20).alias("rf_period"), n(23, 0.5, 0.5).alias("rf_mult"), i(29, 4).alias("rsi_length"), i(17, 2).alias("rsi_ma_length")).alias("entry"),
        F.struct(i(21, 1).alias("st_atrPeriod"), n(19, 1.0, 0.5).alias("st_mult"), i(180, 25).alias("rf_period"), n(29, 2.0, 0.5).alias("rf_mult")).alias("sl"),
        F.struct(i(20, 1).alias("st_atrPeriod"), n(11, 0.25, 0.5).alias("st_mult"), n(12, 0.25, 0.5).alias("rr_mult")).alias("tp_dual"),
        F.struct(i(20, 1).alias("st_atrPeriod"), n(11, 0.5, 0.5).alias("st_mult"), n(14, 0.25, 0.5).alias("rr_mult")).alias("tp_rsi"),
        F.struct((k % 2 == 0).alias("showDualFlip"), (k % 3 == 0).alias("showRSI")).alias("mode"), (k * 37 % 101 - 30).cast("double").alias("score"),
    )


def _n(m: int, lo: float, step: float) -> str:
    return f"({lo}::DOUBLE + (p_partkey * {m + 3} % {m}) * {step}::DOUBLE)"


def _i(m: int, lo: int) -> str:
    return f"({lo} + p_partkey * 7 % {m})::INT"


GENOMES_SQL = f"""
genomes AS (
  SELECT p_partkey::BIGINT AS genome_id,
    {{'st_atrPeriod': {_i(22, 1)}, 'st_mult': {_n(13, 0.25, 0.5)}, 'rf_period': {_i(190, 20)}, 'rf_mult': {_n(23, 0.5, 0.5)}, 'rsi_length': {_i(29, 4)}, 'rsi_ma_length': {_i(17, 2)}}} AS entry,
    {{'st_atrPeriod': {_i(21, 1)}, 'st_mult': {_n(19, 1.0, 0.5)}, 'rf_period': {_i(180, 25)}, 'rf_mult': {_n(29, 2.0, 0.5)}}} AS sl,
    {{'st_atrPeriod': {_i(20, 1)}, 'st_mult': {_n(11, 0.25, 0.5)}, 'rr_mult': {_n(12, 0.25, 0.5)}}} AS tp_dual,
    {{'st_atrPeriod': {_i(20, 1)}, 'st_mult': {_n(11, 0.5, 0.5)}, 'rr_mult': {_n(14, 0.25, 0.5)}}} AS tp_rsi,
    {{'showDualFlip': p_partkey % 2 = 0, 'showRSI': p_partkey % 3 = 0}} AS mode, (p_partkey * 37 % 101 - 30)::DOUBLE AS score
  FROM part)"""


def combined_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter set of the long and short strategy per part, partly outside the bounds."""
    k = F.col("p_partkey")
    n = lambda m, lo, step: F.lit(lo) + (k * (m + 3) % m) * step
    i = lambda m, lo: (F.lit(lo) + k * 7 % m).cast("int")
    stop = lambda a, b, c, e: F.struct(i(a, 1).alias("st_atrPeriod"), n(b, 0.5, 0.5).alias("st_mult"), i(c, 1).alias("rf_period"), n(e, 0.5, 0.5).alias("rf_mult"))
    goal = lambda a, b, c: F.struct(i(a, 1).alias("st_atrPeriod"), n(b, 0.5, 0.5).alias("st_mult"), n(c, 0.05, 0.25).alias("rr_mult"))
    entry = F.struct(i(55, 1).alias("st_atrPeriod"), n(65, 0.25, 0.5).alias("st_mult"), i(220, 1).alias("rf_period"), n(64, 0.5, 0.5).alias("rf_mult"), i(29, 4).alias("rsi_length"), i(23, 2).alias("rsi_ma_length"), i(33, 1).alias("dualFlipBarsLong"), i(31, 1).alias("dualFlipBarsShort"))
    mode = F.struct((k % 2 == 0).alias("showDualFlip"), (k % 3 == 0).alias("showRSI"), (k % 5 < 2).alias("enableLong"), (k % 7 < 4).alias("enableShort"))
    return table(spark, sf_dir, "part").select(
        k.cast("long").alias("genome_id"), entry.alias("entry"), stop(31, 62, 210, 63).alias("sl_long"), stop(32, 67, 203, 61).alias("sl_short"), goal(31, 33, 22).alias("tp_dual_long"), goal(33, 34, 23).alias("tp_dual_short"),
        goal(34, 36, 24).alias("tp_rsi_long"), goal(35, 37, 25).alias("tp_rsi_short"), mode.alias("mode"),
    )


def _stop(a: int, b: int, c: int, e: int) -> str:
    return f"{{'st_atrPeriod': {_i(a, 1)}, 'st_mult': {_n(b, 0.5, 0.5)}, 'rf_period': {_i(c, 1)}, 'rf_mult': {_n(e, 0.5, 0.5)}}}"


def _goal(a: int, b: int, c: int) -> str:
    return f"{{'st_atrPeriod': {_i(a, 1)}, 'st_mult': {_n(b, 0.5, 0.5)}, 'rr_mult': {_n(c, 0.05, 0.25)}}}"


COMBINED_SQL = f"""
combined AS (
  SELECT p_partkey::BIGINT AS genome_id,
    {{'st_atrPeriod': {_i(55, 1)}, 'st_mult': {_n(65, 0.25, 0.5)}, 'rf_period': {_i(220, 1)}, 'rf_mult': {_n(64, 0.5, 0.5)}, 'rsi_length': {_i(29, 4)}, 'rsi_ma_length': {_i(23, 2)}, 'dualFlipBarsLong': {_i(33, 1)}, 'dualFlipBarsShort': {_i(31, 1)}}} AS entry,
    {_stop(31, 62, 210, 63)} AS sl_long, {_stop(32, 67, 203, 61)} AS sl_short, {_goal(31, 33, 22)} AS tp_dual_long, {_goal(33, 34, 23)} AS tp_dual_short, {_goal(34, 36, 24)} AS tp_rsi_long, {_goal(35, 37, 25)} AS tp_rsi_short,
    {{'showDualFlip': p_partkey % 2 = 0, 'showRSI': p_partkey % 3 = 0, 'enableLong': p_partkey % 5 < 2, 'enableShort': p_partkey % 7 < 4}} AS mode
  FROM part)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 32 numbers: the first half of each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("vec"))


PROFILES_SQL = "profiles AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:32] AS vec FROM embeddings)"


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records: a genome, where it ran, how stable it was, and the market's vector then."""
    k = F.col("genome_id")
    g = genomes(spark, sf_dir).select("genome_id", "score")
    t = g.join(profiles(spark, sf_dir).withColumnRenamed("id", "genome_id"), "genome_id")
    return t.select(
        F.lit("s1").alias("strategy_hash"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("symbol"), F.element_at(F.array(F.lit("30m"), F.lit("1h"), F.lit("4h")), (F.floor(k / 5) % 3 + 1).cast("int")).alias("timeframe"),
        F.substring(F.sha2((k % 400).cast("string").cast("binary"), 256), 1, 12).alias("genome_hash"), "score", ((k * 13 % 100) / 100.0).alias("stability"), (k * 13 % 100 >= 60).alias("passed"),
        F.concat_ws(".", (k % 7).cast("string"), F.when(k % 3 == 0, (k % 4).cast("string"))).alias("source"), (1 + k % 4).cast("int").alias("test_count"), (1_700_000_000 + k * 60).alias("ts"), "vec",
    )


LEADERBOARD_SQL = f"""{PROFILES_SQL}, {GENOMES_SQL}, board AS (
  SELECT 's1' AS strategy_hash, 'S' || (genome_id % 5) AS symbol, ['30m', '1h', '4h'][(genome_id // 5) % 3 + 1] AS timeframe, substr(sha256((genome_id % 400)::VARCHAR), 1, 12) AS genome_hash, score,
    (genome_id * 13 % 100) / 100.0::DOUBLE AS stability, genome_id * 13 % 100 >= 60 AS passed, concat_ws('.', (genome_id % 7)::VARCHAR, CASE WHEN genome_id % 3 = 0 THEN (genome_id % 4)::VARCHAR END) AS source,
    (1 + genome_id % 4)::INT AS test_count, 1700000000 + genome_id * 60 AS ts, vec
  FROM genomes JOIN profiles ON id = genome_id)"""
