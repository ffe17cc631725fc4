"""Queries that run strategies over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import backtest as b
from tickloom.operators import metrics as m
from tickloom.plans.registry import query
from tickloom.sources import derived as d

PAIRS = [(f, s) for f in (5, 8, 12) for s in (20, 30)]
SPANS = sorted({n for p in PAIRS for n in p})
KEY = "symbol, timeframe, fast, slow"

CROSS_SQL = f"""WITH RECURSIVE {d.WALK_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY time) AS n, count(*) OVER (PARTITION BY symbol, timeframe) AS last FROM walk),
spans AS (SELECT unnest({SPANS}) AS span), e AS (SELECT symbol, span, n, close AS v FROM num, spans WHERE n = 1 UNION ALL SELECT s.symbol, e.span, s.n, 2.0::DOUBLE / (e.span + 1) * s.close + (1 - 2.0::DOUBLE / (e.span + 1)) * e.v FROM e JOIN num s ON s.symbol = e.symbol AND s.n = e.n + 1),
pairs AS (SELECT unnest({[p[0] for p in PAIRS]}) AS fast, unnest({[p[1] for p in PAIRS]}) AS slow),
x AS (SELECT num.symbol, num.timeframe, fast, slow, num.n, num.last, time, open, close, f.v AS f, s.v AS s FROM num JOIN pairs ON true JOIN e f ON f.symbol = num.symbol AND f.n = num.n AND f.span = fast JOIN e s ON s.symbol = num.symbol AND s.n = num.n AND s.span = slow),
y AS (SELECT *, lag(f <= s) OVER w AS was_below, lag(f >= s) OVER w AS was_above FROM x WINDOW w AS (PARTITION BY {KEY} ORDER BY n)),
z AS (SELECT *, coalesce(lag(was_below AND f > s) OVER w, false) AS enter, coalesce(was_above AND f < s, false) AS leave FROM y WINDOW w AS (PARTITION BY {KEY} ORDER BY n)),
ev AS (SELECT {KEY}, n, time, 1 AS kind, open AS price FROM z WHERE enter UNION ALL SELECT {KEY}, n, time, -1, close FROM z WHERE leave UNION ALL SELECT {KEY}, n, time, 0, close FROM z WHERE n = last),
o AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY n, kind DESC) AS o FROM ev),
en AS (SELECT a.{KEY.replace(', ', ', a.')}, a.n, a.time, a.price, (SELECT min((x.n, x.time, x.price)) FROM o x WHERE x.symbol = a.symbol AND x.fast = a.fast AND x.slow = a.slow AND x.kind <= 0 AND x.o > a.o) AS ex FROM o a WHERE a.kind = 1),
fe AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, ex[1] ORDER BY n) AS k FROM en WHERE ex IS NOT NULL),
ct AS (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY n) AS trade_no, time AS entry_time, ex[2] AS exit_time, price AS entry_price, ex[3] AS exit_price, (ex[3] - price) * (1000.0::DOUBLE / price) - 0.0004::DOUBLE * ex[3] * (1000.0::DOUBLE / price) AS pnl FROM fe WHERE k = 1)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.cross_trades(b.cross_events(d.bars_walk(spark, sf_dir), PAIRS))


@query("ema_cross_trades", f"{CROSS_SQL} SELECT {KEY}, trade_no::INT AS trade_no, entry_time, exit_time, entry_price, exit_price, round(pnl, 6) AS pnl FROM ct")
def ema_cross_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir).select("symbol", "timeframe", "fast", "slow", "trade_no", "entry_time", "exit_time", "entry_price", "exit_price", m.r6(F.col("pnl")).alias("pnl"))


@query("optimize_ema", f"""{CROSS_SQL}, s AS (SELECT {KEY}, count(*) AS total_trades, sum(pnl) AS net, count(*) FILTER (pnl > 0) AS wins FROM ct GROUP BY ALL)
SELECT symbol, fast, slow, total_trades, round(net, 4) AS net_profit, round(wins / total_trades * 100, 4) AS winrate FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(net, 4) DESC, fast, slow) AS k FROM s WHERE total_trades >= 5) WHERE k <= 5""")
def optimize_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of exponential means do best on each symbol?"""
    from pyspark.sql import Window as W

    s = _trades(spark, sf_dir).groupBy("symbol", "timeframe", "fast", "slow").agg(F.count("*").alias("total_trades"), F.round(F.sum("pnl"), 4).alias("net_profit"), F.round(F.count_if(F.col("pnl") > 0) / F.count("*") * 100, 4).alias("winrate"))
    best = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("net_profit"), "fast", "slow"))
    return s.filter("total_trades >= 5").withColumn("k", best).filter("k <= 5").select("symbol", "fast", "slow", "total_trades", "net_profit", "winrate")


def _sweep(bars: DataFrame, strategy: str, sets: DataFrame) -> DataFrame:
    """Every parameter set (id and its parameters) on every series; sets is as long as the sweep, not the data."""
    names = [c for c in sets.columns if c != "id"]
    params = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    series = bars.select("symbol", "timeframe").distinct().crossJoin(F.broadcast(sets))
    run_id = F.xxhash64("id", "symbol", "timeframe").alias("run_id")
    return series.select(run_id, "symbol", "timeframe", F.lit(strategy).alias("strategy"), params.alias("params"))


@query("strategy_backtest")
def strategy_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 runs (100 parameter sets on 5 symbols) of the long strategy folded, one row of summary each."""
    bars = d.bars_walk(spark, sf_dir)
    k = F.col("id")
    sets = spark.range(100).select(
        (2 + k % 5).alias("st_atrPeriod"), (0.5 + (k % 10) * 0.25).alias("st_mult"), (10 + k % 20).alias("rf_period"), (0.5 + (k % 7) * 0.5).alias("rf_mult"),
        (10 + k % 3 * 10).alias("sl_rf_period"), (1 + k % 4).alias("sl_rf_mult"), (1 + (k % 4) * 0.5).alias("tp_dual_rr_mult"), "id",
    )
    t = b.backtest(bars, _sweep(bars, "rf_st_rsi", sets))
    t = t.withColumn("equity", 10_000.0 + F.sum("pnl").over(m.by_trade()))
    return m.run_metrics(t, 10_000.0)


@query("combined_backtest")
def combined_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the long and short strategy with orders of fixed cash, slippage and two positions a side."""
    bars = d.bars_walk(spark, sf_dir)
    k = F.col("id")
    sets = spark.range(20).select(
        (3 + k % 5).alias("st_atrPeriod"), (0.5 + (k % 4) * 0.5).alias("st_mult"), (10 + k % 10).alias("rf_period"), (0.5 + (k % 3) * 0.5).alias("rf_mult"),
        (10 + k % 4).alias("rf_sl_period_L"), (2 + k % 3).alias("rf_sl_mult_L"), (0.5 + k % 2).alias("rr_mult_dual_L"), "id",
    )
    t = b.backtest(bars, _sweep(bars, "rf_st_rsi_combined", sets), b.Orders(order="cash", value=500.0, slip=0.01, pyramiding=2))
    digits = [m.r6(F.col(c)).alias(c) for c in ("entry_price", "exit_price", "size", "pnl")]
    return t.select("run_id", "trade_no", "side", "entry_type", "entry_bar", "exit_bar", *digits, "exit_reason")
