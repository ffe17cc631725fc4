"""Queries for looking at trades and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import recurrence as rec
from tickloom.operators import review as rv
from tickloom.plans import state_sql
from tickloom.plans.registry import query
from tickloom.sources import bars as sb
from tickloom.sources import derived as d

T, E = f"WITH {d.TRADES_SQL}", f"WITH {d.TRADES_SQL}, {d.EQUITY_SQL}"


@query("trade_markers", f"""{T} SELECT run_id, trade_no, entry_time AS time, 'entry' AS kind, side AS label, CASE side WHEN 'Short' THEN 'red' ELSE 'green' END AS colour, CASE side WHEN 'Short' THEN 'above' ELSE 'below' END AS position FROM trades
UNION ALL SELECT run_id, trade_no, exit_time, 'exit', 'Exit ' || side, CASE WHEN pnl >= 0 THEN 'green' ELSE 'red' END, CASE side WHEN 'Short' THEN 'below' ELSE 'above' END FROM trades""")
def trade_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.markers(d.trades(spark, sf_dir))


@query("trades_in_range", f"{T} SELECT run_id, trade_no, entry_time FROM trades WHERE entry_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def trades_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.in_time_range(d.trades(spark, sf_dir), "2024-01-10", "2024-01-12").select("run_id", "trade_no", "entry_time")


@query("trade_facets", f"{T} SELECT run_id, trade_no, pnl FROM trades WHERE side = 'Short' AND pnl < 0")
def trade_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.facets(d.trades(spark, sf_dir), ("Short",), wins=False).select("run_id", "trade_no", "pnl")


@query("rebased_equity", f"{E}, f AS (SELECT *, first_value(equity) OVER (PARTITION BY run_id ORDER BY idx) AS f FROM equity) SELECT run_id, idx, round((equity / f - 1) * 100, 6) AS percent, round(equity / f * 10000, 6) AS scaled FROM f")
def rebased_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.rebased(d.equity(spark, sf_dir))


@query("equity_timeline", f"""{E}, b AS (SELECT floor(epoch(min(time)) / 21600)::BIGINT * 21600 AS a, floor(epoch(max(time)) / 21600)::BIGINT * 21600 + 21600 AS z FROM equity), g AS (SELECT DISTINCT run_id, to_timestamp(unnest(range(a, z + 1, 21600)))::TIMESTAMP AS time FROM equity, b)
SELECT g.run_id, g.time, e.equity FROM g ASOF JOIN equity e ON e.run_id = g.run_id AND g.time >= e.time""")
def equity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.on_timeline(d.equity(spark, sf_dir), 6 * 3600)


@query("points_in_trades", f"{E} SELECT t.run_id, trade_no, count(*) AS points, round(max(equity), 6) AS best FROM trades t JOIN equity e ON e.run_id = t.run_id AND e.time BETWEEN t.entry_time AND t.exit_time GROUP BY 1, 2")
def points_in_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rv.points_in_trades(d.equity(spark, sf_dir), d.trades(spark, sf_dir))
    return t.groupBy("run_id", "trade_no").agg(F.count("*").alias("points"), F.round(F.max("equity"), 6).alias("best"))


@query("curve_from_trades", f"{T} SELECT run_id, trade_no, round(10000 + sum(CASE side WHEN 'Short' THEN entry_price - exit_price ELSE exit_price - entry_price END * 2 - (entry_fee + exit_fee) * 2 - 0.02::DOUBLE) OVER (PARTITION BY run_id ORDER BY exit_time, trade_no ROWS UNBOUNDED PRECEDING), 6) AS equity FROM trades")
def curve_from_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.curve_from_trades(d.trades(spark, sf_dir), 10_000.0, 2.0, (F.col("entry_fee") + F.col("exit_fee")) * 2, 0.01)


@query("flip_markers", f"""WITH {d.BARS_SQL}, e AS (SELECT symbol, timeframe, time, 'body' AS source, CASE WHEN close > open THEN 'BUY' ELSE 'SELL' END AS kind FROM bars WHERE close <> open), c AS (SELECT *, lag(kind) OVER (PARTITION BY symbol, timeframe, source ORDER BY time) AS b FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, source ORDER BY time) AS n FROM c WHERE b IS NULL OR b <> kind) SELECT symbol, timeframe, time, source, kind FROM n WHERE n > 1 OR kind = 'BUY'""")
def flip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.bars(spark, sf_dir).filter("close <> open")
    return rv.flip_markers(t.select("symbol", "timeframe", "time", F.lit("body").alias("source"), F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL").alias("kind")))


@query("trend_lines", state_sql.TREND_LINES)
def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rv.trend_lines(rec.trend_states(d.bars_walk(spark, sf_dir)))
    return t.withColumns({c: F.round(c, 6) for c in ("up_line", "down_line")})


@query("benchmark_by_place", f"""WITH {d.BARS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY time DESC) AS place FROM bars)
SELECT a.symbol, count(*) AS n, round(corr(a.close, b.close), 6) AS correlation FROM p a JOIN p b ON b.symbol = 'view' AND b.timeframe = a.timeframe AND b.place = a.place GROUP BY 1""")
def benchmark_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.bars(spark, sf_dir)
    return rv.series_from_end(t, t.filter("symbol = 'view'"), "close").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.corr("value_a", "value_b"), 6).alias("correlation"))


@query("kline_bars", """SELECT event_type AS symbol, 'tick' AS timeframe, make_timestamp(event_id * 60000000) AS time, value AS open, value + 1 AS high, value - 1 AS low, value AS close, 2.0::DOUBLE AS volume FROM (SELECT *, row_number() OVER (PARTITION BY event_type, event_id ORDER BY ts) AS n FROM events) WHERE n = 1""")
def kline_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as 12-value arrays, each twice, and read as klines."""
    e = d.table(spark, sf_dir, "events")
    ms = F.col("event_id") * 60_000
    text = [ms.cast("string"), F.col("value").cast("string"), (F.col("value") + 1).cast("string"), (F.col("value") - 1).cast("string"), F.col("value").cast("string"), F.lit("2.0"), *[F.lit("0")] * 6]
    landed = e.select(F.col("event_type").alias("symbol"), F.lit("tick").alias("timeframe"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), F.array(*text).alias("kline"))
    return sb.from_klines(landed)


@query("merged_bars", f"WITH {d.BARS_SQL} SELECT symbol, timeframe, time, open, high, low, close + 1 AS close, volume FROM bars")
def merged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raw files with the same times: the second one's rows stay."""
    t = d.bars(spark, sf_dir)
    first, second = t.withColumn("file", F.lit("a")), t.withColumn("close", F.col("close") + 1).withColumn("file", F.lit("b"))
    return sb.merged(first.unionByName(second).withColumn("row", F.lit(0)))
