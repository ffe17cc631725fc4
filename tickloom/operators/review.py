"""Tables for looking at results: markers, rebased and aligned curves, flips, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import epoch_seconds, from_epoch

def markers(trades: DataFrame) -> DataFrame:
    """Two rows per trade: its entry and its exit, with label, colour and position."""
    short = F.col("side") == "Short"
    win = F.col("pnl") >= 0
    entry = F.struct(F.col("entry_time").alias("time"), F.lit("entry").alias("kind"), F.col("side").alias("label"), F.when(short, "red").otherwise("green").alias("colour"), F.when(short, "above").otherwise("below").alias("position"))
    leave = F.struct(F.col("exit_time").alias("time"), F.lit("exit").alias("kind"), F.concat(F.lit("Exit "), F.col("side")).alias("label"), F.when(win, "green").otherwise("red").alias("colour"), F.when(short, "below").otherwise("above").alias("position"))
    return trades.select("run_id", "trade_no", F.explode(F.array(entry, leave)).alias("m")).select("run_id", "trade_no", "m.*")


def in_time_range(trades: DataFrame, start: str, end: str) -> DataFrame:
    """Trades that begin in the range, both ends included; null entries go."""
    return trades.filter(F.col("entry_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def facets(trades: DataFrame, sides: tuple[str, ...] = ("Long", "Short"), wins: bool = True, losses: bool = True) -> DataFrame:
    won = F.col("pnl") >= 0
    return trades.filter(F.col("side").isin(*sides) & ((won & F.lit(wins)) | (~won & F.lit(losses))))


def trend_lines(states: DataFrame) -> DataFrame:
    """The supertrend as two lines: up where the trend is 1, down where it is -1."""
    return states.select("symbol", "timeframe", "time", F.when(F.col("trend") == 1, F.col("up")).alias("up_line"), F.when(F.col("trend") == -1, F.col("dn")).alias("down_line"))


def rebased(equity: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Percent from a curve's first point, and the curve scaled so that it begins at capital."""
    first = F.first("equity").over(W.partitionBy("run_id").orderBy("idx"))
    return equity.select("run_id", "idx", F.round((F.col("equity") / first - 1) * 100, 6).alias("percent"), F.round(F.col("equity") / first * capital, 6).alias("scaled"))


def on_timeline(equity: DataFrame, step: int, max_points: int = 5000) -> DataFrame:
    """Curves on one common timeline of `step` seconds (more where there would be over max_points): at each point the last
    value so far, none before a curve begins. One sort per curve, no range join."""
    ends = equity.agg(F.min(epoch_seconds(F.col("time"))).alias("a"), F.max(epoch_seconds(F.col("time"))).alias("b")).first()
    if ends["a"] is None:
        return equity.select("run_id", "time", "equity")
    step = max(step, -(-(ends["b"] - ends["a"]) // (max_points - 1)))
    begin = ends["a"] // step * step
    grid = equity.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(begin), F.lit(ends["b"] // step * step + step), F.lit(step))).alias("_s"))
    points = grid.select("run_id", from_epoch(F.col("_s")).alias("time"), F.lit(None).cast("double").alias("equity"), F.lit(1).alias("_grid"))
    both = equity.select("run_id", "time", "equity", F.lit(0).alias("_grid")).unionByName(points)
    seen = F.last("equity", ignorenulls=True).over(W.partitionBy("run_id").orderBy("time", "_grid").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("equity", seen).filter("_grid = 1 and equity is not null").select("run_id", "time", "equity")


def points_in_trades(equity: DataFrame, trades: DataFrame) -> DataFrame:
    """Interval join: the equity points inside each trade. Equal run first, then the range."""
    e = equity.select(F.col("run_id"), F.col("time").alias("point_time"), "equity")
    return trades.select("run_id", "trade_no", "entry_time", "exit_time").join(e, "run_id").filter(F.col("point_time").between(F.col("entry_time"), F.col("exit_time")))


def flip_markers(events: DataFrame) -> DataFrame:
    """events (symbol, timeframe, time, source, kind BUY or SELL) -> those that alternate per source, beginning with BUY."""
    by = W.partitionBy("symbol", "timeframe", "source").orderBy("time")
    t = events.withColumn("_before", F.lag("kind").over(by)).filter("_before is null or _before <> kind").drop("_before")
    return t.withColumn("_n", F.row_number().over(by)).filter("_n > 1 or kind = 'BUY'").drop("_n")


def curve_from_trades(trades: DataFrame, initial: float, qty: float, commission: Column, slippage: float = 0.0) -> DataFrame:
    """Equity after each trade of a fixed quantity: pnl per unit times qty, less commission and slippage."""
    sign = F.when(F.col("side") == "Short", -1.0).otherwise(1.0)
    net = sign * (F.col("exit_price") - F.col("entry_price")) * qty - commission - slippage * qty
    order = W.partitionBy("run_id").orderBy("exit_time", "trade_no").rowsBetween(W.unboundedPreceding, 0)
    return trades.select("run_id", "trade_no", F.round(initial + F.sum(net).over(order), 6).alias("equity"))


def series_from_end(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two series joined by their place from the end: (place, value_a, value_b)."""
    place = F.row_number().over(W.partitionBy("symbol", "timeframe").orderBy(F.desc("time")))
    left = a.withColumn("place", place).select("symbol", "timeframe", "place", F.col(value).alias("value_a"))
    right = b.withColumn("place", place).select(F.col("symbol").alias("benchmark"), "timeframe", "place", F.col(value).alias("value_b"))
    return left.join(right, ["timeframe", "place"])
