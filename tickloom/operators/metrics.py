"""Reduction of trades and equity curves to performance and risk metrics, one row per run.

Everything here keys on run_id, so a table that is partitioned by run_id is shuffled once for all windows and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import divided


def by_trade() -> WindowSpec:
    return W.partitionBy("run_id").orderBy("trade_no")


def by_index() -> WindowSpec:
    return W.partitionBy("run_id").orderBy("idx")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column, otherwise: float | Column = 0.0) -> Column:
    """a / b where b is over 0."""
    return F.when(b > 0, a / b).otherwise(otherwise)


def when_sum(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def run_metrics(trades: DataFrame, initial: float) -> DataFrame:
    """trades (run_id, trade_no, pnl, equity after the trade) -> the 15 summary columns.

    The peak starts at the initial equity; a run without losses has a profit factor of 1e6, its clamp."""
    pnl, n = F.col("pnl"), F.col("total_trades")
    peak = F.greatest(F.lit(initial), F.max("equity").over(by_trade()))
    m = trades.withColumn("_gap", F.col("equity") - peak).withColumn("_peak", peak).groupBy("run_id").agg(
        F.max_by("equity", "trade_no").alias("final_equity"), F.count("*").alias("total_trades"), F.count_if(pnl > 0).alias("win_trades"), F.count_if(pnl < 0).alias("loss_trades"),
        when_sum(pnl > 0, pnl).alias("gp"), (-when_sum(pnl < 0, pnl)).alias("gl"), F.sum("pnl").alias("total"), F.least(F.lit(0.0), F.min("_gap")).alias("dd"), F.greatest(F.lit(0.0), F.max(-F.col("_gap") / F.col("_peak") * 100)).alias("dd_pct"),
    )
    gp, gl, final = F.col("gp"), F.col("gl"), F.col("final_equity")
    return m.select(
        "run_id", F.lit(initial).alias("initial_equity"), "final_equity", r6(final - initial).alias("net_profit"), r6((final - initial) / initial * 100).alias("net_profit_pct"), "total_trades", "win_trades", "loss_trades",
        r6(F.col("win_trades") / n * 100).alias("winrate"), r6(ratio(gp, gl, 1e6)).alias("_pf"), r6(F.col("total") / n).alias("avg_trade"), r6(ratio(gp, F.col("win_trades"))).alias("avg_win"), r6(ratio(-gl, F.col("loss_trades"))).alias("avg_loss"),
        r6((gp - gl) / n).alias("expectancy"), r6(F.col("dd")).alias("max_drawdown"), r6(F.col("dd_pct")).alias("max_drawdown_pct"),
    ).withColumn("profit_factor", F.least("_pf", F.lit(1e6))).drop("_pf")


def trade_summary(trades: DataFrame, initial: float) -> DataFrame:
    """Summary from trades alone: a trade of 0 counts as a loss, no loss gives a factor of 999, drawdown on summed pnl."""
    pnl = F.col("pnl")
    curve = trades.withColumn("_eq", initial + F.sum("pnl").over(by_trade())).withColumn("_peak", F.greatest(F.lit(initial), F.max("_eq").over(by_trade())))
    m = curve.groupBy("run_id").agg(F.count("*").alias("total_trades"), F.count_if(pnl > 0).alias("wins"), F.sum("pnl").alias("total"), when_sum(pnl > 0, pnl).alias("gp"), (-when_sum(pnl <= 0, pnl)).alias("gl"), F.max((F.col("_peak") - F.col("_eq")) / F.col("_peak") * 100).alias("dd"))
    return m.select("run_id", "total_trades", r6(F.col("total")).alias("net_profit"), r6(F.col("total") / initial * 100).alias("net_profit_pct"), r6(F.col("wins") / F.col("total_trades") * 100).alias("winrate"), r6(ratio(F.col("gp"), F.col("gl"), 999.0)).alias("profit_factor"), r6(F.greatest(F.lit(0.0), F.col("dd"))).alias("max_drawdown_pct"))


def compounded(trades: DataFrame, initial: float, order_pct: float, fee: float, side_aware: bool = False) -> DataFrame:
    """Equity when every trade is sized by a part of the equity it meets: the product of the growth factors.

    A trade grows equity by 1 + order_pct * ((exit - entry) - fee * (entry + exit)) / entry, with the sign of a short
    turned where side_aware. Adds growth and compound_equity; a factor that isn't over 0 ends the run at 0."""
    sign = F.when(F.col("side") == "Short", -1.0).otherwise(1.0) if side_aware else F.lit(1.0)
    entry, exit_ = F.col("entry_price"), F.col("exit_price")
    growth = F.when(entry > 0, order_pct * (sign * (exit_ - entry) - fee * (entry + exit_)) / entry).otherwise(0.0)
    t = trades.withColumn("growth", growth)
    alive = F.min(F.when(F.col("growth") > -1, 1).otherwise(0)).over(by_trade())
    return t.withColumn("compound_equity", F.when(alive == 1, initial * F.exp(F.sum(F.when(F.col("growth") > -1, F.log1p("growth"))).over(by_trade()))).otherwise(0.0))


def early_stop(trades: DataFrame, initial: float, order_pct: float, fee: float, max_dd: float, side_aware: bool = False) -> DataFrame:
    """One row per run, compounded, ended by the first drawdown over max_dd percent: such a run gets the score -999."""
    t = compounded(trades, initial, order_pct, fee, side_aware)
    peak = F.greatest(F.lit(initial), F.max("compound_equity").over(by_trade()))
    t = t.withColumn("_dd", (peak - F.col("compound_equity")) / peak * 100)
    t = t.withColumn("_stop", F.min(F.when(F.col("_dd") > max_dd, F.col("trade_no"))).over(W.partitionBy("run_id"))).filter("_stop is null or trade_no <= _stop")
    return t.groupBy("run_id").agg(F.count("*").alias("total_trades"), F.count_if(F.col("growth") > 0).alias("win_trades"), r6(F.max_by("compound_equity", "trade_no")).alias("final_equity"), r6(F.max("_dd")).alias("max_drawdown_pct"), F.max(F.col("_stop").isNotNull()).alias("early_stopped")).withColumn(
        "score", F.when(F.col("early_stopped"), -999.0)
    )


def smoothness(equity: DataFrame) -> DataFrame:
    """1 / (1 + population deviation of step returns); steps from an equity of 0 or less don't count, under 3 points 0."""
    before = F.lag("equity").over(by_index())
    steps = equity.select("run_id", F.when(before > 0, (F.col("equity") - before) / before).alias("ret"))
    return steps.groupBy("run_id").agg(r6(F.when((F.count("*") < 3) | (F.count("ret") == 0), 0.0).otherwise(1 / (1 + F.stddev_pop("ret")))).alias("smoothness"))


def longest_run(df: DataFrame, order: str, state: Column) -> DataFrame:
    """Rows with run_id, state and the length of each island of equal states."""
    whole, each = W.partitionBy("run_id").orderBy(order), W.partitionBy("run_id", "_state").orderBy(order)
    t = df.withColumn("_state", state).withColumn("_island", F.row_number().over(whole) - F.row_number().over(each))
    return t.groupBy("run_id", "_state", "_island").agg(F.count("*").alias("length"))


def streaks(trades: DataFrame) -> DataFrame:
    """Longest runs of wins and of losses; a trade of 0 ends both."""
    t = longest_run(trades, "trade_no", F.signum("pnl"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_state") == s, F.col("length"))), F.lit(0)).cast("long")
    return t.groupBy("run_id").agg(longest(-1).alias("max_loss_streak"), longest(1).alias("max_win_streak"))


def drawdowns(equity: DataFrame) -> DataFrame:
    """Deepest drawdown in percent of the peak so far, longest time under water in points, ulcer index."""
    peak = F.max("equity").over(by_index())
    t = equity.withColumn("_dd", (peak - F.col("equity")) / peak * 100)
    under = longest_run(t, "idx", F.col("_dd") > 0).filter("_state").groupBy("run_id").agg(F.max("length").alias("drawdown_duration"))
    deep = t.groupBy("run_id").agg(r6(F.max("_dd")).alias("max_drawdown_pct"), r6(F.sqrt(F.avg(F.col("_dd") * F.col("_dd")))).alias("ulcer_index"))
    return deep.join(under, "run_id", "left").withColumn("drawdown_duration", F.coalesce("drawdown_duration", F.lit(0)).cast("long"))


def trend_fit(equity: DataFrame) -> DataFrame:
    """R squared of equity on its index, 0 for a flat curve."""
    return equity.groupBy("run_id").agg(r6(F.when((F.count("*") < 2) | (F.var_pop("equity") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.regr_r2("equity", "idx")))).alias("smoothness_r2"))


def risk_ratios(equity: DataFrame, initial: float, risk_free: float = 0.02, periods: int = 252) -> DataFrame:
    """Sharpe, Sortino, Calmar and recovery of each run, with population deviations and a yearly rate."""
    before = F.lag("equity").over(by_index())
    peak = F.max("equity").over(by_index())
    t = equity.select("run_id", "idx", "equity", ((F.col("equity") - before) / before - risk_free / periods).alias("x"), ((peak - F.col("equity")) / peak * 100).alias("dd"))
    m = t.groupBy("run_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"), F.stddev_pop(F.when(F.col("x") < 0, F.col("x"))).alias("down"), F.max("dd").alias("dd"), (F.max_by("equity", "idx") - initial).alias("net"))
    pct, year = F.col("net") / initial * 100, F.sqrt(F.lit(float(periods)))
    down = F.coalesce("down", F.lit(1e-10))
    return m.select(
        "run_id", r6(F.coalesce(ratio(F.col("mean") * year, F.col("dev")), F.lit(0.0))).alias("sharpe"), r6(F.coalesce(ratio(F.col("mean") * year, down), F.lit(0.0))).alias("sortino"),
        r6(ratio(pct, F.col("dd"), F.greatest(F.lit(0.0), pct))).alias("calmar"), r6(ratio(F.col("net"), F.col("dd") * initial / 100)).alias("recovery"),
    )


def r_multiples(trades: DataFrame) -> DataFrame:
    """Mean multiple of the risk: pnl / risk, or by the distance to the stop; 0 where no trade has either. Prices of 0 are
    divided by as floating point has it, so the mean of a run with an entry and a stop at 0 is not a number."""
    entry = F.col("entry_price")
    distance = divided(F.abs(entry - F.col("sl_price")), entry)
    r = F.when(F.col("risk") > 0, F.col("pnl") / F.col("risk")).when(distance > 0, divided(divided(F.col("pnl"), entry), distance))
    return trades.groupBy("run_id").agg(r6(F.coalesce(F.avg(r), F.lit(0.0))).alias("avg_r"))


def erf(x: Column) -> Column:
    """The error function by a rational approximation (error under 1.5e-7) that needs built-in functions only."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def significance(trades: DataFrame) -> DataFrame:
    """One-sample t of pnl and its two-sided p by the normal distribution; under 10 trades or without spread (0, 1)."""
    m = trades.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("dev"))
    usable = (F.col("n") >= 10) & (F.col("dev") > 0)
    t = F.when(usable, F.col("mean") / (F.col("dev") / F.sqrt("n"))).otherwise(0.0)
    return m.select("run_id", r6(t).alias("t_stat"), F.round(F.when(usable, 1 - erf(F.abs(t) / F.sqrt(F.lit(2.0)))).otherwise(1.0), 4).alias("p_value"))


def trade_columns(trades: DataFrame, initial: float) -> DataFrame:
    """Running columns for a trade list: cumulative pnl and percent, equity, drawdown, number from the end."""
    cum = F.sum("pnl").over(by_trade())
    t = trades.withColumn("cum_pnl", cum).withColumn("equity", initial + F.col("cum_pnl"))
    peak = F.greatest(F.lit(initial), F.max("equity").over(by_trade()))
    return t.select("run_id", "trade_no", r6(F.col("cum_pnl")).alias("cum_pnl"), r6(F.col("equity")).alias("equity"), r6(F.col("cum_pnl") / initial * 100).alias("cum_pct"), r6((peak - F.col("equity")) / peak * 100).alias("drawdown_pct"), F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("trade_no"))).alias("from_end"))


def equity_kpi(equity: DataFrame) -> DataFrame:
    """Last, highest and lowest equity and growth in percent from the first point."""
    m = equity.groupBy("run_id").agg(F.max_by("equity", "idx").alias("final_equity"), F.max("equity").alias("max_equity"), F.min("equity").alias("min_equity"), F.min_by("equity", "idx").alias("first"))
    return m.select("run_id", "final_equity", "max_equity", "min_equity", r6((F.col("final_equity") / F.col("first") - 1) * 100).alias("growth_pct"))
