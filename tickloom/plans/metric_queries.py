"""Queries over trades and equity curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import metrics as m
from tickloom.plans.registry import query
from tickloom.sources import derived as d

T, E = f"WITH {d.TRADES_SQL}", f"WITH {d.TRADES_SQL}, {d.EQUITY_SQL}"
RUN = "PARTITION BY run_id ORDER BY trade_no"
SIGN = "(CASE WHEN side = 'Short' THEN -1 ELSE 1 END)"
IDX = "PARTITION BY run_id ORDER BY idx"


@query("run_metrics", f"WITH {d.TRADES_SQL}, {d.METRICS_SQL} SELECT * FROM summary")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.run_metrics(d.trades(spark, sf_dir).withColumn("equity", F.round(d.INITIAL + F.sum("pnl").over(m.by_trade()), 6)), d.INITIAL)


@query("trade_summary", f"""{T}, c AS (SELECT *, 10000.0::DOUBLE + sum(pnl) OVER ({RUN}) AS eq FROM trades), p AS (SELECT *, greatest(10000.0::DOUBLE, max(eq) OVER ({RUN})) AS peak FROM c)
SELECT run_id, count(*) AS total_trades, round(sum(pnl), 6) AS net_profit, round(sum(pnl) / 10000 * 100, 6) AS net_profit_pct, round(count(*) FILTER (pnl > 0) / count(*) * 100, 6) AS winrate,
  round(CASE WHEN -sum(pnl) FILTER (pnl <= 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl <= 0) ELSE 999 END, 6) AS profit_factor, round(greatest(0, max((peak - eq) / peak * 100)), 6) AS max_drawdown_pct
FROM p GROUP BY run_id""")
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trade_summary(d.trades(spark, sf_dir), d.INITIAL)


def _compound_sql(sign: str) -> str:
    return f"""{T}, g AS (SELECT *, CASE WHEN entry_price > 0 THEN 0.01::DOUBLE * ({sign} * (exit_price - entry_price) - 0.0004::DOUBLE * (entry_price + exit_price)) / entry_price ELSE 0 END AS growth FROM trades),
c AS (SELECT *, CASE WHEN min(CASE WHEN growth > -1 THEN 1 ELSE 0 END) OVER ({RUN}) = 1 THEN 10000::DOUBLE * exp(sum(CASE WHEN growth > -1 THEN ln(1 + growth) END) OVER ({RUN})) ELSE 0 END AS eq FROM g)"""


@query("early_stop", f"""{_compound_sql('1')}, p AS (SELECT *, greatest(10000::DOUBLE, max(eq) OVER ({RUN})) AS peak FROM c), q AS (SELECT *, (peak - eq) / peak * 100 AS dd FROM p),
s AS (SELECT *, min(CASE WHEN dd > 15 THEN trade_no END) OVER (PARTITION BY run_id) AS stop FROM q)
SELECT run_id, count(*) AS total_trades, count(*) FILTER (growth > 0) AS win_trades, round(arg_max(eq, trade_no), 6) AS final_equity, round(max(dd), 6) AS max_drawdown_pct, bool_or(stop IS NOT NULL) AS early_stopped,
  CASE WHEN bool_or(stop IS NOT NULL) THEN -999.0::DOUBLE END AS score FROM s WHERE stop IS NULL OR trade_no <= stop GROUP BY run_id""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.early_stop(d.trades(spark, sf_dir), d.INITIAL, 0.01, 0.0004, 15.0)


@query("chart_equity", f"{_compound_sql(SIGN)} SELECT run_id, trade_no, round(growth, 6) AS growth, round(eq, 6) AS compound_equity FROM c")
def chart_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = m.compounded(d.trades(spark, sf_dir), d.INITIAL, 0.01, 0.0004, side_aware=True)
    return done.select("run_id", "trade_no", m.r6(F.col("growth")).alias("growth"), m.r6(F.col("compound_equity")).alias("compound_equity"))


@query("equity_smoothness", f"""{E}, s AS (SELECT run_id, CASE WHEN lag(equity) OVER ({IDX}) > 0 THEN (equity - lag(equity) OVER ({IDX})) / lag(equity) OVER ({IDX}) END AS ret FROM equity)
SELECT run_id, round(CASE WHEN count(*) < 3 OR count(ret) = 0 THEN 0 ELSE 1 / (1 + stddev_pop(ret)) END, 6) AS smoothness FROM s GROUP BY run_id""")
def equity_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.smoothness(d.equity(spark, sf_dir))


@query("streaks", f"""{T}, i AS (SELECT run_id, sign(pnl) AS s, row_number() OVER ({RUN}) - row_number() OVER (PARTITION BY run_id, sign(pnl) ORDER BY trade_no) AS island FROM trades), l AS (SELECT run_id, s, island, count(*) AS n FROM i GROUP BY ALL)
SELECT run_id, coalesce(max(n) FILTER (s = -1), 0)::BIGINT AS max_loss_streak, coalesce(max(n) FILTER (s = 1), 0)::BIGINT AS max_win_streak FROM l GROUP BY run_id""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.streaks(d.trades(spark, sf_dir))


@query("drawdowns", f"""{E}, x AS (SELECT *, (max(equity) OVER ({IDX}) - equity) / max(equity) OVER ({IDX}) * 100 AS dd FROM equity),
i AS (SELECT run_id, dd > 0 AS s, row_number() OVER ({IDX}) - row_number() OVER (PARTITION BY run_id, dd > 0 ORDER BY idx) AS island FROM x), l AS (SELECT run_id, s, island, count(*) AS n FROM i GROUP BY ALL),
u AS (SELECT run_id, max(n) AS n FROM l WHERE s GROUP BY run_id)
SELECT x.run_id, round(max(dd), 6) AS max_drawdown_pct, round(sqrt(avg(dd * dd)), 6) AS ulcer_index, coalesce(any_value(u.n), 0)::BIGINT AS drawdown_duration FROM x LEFT JOIN u USING (run_id) GROUP BY x.run_id""")
def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.drawdowns(d.equity(spark, sf_dir))


@query("trend_fit", f"{E} SELECT run_id, round(CASE WHEN count(*) < 2 OR var_pop(equity) = 0 THEN 0 ELSE greatest(0, regr_r2(equity, idx)) END, 6) AS smoothness_r2 FROM equity GROUP BY run_id")
def trend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trend_fit(d.equity(spark, sf_dir))


@query("risk_ratios", f"""{E}, x AS (SELECT *, (equity - lag(equity) OVER ({IDX})) / lag(equity) OVER ({IDX}) - 0.02::DOUBLE / 252 AS x, (max(equity) OVER ({IDX}) - equity) / max(equity) OVER ({IDX}) * 100 AS dd FROM equity),
a AS (SELECT run_id, avg(x) AS mean, stddev_pop(x) AS dev, stddev_pop(x) FILTER (x < 0) AS down, max(dd) AS dd, arg_max(equity, idx) - 10000 AS net FROM x GROUP BY run_id)
SELECT run_id, round(CASE WHEN dev > 0 THEN mean * sqrt(252) / dev ELSE 0 END, 6) AS sharpe, round(CASE WHEN coalesce(down, 1e-10) > 0 THEN coalesce(mean * sqrt(252) / coalesce(down, 1e-10), 0) ELSE 0 END, 6) AS sortino,
  round(CASE WHEN dd > 0 THEN net / 10000 * 100 / dd ELSE greatest(0, net / 10000 * 100) END, 6) AS calmar, round(CASE WHEN dd > 0 THEN net / (dd * 10000 / 100) ELSE 0 END, 6) AS recovery FROM a""")
def risk_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.risk_ratios(d.equity(spark, sf_dir), d.INITIAL)


@query("r_multiples", f"""{T}, x AS (SELECT *, CASE WHEN trade_no % 3 = 0 THEN 5.0 END AS risk, CASE WHEN trade_no % 3 = 1 THEN entry_price * 0.98::DOUBLE END AS sl_price FROM trades)
SELECT run_id, round(coalesce(avg(CASE WHEN risk > 0 THEN pnl / risk WHEN abs(entry_price - sl_price) / entry_price > 0 THEN pnl / entry_price / (abs(entry_price - sl_price) / entry_price) END), 0), 6) AS avg_r FROM x GROUP BY run_id""")
def r_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.trades(spark, sf_dir)
    return m.r_multiples(t.withColumn("risk", F.when(F.col("trade_no") % 3 == 0, 5.0)).withColumn("sl_price", F.when(F.col("trade_no") % 3 == 1, F.col("entry_price") * 0.98)))


ERF = "(1 - (1 / (1 + 0.3275911::DOUBLE * z)) * (0.254829592::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * z)) * (-0.284496736::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * z)) * (1.421413741::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * z)) * (-1.453152027::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * z)) * 1.061405429::DOUBLE)))) * exp(-z * z))"


@query("significance", f"""{T}, a AS (SELECT run_id, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS dev FROM trades GROUP BY run_id), z AS (SELECT *, abs(mean / (dev / sqrt(n))) / sqrt(2.0::DOUBLE) AS z FROM a)
SELECT run_id, round(CASE WHEN n >= 10 AND dev > 0 THEN mean / (dev / sqrt(n)) ELSE 0 END, 6) AS t_stat, round(CASE WHEN n >= 10 AND dev > 0 THEN 1 - {ERF} ELSE 1 END, 4) AS p_value FROM z""")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.significance(d.trades(spark, sf_dir))


@query("trade_columns", f"""{T}, c AS (SELECT *, sum(pnl) OVER ({RUN}) AS cum FROM trades), p AS (SELECT *, 10000 + cum AS eq, greatest(10000, max(10000 + cum) OVER ({RUN})) AS peak FROM c)
SELECT run_id, trade_no, round(cum, 6) AS cum_pnl, round(eq, 6) AS equity, round(cum / 10000 * 100, 6) AS cum_pct, round((peak - eq) / peak * 100, 6) AS drawdown_pct, (row_number() OVER (PARTITION BY run_id ORDER BY trade_no DESC))::INT AS from_end FROM p""")
def trade_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trade_columns(d.trades(spark, sf_dir), d.INITIAL)


@query("equity_kpi", f"{E} SELECT run_id, arg_max(equity, idx) AS final_equity, max(equity) AS max_equity, min(equity) AS min_equity, round((arg_max(equity, idx) / arg_min(equity, idx) - 1) * 100, 6) AS growth_pct FROM equity GROUP BY run_id")
def equity_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.equity_kpi(d.equity(spark, sf_dir))
