"""Queries over the runs of a sweep and over parameter sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.operators import genomes as g
from tickloom.operators import metrics as m
from tickloom.operators import runs as r
from tickloom.plans.registry import query
from tickloom.sources import derived as d

RUNS = f"WITH {d.ALL_RUNS_SQL}"
SCORE = "round(least(profit_factor, 100) * 2 + winrate / 100 - max_drawdown_pct / 100, 4)"


@query("score_strategies", f"{RUNS} SELECT run_id, {SCORE} AS score, round(CASE WHEN net_profit > 0 THEN net_profit / greatest(max_drawdown_pct, 1) ELSE 0 END, 6) AS fast_score FROM runs")
def score_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = r.with_score(d.runs(spark, sf_dir))
    return t.select("run_id", "score", m.r6(s.fast_score(F.col("net_profit"), F.col("max_drawdown_pct"))).alias("fast_score"))


@query("filter_profitable", f"{RUNS} SELECT run_id, net_profit, total_trades FROM runs WHERE net_profit > 0 AND total_trades >= 10")
def filter_profitable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.profitable(d.runs(spark, sf_dir)).select("run_id", "net_profit", "total_trades")


@query("filter_quality", f"{RUNS} SELECT run_id, profit_factor, max_drawdown_pct FROM runs WHERE profit_factor >= 1 AND total_trades >= 30 AND max_drawdown_pct <= 40")
def filter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.quality(d.runs(spark, sf_dir)).select("run_id", "profit_factor", "max_drawdown_pct")


@query("rank_strategies", f"{RUNS} SELECT run_id, round(net_profit * 0.4::DOUBLE + profit_factor * 30 + winrate * 0.2::DOUBLE - max_drawdown_pct * 0.3::DOUBLE, 2) AS rank_score FROM runs WHERE max_drawdown_pct <= 200 AND profit_factor >= 0.9 AND total_trades >= 50")
def rank_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.ranked(d.runs(spark, sf_dir), min_trades=50).select("run_id", "rank_score")


@query("timeframe_agreement", f"{RUNS} SELECT run_id, symbol, timeframe, fast FROM (SELECT *, count(*) OVER (PARTITION BY symbol, fast, slow) AS n FROM runs WHERE net_profit > 0) WHERE n >= 2")
def timeframe_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.agreement(r.profitable(d.runs(spark, sf_dir), min_trades=0), ["fast", "slow"]).select("run_id", "symbol", "timeframe", "fast")


STABLE = "SELECT symbol, fast, slow, round(median(profit_factor), 4) AS median_pf, round(min(profit_factor), 4) AS worst_pf, round(stddev_pop(profit_factor), 4) AS pf_std, round(max(max_drawdown_pct), 4) AS worst_dd, round(median(winrate), 2) AS median_wr, count(*) AS windows FROM {source} GROUP BY 1, 2, 3"


@query("stability", f"{RUNS} {STABLE.format(source='runs')}")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.stability(d.runs(spark, sf_dir), ["fast", "slow"])


OPTIMIZED = f"""{RUNS}, good AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, fast, slow) AS n FROM runs WHERE net_profit > 0 AND total_trades >= 10) WHERE n >= 2),
stable AS (SELECT * FROM ({STABLE.format(source='good')}) WHERE median_pf >= 1.05 AND worst_pf >= 0.95 AND worst_dd <= 45 AND pf_std <= 0.6),
done AS (SELECT runs.*, {SCORE} AS score, run_id IN (SELECT run_id FROM good JOIN stable USING (symbol, fast, slow)) AS passed FROM runs)"""


@query("optimize", f"{OPTIMIZED} SELECT run_id, score, passed FROM done")
def optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.optimize(d.runs(spark, sf_dir), ["fast", "slow"]).select("run_id", "score", "passed")


@query("sweep_stats", f"{OPTIMIZED} SELECT count(*) AS total_runs, count(*) FILTER (passed) AS passed_runs, count(*) FILTER (NOT passed) AS rejected_runs FROM done")
def sweep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.sweep_stats(r.optimize(d.runs(spark, sf_dir), ["fast", "slow"]))


@query("top_runs", f"{RUNS} SELECT run_id, score, rank FROM (SELECT run_id, {SCORE} AS score, (row_number() OVER (ORDER BY {SCORE} DESC, run_id))::INT AS rank FROM runs) WHERE rank <= 5")
def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top(r.with_score(d.runs(spark, sf_dir)), "score", 5).select("run_id", "score", "rank")


MODE = "CASE WHEN run_id % 3 = 0 THEN 'ULTRA' WHEN run_id % 3 = 1 THEN 'BRAIN' ELSE 'FAST' END"


@query("mode_ranking", f"""{RUNS}, v AS (SELECT run_id, {MODE} AS mode, winrate > 52 AND run_id % 3 <> 2 AS robust, {MODE} AS md, net_profit, max_drawdown_pct, winrate FROM runs),
x AS (SELECT *, round(CASE mode WHEN 'ULTRA' THEN CASE WHEN net_profit > 0 THEN net_profit / greatest(max_drawdown_pct, 1) ELSE 0 END WHEN 'BRAIN' THEN winrate * 2 ELSE net_profit END, 6) AS ranked_by, bool_or(robust) OVER (PARTITION BY mode) AS has_robust FROM v)
SELECT run_id, mode, ranked_by FROM x WHERE robust OR NOT has_robust""")
def mode_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.runs(spark, sf_dir).withColumn("brain_score", F.col("winrate") * 2).withColumn("robust", F.expr("winrate > 52 AND run_id % 3 <> 2"))
    return r.mode_ranking(t, F.expr(MODE)).select("run_id", "mode", "ranked_by")


@query("unique_runs", f"""{RUNS}, a AS (
  SELECT run_id, {SCORE} AS score, (fast, slow, symbol)::VARCHAR AS k1, (round(net_profit, 0), total_trades)::VARCHAR AS k2 FROM runs),
kept AS (
  SELECT (0)::BIGINT AS run_id, 0::DOUBLE AS score, []::VARCHAR[] AS seen1, []::VARCHAR[] AS seen2
  UNION ALL
  SELECT arg_max(a.run_id, (a.score, -a.run_id)), arg_max(a.score, (a.score, -a.run_id)), list_append(any_value(seen1), arg_max(k1, (a.score, -a.run_id))), list_append(any_value(seen2), arg_max(k2, (a.score, -a.run_id)))
  FROM kept, a WHERE NOT list_contains(seen1, k1) AND NOT list_contains(seen2, k2) HAVING count(*) > 0)
SELECT run_id, score FROM kept WHERE len(seen1) > 0""".replace("WITH ", "WITH RECURSIVE ", 1))
def unique_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk from the best on: the statement takes the best run whose keys are both new, again and again."""
    keys = [F.col("fast"), F.col("slow"), F.col("symbol")], [F.round("net_profit", 0), F.col("total_trades")]
    return r.one_of_both(r.with_score(d.runs(spark, sf_dir)), *keys).select("run_id", "score")


@query("stratified_sample", f"""{RUNS}, c AS (SELECT timeframe, count(*) AS c FROM runs GROUP BY 1), q AS (SELECT timeframe, c, greatest(1, floor(60 * (c / sum(c) OVER ()))) AS q FROM c),
z AS (SELECT timeframe, q + CASE WHEN row_number() OVER (ORDER BY c DESC, timeframe) = 1 THEN greatest(0, 60 - sum(q) OVER ()) ELSE 0 END AS q FROM q),
n AS (SELECT run_id, timeframe, row_number() OVER (PARTITION BY timeframe ORDER BY md5('sample-1|' || run_id), run_id) AS n FROM runs)
SELECT run_id, timeframe FROM n JOIN z USING (timeframe) WHERE n <= q""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.stratified_sample(d.runs(spark, sf_dir), 60).select("run_id", "timeframe")


@query("downsample", f"""WITH {d.TRADES_SQL}, {d.EQUITY_SQL}, n AS (SELECT run_id, idx, equity, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM equity)
SELECT run_id, idx, equity FROM n WHERE n <= 20 OR i % ((n - 1) // 19 + 1) = 0 OR i = n - 1""")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.downsampled(d.equity(spark, sf_dir).select("run_id", "idx", "equity"), 20)


@query("pareto_front", f"""{RUNS}, v AS (SELECT run_id, net_profit_pct, avg_trade AS sharpe, winrate, max_drawdown_pct FROM runs)
SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.net_profit_pct >= a.net_profit_pct AND b.sharpe >= a.sharpe AND b.winrate >= a.winrate AND b.max_drawdown_pct <= a.max_drawdown_pct
  AND (b.net_profit_pct > a.net_profit_pct OR b.sharpe > a.sharpe OR b.winrate > a.winrate OR b.max_drawdown_pct < a.max_drawdown_pct))""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.pareto_front(d.runs(spark, sf_dir).select("run_id", "net_profit_pct", F.col("avg_trade").alias("sharpe"), "winrate", "max_drawdown_pct"))


def _scaled(v: str, a: float, b: float) -> str:
    return f"greatest(0, least(1, ({v} - {a}) / ({b} - {a})::DOUBLE)) * 100"


@query("brain_score", f"""{RUNS} SELECT run_id, round(0.4::DOUBLE * {_scaled('net_profit_pct', -20, 100)} + 0.3::DOUBLE * {_scaled('profit_factor', 0, 3)} + 0.2::DOUBLE * {_scaled('winrate', 30, 70)} + 0.1::DOUBLE * {_scaled('expectancy', -100, 500)}, 4) AS profitability,
  round({_scaled('max_drawdown_pct', 50, 5)}, 4) AS drawdown_score FROM runs""")
def brain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    profit = 0.4 * s.scaled(c("net_profit_pct"), -20, 100) + 0.3 * s.scaled(c("profit_factor"), 0, 3) + 0.2 * s.scaled(c("winrate"), 30, 70) + 0.1 * s.scaled(c("expectancy"), -100, 500)
    return d.runs(spark, sf_dir).select("run_id", F.round(profit, 4).alias("profitability"), F.round(s.scaled(c("max_drawdown_pct"), 50, 5), 4).alias("drawdown_score"))


@query("timeframe_minutes", f"{RUNS} SELECT timeframe, count(*) AS n, CASE WHEN regexp_matches(timeframe, '^[0-9]+[mhdw]$') THEN regexp_extract(timeframe, '^([0-9]+)', 1)::INT * CASE right(timeframe, 1) WHEN 'm' THEN 1 WHEN 'h' THEN 60 WHEN 'd' THEN 1440 ELSE 10080 END ELSE 60 END AS minutes FROM runs GROUP BY ALL")
def timeframe_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.runs(spark, sf_dir).groupBy("timeframe", s.timeframe_minutes(F.col("timeframe")).alias("minutes")).agg(F.count("*").alias("n"))


@query("parameter_grid", f"WITH {d.TICKS_SQL}, s AS (SELECT DISTINCT symbol FROM ticks) SELECT symbol, f.f AS fast, l.l AS slow FROM s, (SELECT unnest(range(5, 51, 5)) AS f) f, (SELECT unnest(range(10, 101, 10)) AS l) l WHERE f.f < l.l")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = d.bars(spark, sf_dir).select("symbol", "timeframe").distinct()
    grid = r.build_runs(series, r.ema_grid(spark, (5, 50, 5), (10, 100, 10)), [("2024-01-01", "2024-02-01")])
    return grid.select("symbol", F.col("fast").cast("long").alias("fast"), F.col("slow").cast("long").alias("slow"))


GEN = f"WITH {d.GENOMES_SQL}"
CHECKS = {
    "rf_period_vs_st_atr": "g.entry.rf_period >= g.entry.st_atrPeriod * 5", "rsi_ma_vs_rsi_length": "g.entry.rsi_ma_length <= g.entry.rsi_length", "st_mult_range": "g.entry.st_mult BETWEEN 0.5 AND 5", "rf_mult_range": "g.entry.rf_mult BETWEEN 1 AND 10",
    "sl_st_mult_vs_entry_st_mult": "g.sl.st_mult >= g.entry.st_mult", "sl_rf_mult_vs_entry_rf_mult": "g.sl.rf_mult >= g.entry.rf_mult", "tp_dual_rr_range": "g.tp_dual.rr_mult BETWEEN 0.5 AND 5", "tp_rsi_rr_range": "g.tp_rsi.rr_mult BETWEEN 0.5 AND 5",
    "at_least_one_mode": "g.mode.showDualFlip OR g.mode.showRSI", "tp_st_vs_sl_st": "g.tp_dual.st_atrPeriod <= g.sl.st_atrPeriod * 2",
}
BROKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in CHECKS.items()) + ")"


@query("validate_genomes", f"{GEN} SELECT genome_id, {BROKEN} AS violations, {BROKEN} = '' AS valid FROM genomes g")
def validate_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.validated(d.genomes(spark, sf_dir)).select("genome_id", F.array_join("violations", ",").alias("violations"), "valid")


@query("repair_genomes", f"""{GEN}, a AS (SELECT genome_id, g.entry.st_atrPeriod AS st_atrPeriod, g.entry.st_mult AS st_mult, g.entry.rf_period AS rf_period, g.entry.rf_mult AS rf_mult, g.entry.rsi_length AS rsi_length, g.entry.rsi_ma_length AS rsi_ma_length, g.sl.st_mult AS sl_st, g.sl.rf_mult AS sl_rf, g.tp_dual.rr_mult AS d_rr, g.tp_rsi.rr_mult AS r_rr, g.mode.showDualFlip AS df, g.mode.showRSI AS rs FROM genomes g)
SELECT genome_id, least(rsi_ma_length, CASE WHEN rsi_ma_length > rsi_length THEN rsi_length - 2 ELSE rsi_ma_length END) AS rsi_ma_length, CASE WHEN sl_st < st_mult THEN st_mult + 2 ELSE sl_st END AS sl_st_mult, CASE WHEN sl_rf < rf_mult THEN rf_mult + 3 ELSE sl_rf END AS sl_rf_mult,
  greatest(rf_period, st_atrPeriod * 5) AS rf_period, df OR NOT rs AS dual_flip, greatest(0.5::DOUBLE, least(5, d_rr)) AS dual_rr, greatest(0.5::DOUBLE, least(5, r_rr)) AS rsi_rr, greatest(0.5::DOUBLE, least(5, st_mult)) AS st_mult, greatest(1::DOUBLE, least(10, rf_mult)) AS rf_mult FROM a""")
def repair_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = g.repaired(d.genomes(spark, sf_dir))
    return t.select("genome_id", "entry.rsi_ma_length", F.col("sl.st_mult").alias("sl_st_mult"), F.col("sl.rf_mult").alias("sl_rf_mult"), "entry.rf_period", F.col("mode.showDualFlip").alias("dual_flip"), F.col("tp_dual.rr_mult").alias("dual_rr"), F.col("tp_rsi.rr_mult").alias("rsi_rr"), "entry.st_mult", "entry.rf_mult")


@query("clamp_genomes", f"{GEN} SELECT genome_id, greatest(1, least(20, g.entry.st_atrPeriod))::INT AS st_atr, greatest(0.5::DOUBLE, least(5, g.entry.st_mult)) AS st_mult, greatest(30, least(200, g.entry.rf_period))::INT AS rf_period, greatest(3::DOUBLE, least(15, g.sl.rf_mult)) AS sl_rf_mult, greatest(0.5::DOUBLE, least(5, g.tp_rsi.rr_mult)) AS rsi_rr FROM genomes g")
def clamp_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = g.clamped(d.genomes(spark, sf_dir))
    return t.select("genome_id", F.col("entry.st_atrPeriod").alias("st_atr"), "entry.st_mult", "entry.rf_period", F.col("sl.rf_mult").alias("sl_rf_mult"), F.col("tp_rsi.rr_mult").alias("rsi_rr"))


@query("flatten_genomes", f"{GEN} SELECT genome_id, g.entry.st_mult AS entry_st_mult, g.sl.rf_period AS sl_rf_period, g.tp_dual.rr_mult AS tp_dual_rr_mult, g.mode.showRSI AS mode_showRSI FROM genomes g")
def flatten_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = g.nested(g.flat(d.genomes(spark, sf_dir)))
    return g.flat(back).select("genome_id", "entry_st_mult", "sl_rf_period", "tp_dual_rr_mult", "mode_showRSI")


LONG = "long AS (" + " UNION ALL ".join(f"SELECT genome_id, score, '{b}' AS block, '{p}' AS param, g.{b}.{p}::DOUBLE AS value, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM genomes g" for b, p in g.NUMBERS for lo, hi in [g.BOUNDS[b][p]]) + ")"


@query("expand_bounds", f"""{GEN}, {LONG}, u AS (SELECT block, param, any_value(lo) AS lo, any_value(hi) AS hi, min(value) FILTER (score > 0) AS a, max(value) FILTER (score > 0) AS b FROM long GROUP BY 1, 2)
SELECT block, param, round(CASE WHEN a < lo THEN a - 0.1::DOUBLE * (hi - lo) ELSE lo END, 6) AS lo, round(CASE WHEN b > hi THEN b + 0.1::DOUBLE * (hi - lo) ELSE hi END, 6) AS hi FROM u""")
def expand_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.expanded_bounds(d.genomes(spark, sf_dir))


@query("promising_ranges", f"{GEN}, {LONG}, c AS (SELECT list(score ORDER BY score DESC)[1 + (count(*) // 5)] AS cut FROM genomes) SELECT block, param, round(min(value), 6) AS lo, round(max(value), 6) AS hi, count(*) AS n FROM long, c WHERE score >= cut GROUP BY 1, 2")
def promising_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.promising_ranges(d.genomes(spark, sf_dir))


VEC = "vec AS (SELECT genome_id, score, [" + ", ".join(f"(g.{b}.{p} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)" for b, p in g.NUMBERS for lo, hi in [g.BOUNDS[b][p]]) + "] AS vec FROM genomes g)"


@query("niche_fitness", f"""{GEN}, {VEC}, p AS (SELECT a.genome_id, a.score, least(1, list_distance(a.vec, b.vec) / sqrt(len(a.vec))) AS dist FROM vec a, vec b), n AS (SELECT genome_id, any_value(score) AS score, sum(CASE WHEN dist < 0.15 THEN 1 - (dist / 0.15::DOUBLE) * (dist / 0.15::DOUBLE) ELSE 0 END) AS n FROM p GROUP BY 1)
SELECT genome_id, round(n, 6) AS niche, round(score / n, 6) AS shared FROM n""")
def niche_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.niche_fitness(g.vector(d.genomes(spark, sf_dir)))


@query("crowding", f"""{GEN}, {VEC}, x AS (SELECT genome_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vec), y AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b, max(x) OVER (PARTITION BY dim) - min(x) OVER (PARTITION BY dim) AS r FROM x WINDOW w AS (PARTITION BY dim ORDER BY x, genome_id))
SELECT genome_id, CASE WHEN bool_or(a IS NULL OR b IS NULL) THEN 'Infinity'::DOUBLE ELSE round(sum((b - a) / greatest(r, 1e-12)), 6) END AS crowding FROM y GROUP BY 1""")
def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.crowding(g.vector(d.genomes(spark, sf_dir)))
