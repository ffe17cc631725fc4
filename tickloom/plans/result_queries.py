"""Queries over results: payloads, look-ups, what is stored, records as JSON, scores, quick robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.operators import leaderboard as lb
from tickloom.operators import metrics as m
from tickloom.operators import robustness as rb
from tickloom.operators import runs as r
from tickloom.plans.registry import query
from tickloom.plans.run_queries import RUNS, SCORE
from tickloom.sources import derived as d

KEPT_TRADES, KEPT_POINTS = 60, 20


@query("prune_trades", f"WITH {d.TRADES_SQL} SELECT run_id, trade_no, pnl FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY trade_no DESC) AS n FROM trades) WHERE n <= {KEPT_TRADES}")
def prune_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last trades of each run, as a result shows them."""
    return r.pruned_trades(d.trades(spark, sf_dir), KEPT_TRADES).select("run_id", "trade_no", "pnl")


@query("even_points", f"""WITH {d.TRADES_SQL}, {d.EQUITY_SQL}, n AS (SELECT run_id, idx, equity, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM equity),
k AS (SELECT DISTINCT run_id, floor(j * ((n - 1)::DOUBLE / {KEPT_POINTS - 1}))::BIGINT AS i FROM (SELECT DISTINCT run_id, n FROM n), (SELECT unnest(range({KEPT_POINTS})) AS j))
SELECT run_id, idx, equity FROM n WHERE n <= {KEPT_POINTS} OR (run_id, i) IN (SELECT (run_id, i) FROM k)""")
def even_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many evenly spaced points of each curve as a result shows."""
    return r.even_points(d.equity(spark, sf_dir).select("run_id", "idx", "equity"), KEPT_POINTS)


@query("best_run_of_parameters", f"""{RUNS}, v AS (SELECT *, {SCORE} AS score FROM runs), b AS (SELECT symbol, timeframe, fast, slow, arg_max(run_id, (score, -run_id)) AS best_run FROM v GROUP BY ALL)
SELECT run_id, best_run FROM v JOIN b USING (symbol, timeframe, fast, slow)""")
def best_run_of_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every run the best run of the same place and parameters."""
    t = r.with_score(d.runs(spark, sf_dir)).withColumn("params", F.struct("fast", "slow"))
    return r.best_runs(t, t.select("symbol", "timeframe", "params", F.col("run_id").alias("asked"))).select(F.col("asked").alias("run_id"), F.col("run_id").alias("best_run"))


RANGES = "CASE WHEN run_id % 3 = 0 THEN DATE '2023-06-01' ELSE DATE '2023-01-01' END"


@query("worth_storing", f"""{RUNS}, v AS (SELECT substr(sha256((run_id % 40)::VARCHAR), 1, 12) AS genome_hash, profit_factor, {RANGES} AS a, DATE '2023-12-15' AS b FROM runs)
SELECT genome_hash, max(profit_factor) AS profit_factor FROM v WHERE profit_factor > 0 AND date_diff('day', a, b) / 30.44::DOUBLE >= 11 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def worth_storing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best genomes by profit factor of runs over eleven months or more; a third of the runs has less."""
    start = F.when(F.col("run_id") % 3 == 0, "2023-06-01").otherwise("2023-01-01").cast("date")
    genome = s.short_hash((F.col("run_id") % 40).cast("string"))
    t = d.runs(spark, sf_dir).select(genome.alias("genome_hash"), "profit_factor", start.alias("range_from"), F.lit("2023-12-15").cast("date").alias("range_to"))
    return lb.worth_storing(t)


@query("record_json", f"""WITH {d.LEADERBOARD_SQL} SELECT ts, genome_hash, CASE WHEN ts % 7 <> 0 THEN score END AS score, CASE WHEN ts % 5 <> 0 THEN stability END AS stability, test_count FROM board""")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to JSON and back: numbers that JSON lacks come back as null."""
    t = d.leaderboard(spark, sf_dir)
    odd = F.when(F.col("ts") % 7 == 0, float("nan")).otherwise(F.col("score")).alias("score"), F.when(F.col("ts") % 5 == 0, float("inf")).otherwise(F.col("stability")).alias("stability")
    written = lb.to_record(t.select("ts", "genome_hash", *odd, "test_count"), "genome_hash", "score", "stability", "test_count").select("ts", "record")
    return lb.from_record(written, "genome_hash string, score double, stability double, test_count int").drop("record")


STREAKS = """k AS (SELECT *, pnl <= 0 AS lost, row_number() OVER (PARTITION BY run_id ORDER BY trade_no) - row_number() OVER (PARTITION BY run_id, pnl <= 0 ORDER BY trade_no) AS island FROM trades),
st AS (SELECT run_id, coalesce(max(n) FILTER (lost), 0) AS streak FROM (SELECT run_id, lost, island, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1),
ul AS (SELECT run_id, sqrt(avg(pow((peak - equity) / peak * 100, 2))) AS ulcer FROM peaks GROUP BY 1)"""


@query("legacy_score", f"{RUNS}, {STREAKS} SELECT run_id, round(least(profit_factor, 5) * winrate * 0.5::DOUBLE / (greatest(max_drawdown_pct, 1) * greatest(streak, 1) * greatest(ulcer, 0.1::DOUBLE)) * 1000, 4) AS score FROM runs JOIN st USING (run_id) JOIN ul USING (run_id)")
def legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first brain score, with a smoothness of 0.5 throughout."""
    t = d.trades(spark, sf_dir)
    streak, pain = r.loss_streaks(t), r.ulcer(t, d.INITIAL)
    both = d.runs(spark, sf_dir).join(streak, "run_id").join(pain, "run_id")
    score = s.legacy_brain_score(F.col("profit_factor"), F.col("winrate"), F.lit(0.5), F.col("max_drawdown_pct"), F.col("streak"), F.col("ulcer"))
    return both.select("run_id", F.round(score, 4).alias("score"))


@query("fee_rates", f"{RUNS} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN (run_id % 10) / 100.0::DOUBLE / 100 ELSE (run_id % 10) / 10000.0::DOUBLE END AS fee_rate FROM runs")
def fee_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees given in percent or as a share, as shares."""
    k = F.col("run_id")
    percent = k % 2 == 0
    value = F.when(percent, (k % 10) / 100.0).otherwise((k % 10) / 10000.0)
    return d.runs(spark, sf_dir).select("run_id", s.fee_rate(F.when(percent, "percent").otherwise("share"), value).alias("fee_rate"))


VARIANTS = """b AS (SELECT run_id, net_profit, [{'p': 'st_mult', 'x': net_profit * (0.5::DOUBLE + (run_id % 7) / 10.0::DOUBLE)}, {'p': 'sl_mult', 'x': net_profit * (0.6::DOUBLE + (run_id % 5) / 10.0::DOUBLE)}, {'p': 'rr_mult', 'x': net_profit - 400}] AS v FROM runs),
q AS (SELECT run_id, net_profit, u.x AS x FROM (SELECT run_id, net_profit, unnest(v) AS u FROM b)),
a AS (SELECT run_id, net_profit, avg(x / net_profit) FILTER (x > 0) AS kept FROM q GROUP BY 1, 2)"""


@query("quick_robustness", f"{RUNS}, {VARIANTS} SELECT run_id, CASE WHEN net_profit > 0 THEN round(coalesce(kept, 0), 4) ELSE 0 END AS score, coalesce(net_profit > 0 AND kept >= 0.7, false) AS passed FROM a")
def quick_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run keeps of its score when three of its parameters are a tenth higher."""
    net, k = F.col("net_profit"), F.col("run_id")
    moved = F.array(*[F.struct(F.lit(p).alias("param"), x.alias("score")) for p, x in (("st_mult", net * (0.5 + (k % 7) / 10.0)), ("sl_mult", net * (0.6 + (k % 5) / 10.0)), ("rr_mult", net - 400))])
    runs = d.runs(spark, sf_dir)
    scored = runs.select(k.alias("base_id"), F.explode(moved).alias("x")).select("base_id", "x.*").unionByName(runs.select(k.alias("base_id"), F.lit("").alias("param"), net.alias("score")))
    return rb.quick(scored).select(F.col("base_id").alias("run_id"), "score", "passed")


@query("robust_or_fragile", f"{RUNS}, {VARIANTS}, z AS (SELECT run_id, CASE WHEN net_profit > 0 THEN round(coalesce(kept, 0), 4) ELSE 0 END AS score, coalesce(net_profit > 0 AND kept >= 0.7, false) AS passed FROM a) SELECT run_id, CASE WHEN passed AND score >= 0.8 THEN 'robust' ELSE 'fragile' END AS kind FROM z")
def robust_or_fragile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.split(quick_robustness(spark, sf_dir), 0.8).select("run_id", "kind")


@query("noise_sharpe", f"""{RUNS}, z AS (SELECT run_id, net_profit * (1 + ((run_id * 31 + c * 17) % 11 - 5) / 50.0::DOUBLE * (run_id % 3)) AS x FROM runs, (SELECT unnest(range(20)) AS c)), a AS (SELECT run_id, avg(x) AS m, CASE WHEN run_id % 3 = 0 THEN 0 ELSE stddev_pop(x) END AS s FROM z GROUP BY 1)
SELECT run_id, round(m, 6) AS mean, round(s, 6) AS std, CASE WHEN s = 0 THEN CASE WHEN m > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE round(m / s, 6) END AS sharpe FROM a""")
def noise_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and Sharpe ratio of twenty noisy scores of each run."""
    c, k = F.explode(F.sequence(F.lit(0), F.lit(19))), F.col("run_id")
    t = d.runs(spark, sf_dir).select("run_id", "net_profit", c.alias("c"))
    noise = ((k * 31 + F.col("c") * 17) % 11 - 5) / 50.0 * (k % 3)
    return rb.score_sharpe(t.select("run_id", (F.col("net_profit") * (1 + noise)).alias("score")))


BRAIN = {
    "profitability": [(0.4, "net_profit_pct", -20, 100), (0.3, "profit_factor", 0, 3), (0.2, "winrate", 30, 70), (0.1, "expectancy", -100, 500)],
    "risk": [(0.4, "max_drawdown_pct", 50, 5), (0.3, "sharpe", -1, 3), (0.2, "ulcer", 20, 1), (0.1, "recovery", 0, 5)],
    "consistency": [(0.5, "smoothness", 0, 1), (0.3, "streak", 10, 2), (0.2, "sortino", -1, 4)],
    "significance": [(0.6, "p_value", 0.5, 0.01), (0.4, "t_abs", 0, 3)],
}
#: Stands in for the figures that come from other operators, so that the score itself is what the statement holds.
STAND_INS = {"sharpe": "(run_id % 9) / 2.0 - 1", "recovery": "(run_id % 6) * 1.0", "smoothness": "(run_id % 11) / 10.0", "sortino": "(run_id % 13) / 3.0 - 1", "p_value": "(run_id % 50) / 100.0", "t_abs": "(run_id % 7) / 2.0"}
TERM = "{w}::DOUBLE * greatest(0, least(1, ({v} - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE))) * 100"
PARTS = ", ".join(f"{' + '.join(TERM.format(w=w, v=v, a=a, b=b) for w, v, a, b in terms)} AS {name}" for name, terms in BRAIN.items())


@query("brain_score_parts", f"""{RUNS}, {STREAKS}, v AS (SELECT runs.*, streak, ulcer, {', '.join(f'({e.replace(".0", ".0::DOUBLE")})::DOUBLE AS {c}' for c, e in STAND_INS.items())} FROM runs JOIN st USING (run_id) JOIN ul USING (run_id)),
p AS (SELECT run_id, {PARTS} FROM v) SELECT run_id, round(profitability, 4) AS profitability, round(risk, 4) AS risk, round(consistency, 4) AS consistency, round(significance, 4) AS significance,
  round(0.4::DOUBLE * profitability + 0.3::DOUBLE * risk + 0.2::DOUBLE * consistency + 0.1::DOUBLE * significance, 4) AS brain_score FROM p""")
def brain_score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brain score with all four components and their weighted sum."""
    t = d.trades(spark, sf_dir)
    runs = d.runs(spark, sf_dir).join(r.loss_streaks(t), "run_id").join(r.ulcer(t, d.INITIAL), "run_id")
    return s.brain_score(runs.select("*", *[F.expr(f"cast({e} as double)").alias(c) for c, e in STAND_INS.items()]), BRAIN).select("run_id", *BRAIN, "brain_score")
