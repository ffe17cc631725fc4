"""Queries that stress runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import robustness as rb
from tickloom.plans.registry import query
from tickloom.sources import derived as d

T = f"WITH {d.TRADES_SQL}"
JUDGED = """SELECT run_id, round(CASE WHEN n >= 10 THEN mean ELSE 0 END, 8) AS mean_profit, round(CASE WHEN n >= 10 THEN std ELSE 0 END, 6) AS std_profit, round(CASE WHEN n >= 10 THEN var ELSE 0 END, 6) AS var_95, round(CASE WHEN n >= 10 THEN prob ELSE 0 END, 6) AS profit_probability,
  round(CASE WHEN n >= 10 THEN prob * 0.4::DOUBLE + greatest(0, 1 - std / 50) * 0.3::DOUBLE + greatest(0, (var + 50) / 100) * 0.3::DOUBLE ELSE 0 END, 6) AS score, n >= 10 AND prob >= 0.6 AND var > -30 AS passed FROM a"""
BOOT = """p AS (SELECT run_id, list(pnl ORDER BY trade_no) AS p, count(*) AS n FROM trades GROUP BY 1), s AS (SELECT run_id, p, n, unnest(range(1, 201)) AS sim FROM p),
k AS (SELECT run_id, sim, n, p, unnest(range(1, n + 1)) AS k FROM s), o AS (SELECT run_id, sim, any_value(n) AS n, round(sum(p[(sim * 7919 + k * 104729 + sim * k * 31) % n + 1]) / 10000 * 100, 6) AS pct FROM k GROUP BY 1, 2),
a AS (SELECT run_id, any_value(n) AS n, avg(pct) AS mean, stddev_pop(pct) AS std, quantile_cont(pct, 0.05) AS var, avg((pct > 0)::INT) AS prob FROM o GROUP BY 1)"""


@query("bootstrap", f"{T}, {BOOT} {JUDGED}")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.bootstrap(d.trades(spark, sf_dir), 200)


@query("order_shuffle", f"{T}, a AS (SELECT run_id, count(*) AS n, sum(pnl) / 10000 * 100 AS mean, 0::DOUBLE AS std, sum(pnl) / 10000 * 100 AS var, CASE WHEN sum(pnl) > 0 THEN 1 ELSE 0 END::DOUBLE AS prob FROM trades GROUP BY 1) {JUDGED}")
def order_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.order_shuffle(d.trades(spark, sf_dir))


SLIP = """c AS (SELECT run_id, count(*) AS n, sum(pnl) AS base, sum(CASE WHEN entry_price > 0 THEN entry_price * size * 2 ELSE abs(pnl) * 2 END) AS cost FROM trades GROUP BY 1),
kk AS (SELECT run_id, n, base / 10000 * 100 AS pct, [CASE WHEN base > 0 THEN round((base - x * cost) / 10000 * 100 / greatest(base / 10000 * 100, 0.01) * 100, 2) ELSE 0 END FOR x IN [0.001::DOUBLE, 0.002::DOUBLE, 0.005::DOUBLE, 0.01::DOUBLE]] AS k FROM c),
sl AS (SELECT run_id, round(pct, 4) AS base_profit_pct, k[1] AS kept_1, k[2] AS kept_2, k[3] AS kept_3, k[4] AS kept_4, CASE WHEN n >= 5 THEN round((greatest(0, k[1] / 100) + greatest(0, k[2] / 100) + greatest(0, k[3] / 100) + greatest(0, k[4] / 100)) / 4, 6) ELSE 0 END AS score, n >= 5 AND k[2] > 50 AS passed FROM kk)"""


@query("slippage_stress", f"{T}, {SLIP} SELECT * FROM sl")
def slippage_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.slippage(d.trades(spark, sf_dir))


@query("walk_forward_segments", f"""WITH {d.BARS_SQL}, n AS (SELECT symbol, timeframe, time, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY symbol, timeframe) // 3 AS size FROM bars)
SELECT symbol, timeframe, time, (i // size)::INT AS "window", CASE WHEN i - (i // size) * size < floor(size * 0.7::DOUBLE) THEN 'IS' ELSE 'OOS' END AS segment FROM n WHERE size >= 100 AND i // size < 3""")
def walk_forward_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.segments(d.bars(spark, sf_dir)).select("symbol", "timeframe", "time", "window", "segment")


WF = """ws AS (SELECT run_id, trade_no, pnl, (row_number() OVER (PARTITION BY run_id ORDER BY trade_no) - 1) * 6 // count(*) OVER (PARTITION BY run_id) AS part FROM trades),
w AS (SELECT run_id, part // 2 AS win, sum(pnl) FILTER (part % 2 = 0) AS i, sum(pnl) FILTER (part % 2 = 1) AS o FROM ws GROUP BY 1, 2),
g AS (SELECT run_id, count(*) AS windows, avg((o > 0)::INT) AS consistency, CASE WHEN count(*) > 2 AND isfinite(corr(i, o)) THEN corr(i, o) ELSE 0 END AS correlation, CASE WHEN avg(i) > 0 THEN (avg(i) - avg(o)) / avg(i) ELSE 0 END AS degradation FROM w WHERE i IS NOT NULL AND o IS NOT NULL GROUP BY 1),
wf AS (SELECT *, consistency * 0.5::DOUBLE + greatest(0, correlation) * 0.2::DOUBLE + greatest(0, 1 - greatest(0, degradation)) * 0.3::DOUBLE AS score FROM g)"""


def _window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    run = W.partitionBy("run_id")
    part = F.floor((F.row_number().over(run.orderBy("trade_no")) - 1) * 6 / F.count("*").over(run))
    t = d.trades(spark, sf_dir).withColumn("part", part)
    return t.groupBy("run_id", F.floor(F.col("part") / 2).alias("window"), F.when(F.col("part") % 2 == 0, "IS").otherwise("OOS").alias("segment")).agg(F.sum("pnl").alias("score"))


@query("walk_forward", f"{T}, {WF} SELECT run_id, windows, round(consistency, 4) AS consistency, round(correlation, 4) AS correlation, round(degradation, 4) AS degradation, round(score, 4) AS score, score >= 0.5 AS passed FROM wf")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.walk_forward(_window_scores(spark, sf_dir))


@query("comprehensive_robustness", f"""{T}, {BOOT}, mc AS ({JUDGED}), {SLIP}, {WF}
SELECT run_id, round(0.3::DOUBLE * coalesce(round(wf.score, 4), 0.5) + 0.3::DOUBLE * coalesce(mc.score, 0.5) + 0.2::DOUBLE * 0.5 + 0.1::DOUBLE * coalesce(sl.score, 0.5) + 0.1::DOUBLE * 0.5, 6) AS stability,
  round(0.3::DOUBLE * coalesce(round(wf.score, 4), 0.5) + 0.3::DOUBLE * coalesce(mc.score, 0.5) + 0.2::DOUBLE * 0.5 + 0.1::DOUBLE * coalesce(sl.score, 0.5) + 0.1::DOUBLE * 0.5, 6) >= 0.6 AS passed
FROM mc LEFT JOIN wf USING (run_id) LEFT JOIN sl USING (run_id)""")
def comprehensive_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.trades(spark, sf_dir)
    parts = {"walk_forward": rb.walk_forward(_window_scores(spark, sf_dir)), "monte_carlo": rb.bootstrap(t, 200), "slippage": rb.slippage(t)}
    return rb.comprehensive(t.select("run_id").distinct(), parts)


SCORED = """v AS (SELECT unnest(['', 'a', 'a', 'b', 'b', 'c', 'c']) AS param, unnest([0, -0.1, 0.1, -0.1, 0.1, -0.1, 0.1]::DOUBLE[]) AS delta),
b AS (SELECT run_id AS base_id, sum(pnl) AS s, count(*) AS n FROM trades GROUP BY 1),
sc AS (SELECT base_id, param, delta, s * (1 + delta * ((base_id + ascii(param || ' ')) % 7)::DOUBLE) AS score FROM b, v)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = d.trades(spark, sf_dir).groupBy("run_id").agg(F.sum("pnl").alias("s"))
    runs = b.select("run_id", "s", F.create_map(*[x for c in "abc" for x in (F.lit(c), F.lit(1.0))]).alias("params"))
    t = rb.variants(runs, ["a", "b", "c"])
    weight = ((F.col("base_id") + F.ascii(F.concat("param", F.lit(" ")))) % 7).cast("double")
    return t.select("base_id", "param", "delta", (F.col("s") * (1 + F.col("delta") * weight)).alias("score"))


@query("parameter_sensitivity", f"""{T}, {SCORED}, j AS (SELECT s.base_id, s.param, abs(s.score - b.score) / greatest(abs(b.score), 1e-9) AS ch FROM sc s JOIN sc b ON b.base_id = s.base_id AND b.param = '' WHERE s.param <> ''),
p AS (SELECT base_id, param, greatest(0, 1 - avg(ch)) AS s FROM j GROUP BY 1, 2)
SELECT base_id, round(avg(s), 4) AS stability, round(avg(s), 4) >= 0.6 AS passed FROM p GROUP BY 1""")
def parameter_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.sensitivity(_scored(spark, sf_dir)).select("base_id", "stability", "passed")


@query("perturbation", f"""{T}, {SCORED}, j AS (SELECT s.base_id, CASE WHEN b.score > 0 THEN greatest(0, s.score / b.score) ELSE 0 END AS kept FROM sc s JOIN sc b ON b.base_id = s.base_id AND b.param = '' WHERE s.param <> ''), a AS (SELECT base_id, min(kept) AS worst, avg(kept) AS mean FROM j GROUP BY 1)
SELECT base_id, round(worst, 4) AS worst, round(mean, 4) AS mean, round(worst * 0.7::DOUBLE + mean * 0.3::DOUBLE, 4) AS stability, worst >= 0.5 AS passed FROM a""")
def perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rb.perturbation(_scored(spark, sf_dir))
