"""Queries that put operators together: sampled ranges, diverse genomes, tested backtests, upgraded records, flip events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import backtest as b
from tickloom.operators import genomes as g
from tickloom.operators import leaderboard as lb
from tickloom.operators import metrics as m
from tickloom.operators import profile as pf
from tickloom.operators import recurrence as rec
from tickloom.operators import review as rv
from tickloom.operators import robustness as rb
from tickloom.plans import state_sql
from tickloom.plans.profile_queries import TAIL
from tickloom.plans.registry import query
from tickloom.plans.run_queries import GEN, LONG
from tickloom.sources import derived as d

PROMISING = f"{GEN}, {LONG}, c AS (SELECT list(score ORDER BY score DESC)[1 + (count(*) // 5)] AS cut FROM genomes), pr AS (SELECT block, param, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM long, c WHERE score >= cut GROUP BY 1, 2)"


@query("sample_promising", f"{PROMISING}, s AS (SELECT *, unnest(range(1, 51)) AS sample_id FROM pr) SELECT sample_id::INT AS sample_id, block, param, round(lo + ('0x' || substr(md5('ranges-1|' || sample_id || '|' || block || '|' || param), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * (hi - lo), 4) AS value FROM s")
def sample_promising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.sampled(g.promising_ranges(d.genomes(spark, sf_dir)), 50)


@query("widen_ranges", f"{PROMISING} SELECT block, param, round(greatest(0.5::DOUBLE, lo - greatest(1, 0.2::DOUBLE * (hi - lo))), 6) AS lo, round(hi + greatest(1, 0.2::DOUBLE * (hi - lo)), 6) AS hi FROM pr")
def widen_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.widened(g.promising_ranges(d.genomes(spark, sf_dir)))


@query("diverse_genomes")
def diverse_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.diverse(g.vector(d.genomes(spark, sf_dir)))


@query("upgrade_records", f"WITH {d.LEADERBOARD_SQL} SELECT ts, genome_hash, score AS brain_score, 0::DOUBLE AS stability, CASE WHEN ts % 2 = 0 THEN stability ELSE 20 END AS adx, 50::DOUBLE AS rsi_mean FROM board")
def upgrade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    old = d.leaderboard(spark, sf_dir).select("*", F.when(F.col("ts") % 2 == 0, F.col("stability")).alias("adx"), *[none.alias(c) for c in ("atr_pct", "volatility", "trend_ratio", "rsi_mean")])
    done = lb.upgraded(old.withColumn("genome_hash", F.concat_ws("|", "genome_hash", "ts")))
    hash_ = F.split("genome_hash", r"\|")
    return done.select(hash_[1].cast("long").alias("ts"), hash_[0].alias("genome_hash"), "brain_score", "stability", "profile.trend.adx", "profile.momentum.rsi_mean")


@query("best_for_conditions", f"""WITH {d.LEADERBOARD_SQL}, q AS (SELECT id AS query_id, vec AS qv FROM profiles WHERE id % 50 = 0), c AS (SELECT b.*, query_id, round(greatest(0, least(1, list_cosine_similarity(b.vec, qv))), 6) AS similarity FROM board b, q), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, genome_hash, ts) AS n FROM c WHERE similarity >= 0.2 AND stability >= 0),
v AS (SELECT *, round(similarity * score * (1 + 0.5::DOUBLE * stability), 6) AS value FROM f WHERE n <= 20), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, genome_hash DESC, ts DESC) AS k FROM v) SELECT query_id, genome_hash, ts, value FROM k WHERE k = 1""")
def best_for_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.best_for_conditions(d.leaderboard(spark, sf_dir), d.profiles(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 0.2)


@query("momentum_cluster", f"{TAIL}, {state_sql.MOMENTUM} SELECT * FROM momentum")
def momentum_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.momentum(pf.tail(d.bars_walk(spark, sf_dir)))


@query("flip_events", state_sql.FLIP_EVENTS)
def flip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating BUY and SELL markers of supertrend and range filter."""
    t = rec.trend_states(d.bars_walk(spark, sf_dir))
    event = lambda source, flag, kind: t.filter(flag).select("symbol", "timeframe", "time", F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.col("close").alias("price"))
    both = event("ST", "buy", "BUY").unionByName(event("ST", "sell", "SELL")).unionByName(event("RF", "flip_buy", "BUY")).unionByName(event("RF", "flip_sell", "SELL"))
    return rv.flip_markers(both)


PARAMS = ("st_mult", "rf_mult", "tp_dual_rr_mult")


def _base_runs(spark: SparkSession, bars: DataFrame) -> DataFrame:
    params = F.create_map(*[F.lit(x) for p in (("st_atrPeriod", 10.0), ("st_mult", 1.0), ("rf_period", 20.0), ("rf_mult", 1.0), ("sl_rf_period", 20.0), ("sl_rf_mult", 3.0), ("tp_dual_rr_mult", 2.0)) for x in p])
    return bars.select("symbol", "timeframe").distinct().select(F.xxhash64("symbol", "timeframe").alias("run_id"), "symbol", "timeframe", F.lit("rf_st_rsi").alias("strategy"), params.alias("params"))


def _scored(bars: DataFrame, variants: DataFrame, keep: list[str]) -> DataFrame:
    """Net profit of every variant; those without trades have 0."""
    net = b.backtest(bars, variants).groupBy("run_id").agg(F.sum("pnl").alias("score"))
    return variants.select("run_id", *keep).join(net, "run_id", "left").select(*keep, F.coalesce("score", F.lit(0.0)).alias("score"))


@query("backtest_sensitivity")
def backtest_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of all runs go through one backtest."""
    bars = d.bars_walk(spark, sf_dir)
    v = rb.variants(_base_runs(spark, bars), list(PARAMS))
    return rb.sensitivity(_scored(bars, v, ["base_id", "param", "delta"]))


@query("backtest_noise")
def backtest_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = d.bars_walk(spark, sf_dir)
    v = rb.noisy(_base_runs(spark, bars), list(PARAMS))
    return rb.noise_retention(_scored(bars, v, ["base_id", "level"]))


@query("backtest_walk_forward")
def backtest_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-sample and out-of-sample segments are series of their own in one backtest."""
    bars = rb.segments(d.bars_walk(spark, sf_dir), least=50)
    key = F.concat_ws("/", "timeframe", "window", "segment")
    cut = bars.withColumn("timeframe", key).drop("window", "segment")
    runs = _base_runs(spark, cut).withColumn("base_id", F.xxhash64("symbol", F.split("timeframe", "/")[0]))
    t = _scored(cut, runs, ["base_id", "timeframe"])
    part = F.split("timeframe", "/")
    return rb.walk_forward(t.select(F.col("base_id").alias("run_id"), part[1].cast("int").alias("window"), part[2].alias("segment"), "score"))


@query("backtest_metrics")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk figures of the base runs' own equity curves."""
    bars = d.bars_walk(spark, sf_dir)
    t = b.backtest(bars, _base_runs(spark, bars))
    curve = t.select("run_id", F.col("trade_no").alias("idx"), (10_000.0 + F.sum("pnl").over(m.by_trade())).alias("equity"))
    return m.drawdowns(curve).join(m.smoothness(curve), "run_id").join(m.streaks(t), "run_id")


@query("top_with_new", f"""WITH {d.LEADERBOARD_SQL}, r AS (SELECT genome_hash || ts AS genome_hash, score, score < 30 AS is_new FROM board), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, genome_hash) AS rank FROM r), k AS (SELECT * FROM t WHERE rank <= 10), n AS (SELECT genome_hash, score, is_new, 10 AS rank FROM r WHERE is_new AND NOT (SELECT bool_or(is_new) FROM k) ORDER BY score DESC, genome_hash LIMIT 1)
SELECT genome_hash, score, is_new, rank::INT AS rank FROM k WHERE rank NOT IN (SELECT rank FROM n) UNION ALL SELECT genome_hash, score, is_new, rank::INT FROM n""")
def top_with_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.leaderboard(spark, sf_dir).select(F.concat("genome_hash", F.col("ts").cast("string")).alias("genome_hash"), "score", (F.col("score") < 30).alias("is_new"))
    return lb.with_new(t, 10)


@query("best_timeframe", f"WITH {d.LEADERBOARD_SQL} SELECT timeframe, count(*) AS n, round(avg(score), 6) AS mean_score FROM board GROUP BY 1 HAVING count(*) >= 3 ORDER BY mean_score DESC, timeframe LIMIT 1")
def best_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.best_label(d.leaderboard(spark, sf_dir), "timeframe")
