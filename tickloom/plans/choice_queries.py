"""Queries that choose: seeds, merges with a selection, bounds by the best share, and whether two executions agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import genomes as g
from tickloom.operators import leaderboard as lb
from tickloom.operators import recurrence as rec
from tickloom.operators import runs as r
from tickloom.plans.backtest_queries import ema_cross_trades
from tickloom.plans.bar_queries import B, out
from tickloom.plans.leaderboard_queries import SIM, L
from tickloom.plans.registry import REGISTERED, query
from tickloom.plans.run_queries import GEN, LONG
from tickloom.sources import derived as d


@query("seed_genomes", f"""{L}, {SIM}, top AS ({REGISTERED['all_top_genomes'][1]}),
u AS (SELECT genome_hash, score, ts, 0 AS kind FROM top UNION ALL SELECT genome_hash, score, ts, 1 FROM g WHERE rank <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY genome_hash ORDER BY kind, score DESC, ts) AS n FROM u)
SELECT genome_hash, score, ts, kind = 1 AS similar FROM n WHERE n = 1""")
def seed_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all keys, and the genomes of records like the asked profiles that are not among them."""
    board = d.leaderboard(spark, sf_dir)
    asked = d.profiles(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return lb.seeds(lb.top_overall(board, 10, 50), lb.similar(board, asked, 20, 0.2, 0.3))


MERGED = "b AS (SELECT coalesce(max(score), 0) AS best FROM s), i AS (SELECT n.* FROM n, b WHERE score > best)"
RESULT = """SELECT genome_hash, ts, score, source, 'IMPROVED' AS status FROM i
UNION ALL SELECT genome_hash, ts, score, concat_ws('.', CASE WHEN source <> '' THEN source END, '14'), 'NO_IMPROVEMENT' FROM s WHERE NOT EXISTS (SELECT 1 FROM i)"""


def _merged(spark: SparkSession, sf_dir: str, new: str, selected: str) -> DataFrame:
    t = d.leaderboard(spark, sf_dir).select("genome_hash", "ts", "score", "source", "passed", "symbol")
    return lb.merged_with_selection(t.filter(new), t.filter(selected), 14).select("genome_hash", "ts", "score", "source", "status")


@query("merge_selection", f"{L}, n AS (SELECT * FROM board WHERE passed), s AS (SELECT * FROM board WHERE symbol = 'S1' AND score < 50), {MERGED} {RESULT}")
def merge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New results that are better than all of a selection."""
    return _merged(spark, sf_dir, "passed", "symbol = 'S1' and score < 50")


@query("keep_selection", f"{L}, n AS (SELECT * FROM board WHERE score < 20), s AS (SELECT * FROM board WHERE symbol = 'S1' AND score > 20), {MERGED} {RESULT}")
def keep_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No new result is better: the selection stays, with this run in its source."""
    return _merged(spark, sf_dir, "score < 20", "symbol = 'S1' and score > 20")


@query("expand_bounds_share", f"""{GEN}, {LONG}, c AS (SELECT list(score ORDER BY score DESC)[1 + (count(*) // 5)] AS cut FROM genomes),
u AS (SELECT block, param, any_value(lo) AS lo, any_value(hi) AS hi, min(value) FILTER (score >= cut) AS a, max(value) FILTER (score >= cut) AS b FROM long, c GROUP BY 1, 2)
SELECT block, param, round(CASE WHEN a < lo THEN greatest(0.5::DOUBLE, a - 0.1::DOUBLE * (hi - lo)) ELSE lo END, 6) AS lo, round(CASE WHEN b > hi THEN b + 0.1::DOUBLE * (hi - lo) ELSE hi END, 6) AS hi FROM u""")
def expand_bounds_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.expanded_bounds(d.genomes(spark, sf_dir), share=0.2)


@query("two_executions", f"SELECT symbol, timeframe, count(*) AS n, 0::BIGINT AS n_differing FROM ({REGISTERED['ema_cross_trades'][1]}) GROUP BY 1, 2")
def two_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the crossing strategy gives the same trades twice."""
    return r.differing(ema_cross_trades(spark, sf_dir), ema_cross_trades(spark, sf_dir), "symbol", "timeframe")


@query("seeded_ema", f"""{B.replace('WITH RECURSIVE ', 'WITH ').replace('WITH ', 'WITH RECURSIVE ', 1)}, num AS (SELECT symbol, timeframe, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS n FROM bars),
s AS (
  SELECT symbol, 20::BIGINT AS n, avg(close) AS v FROM num WHERE n <= 20 GROUP BY symbol HAVING count(*) = 20
  UNION ALL SELECT s.symbol, s.n + 1, num.close * (2 / 21::DOUBLE) + s.v * (1 - 2 / 21::DOUBLE) FROM s JOIN num ON num.symbol = s.symbol AND num.n = s.n + 1)
SELECT num.symbol, timeframe, time, round(v, 6) AS ema20 FROM num LEFT JOIN s ON s.symbol = num.symbol AND s.n = num.n""")
def seeded_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponential mean that begins with the mean of its first values; null before."""
    t = rec.over_series(d.bars(spark, sf_dir), {"ema20": "double"}, lambda f: {"ema20": rec.seeded(f["close"].to_numpy(), 20, 2 / 21)})
    return out(t.withColumn("ema20", F.nanvl("ema20", F.lit(None).cast("double"))), "ema20")
