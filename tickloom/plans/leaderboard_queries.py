"""Queries over the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.operators import leaderboard as lb
from tickloom.plans.registry import query
from tickloom.sources import board
from tickloom.sources import derived as d
from tickloom.sources.shared import scratch

L = f"WITH {d.LEADERBOARD_SQL}"
TOP = """v AS (SELECT *, round(score * 0.7::DOUBLE + stability * 9::DOUBLE, 6) AS value FROM board WHERE stability >= 0.3), t AS (SELECT *, row_number() OVER (PARTITION BY strategy_hash, symbol, timeframe ORDER BY value DESC, genome_hash, ts) AS rank FROM v)"""


@query("top_genomes", f"{L}, {TOP} SELECT symbol, timeframe, genome_hash, ts, value, rank::INT AS rank FROM t WHERE rank <= 10")
def top_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lb.top_per_key(d.leaderboard(spark, sf_dir), 10, lb.rank_value(F.col("score"), F.col("stability")), 0.3)
    return t.select("symbol", "timeframe", "genome_hash", "ts", "value", "rank")


@query("all_top_genomes", f"""{L}, t AS (SELECT *, row_number() OVER (PARTITION BY strategy_hash, symbol, timeframe ORDER BY round(score, 6) DESC, genome_hash, ts) AS r FROM board WHERE stability >= 0), o AS (SELECT *, row_number() OVER (PARTITION BY genome_hash ORDER BY round(score, 6) DESC, ts) AS n FROM t WHERE r <= 10)
SELECT genome_hash, score, ts FROM o WHERE n = 1 ORDER BY round(score, 6) DESC, genome_hash LIMIT 50""")
def all_top_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.top_overall(d.leaderboard(spark, sf_dir), 10, 50).select("genome_hash", "score", "ts")


SIM = """q AS (SELECT id AS query_id, vec AS qv FROM profiles WHERE id % 50 = 0), c AS (SELECT b.*, query_id, round(greatest(0, least(1, list_cosine_similarity(b.vec, qv))), 6) AS similarity FROM board b, q), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, genome_hash, ts) AS n FROM c WHERE similarity >= 0.2),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, genome_hash, ts) AS rank FROM f WHERE n <= 40 AND stability >= 0.3)"""


@query("similar_genomes", f"{L}, {SIM} SELECT query_id, rank::INT AS rank, genome_hash, ts, similarity FROM g WHERE rank <= 20")
def similar_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = d.profiles(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return lb.similar(d.leaderboard(spark, sf_dir), queries, 20, 0.2, 0.3).select("query_id", "rank", "genome_hash", "ts", "similarity")


@query("memory_stats", f"{L} SELECT symbol, timeframe, count(*) AS records, count(*) FILTER (passed) AS robust, round(avg(score) FILTER (score <> 0), 6) AS mean_score FROM board GROUP BY GROUPING SETS ((), (symbol), (timeframe))")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.statistics(d.leaderboard(spark, sf_dir))


@query("mark_seeds", f"{L} SELECT ts, genome_hash, genome_hash NOT IN (SELECT genome_hash FROM board WHERE score > 50) AS is_new FROM board")
def mark_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.leaderboard(spark, sf_dir)
    return lb.seeds_marked(t.select("ts", "genome_hash"), t.filter("score > 50")).select("ts", "genome_hash", "is_new")


@query("merge_leaderboard", f"{L}, n AS (SELECT * FROM board WHERE passed) SELECT genome_hash, score, ts FROM (SELECT genome_hash, score, ts FROM n UNION ALL SELECT genome_hash, score, ts FROM board WHERE genome_hash NOT IN (SELECT genome_hash FROM n)) ORDER BY score DESC, genome_hash, ts LIMIT 100")
def merge_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.leaderboard(spark, sf_dir).select("genome_hash", "score", "ts", "passed")
    return lb.merged(t.filter("passed"), t, 100).select("genome_hash", "score", "ts")


@query("improvement", f"{L} SELECT max(score) FILTER (passed) AS new_best, max(score) FILTER (NOT passed) AS old_best, round(max(score) FILTER (passed) - max(score) FILTER (NOT passed), 6) AS delta, max(score) FILTER (passed) - max(score) FILTER (NOT passed) > 1e-9 AS improved FROM board")
def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.leaderboard(spark, sf_dir)
    return lb.improvement(t.filter("passed"), t.filter("not passed"))


UPSERT = """o AS (SELECT *, 0 AS new FROM board WHERE ts % 2 = 0), n AS (SELECT *, 1 AS new FROM board WHERE ts % 120 = 20 OR ts % 120 = 80), b AS (SELECT * FROM o UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy_hash, symbol, timeframe, genome_hash ORDER BY new DESC, ts DESC, source) AS k, max(CASE WHEN new = 0 THEN (ts, source, test_count) END) OVER (PARTITION BY strategy_hash, symbol, timeframe, genome_hash) AS old FROM b)"""


UPSERTED = f"{L}, {UPSERT} SELECT symbol, timeframe, genome_hash, score, ts, CASE WHEN new = 1 AND old IS NOT NULL THEN concat_ws('.', old[2], source) ELSE source END AS source, (CASE WHEN new = 1 AND old IS NOT NULL THEN old[3] + 1 ELSE test_count END)::INT AS test_count FROM r WHERE k = 1"


@query("upsert_records", UPSERTED)
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.leaderboard(spark, sf_dir)
    done = lb.upserted(t.filter("ts % 2 = 0"), t.filter("ts % 120 = 20 or ts % 120 = 80"))
    return done.select("symbol", "timeframe", "genome_hash", "score", "ts", "source", "test_count")


@query("store_records", UPSERTED)
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the table on disk; the second batch comes twice."""
    t = d.leaderboard(spark, sf_dir)
    path = scratch(spark, "board")
    for part, batch in (("ts % 2 = 0", 0), ("ts % 120 = 20 or ts % 120 = 80", 1), ("ts % 120 = 20 or ts % 120 = 80", 1)):
        board.store(t.filter(part), path, batch)
    return board.stored(spark, path).select("symbol", "timeframe", "genome_hash", "score", "ts", "source", "test_count")


@query("mark_latest", f"{L}, x AS (SELECT ts, source, split_part(source, '.', -1)::INT AS last_run FROM board) SELECT ts, last_run, last_run = (SELECT max(last_run) FROM x) OR contains(source, '.') AS is_new FROM x")
def mark_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.latest_marked(d.leaderboard(spark, sf_dir)).select("ts", "last_run", "is_new")


@query("genome_hashes", f"WITH {d.GENOMES_SQL} SELECT genome_id, substr(sha256('{{\"fast\":' || (5 + genome_id % 4) || ',\"slow\":20}}'), 1, 12) AS genome_hash FROM genomes")
def genome_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.genomes(spark, sf_dir)
    return t.select("genome_id", s.genome_hash(F.struct((5 + F.col("genome_id") % 4).alias("fast"), F.lit(20).alias("slow"))).alias("genome_hash"))
