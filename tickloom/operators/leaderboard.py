"""The leaderboard of good parameter sets: upsert, top-k, similarity search, merging, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import cosine
from tickloom.operators.blocks import PER_BLOCK
from tickloom.operators.search import most_similar

KEY = ("strategy_hash", "symbol", "timeframe")


def clean_score(score: Column) -> Column:
    """Not a number and infinite become 0."""
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of both, one per key and genome: the latest, with test_count + 1 and the run appended to the source where
    the genome was known before."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = W.partitionBy(*KEY, "genome_hash")
    t = both.withColumn("score", clean_score(F.col("score"))).withColumn("_n", F.row_number().over(by.orderBy(F.desc("_new"), F.desc("ts"), "source")))
    known = F.max(F.when(F.col("_new") == 0, F.struct("ts", "source", "test_count"))).over(by)
    t = t.withColumn("_old", known).filter("_n = 1")
    again = (F.col("_new") == 1) & F.col("_old").isNotNull()
    return t.withColumn("source", F.when(again, F.concat_ws(".", "_old.source", "source")).otherwise(F.col("source"))).withColumn("test_count", F.when(again, F.col("_old.test_count") + 1).otherwise(F.col("test_count"))).drop("_new", "_n", "_old")


def rank_value(score: Column, stability: Column) -> Column:
    """What v2 ranks by: 0.7 of the score and 0.3 of 30 times the stability."""
    return score * 0.7 + stability * 9.0


def top_per_key(board: DataFrame, limit: int, value: Column, min_stability: float = 0.0) -> DataFrame:
    """The best `limit` records of each key, with rank. Spark keeps no more than limit rows of a key before the shuffle."""
    t = board.filter(F.col("stability") >= min_stability).withColumn("value", F.round(value, 6))
    return t.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("value"), "genome_hash", "ts"))).filter(F.col("rank") <= limit)


def top_overall(board: DataFrame, per_key: int, limit: int) -> DataFrame:
    """The best of all keys, each genome once."""
    t = top_per_key(board, per_key, F.col("score"))
    once = t.withColumn("_n", F.row_number().over(W.partitionBy("genome_hash").orderBy(F.desc("value"), "ts"))).filter("_n = 1").drop("_n")
    return once.orderBy(F.desc("value"), "genome_hash").limit(limit)


#: Queries that meet all records at once: a block of vectors of 32 numbers has 5 MB.
QUERY_BLOCK = 20_000


def against_all(rows: DataFrame, queries: DataFrame, per_block: int = QUERY_BLOCK) -> DataFrame:
    """Every query (query_id, query_vec) beside every row: a stated set of queries, in blocks of a bounded size.

    Each block is broadcast for one pass over rows; what is made of the pairs must be cut per query by the caller."""
    blocks = max(1, -(-queries.count() // per_block))
    parts = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [queries]
    out = rows.crossJoin(F.broadcast(parts[0]))
    for part in parts[1:]:
        out = out.unionByName(rows.crossJoin(F.broadcast(part)))
    return out


#: Pairs up to which it is quicker to compare all.
SMALL = 20_000_000


def similar(board: DataFrame, profiles: DataFrame, limit: int = 20, threshold: float = 0.7, min_stability: float = 0.0, small: int = SMALL, per_block: int = PER_BLOCK, told: dict | None = None) -> DataFrame:
    """profiles (query_id, vec: the stated queries) -> each one's most similar records, by cosine (0 to 1).

    The robustness filter applies to the first 2 * limit, then limit remain. More than `small` pairs are searched in blocks
    of records, of which those that can't hold any of them are left out (given a threshold over 0); told gets the share of
    pairs that were compared. Fewer are all compared."""
    if threshold > 0 and board.count() * profiles.count() > small:
        t = most_similar(board, profiles, 2 * limit, threshold, ["genome_hash", "ts"], per_block, told)
    else:
        t = against_all(board, profiles.select("query_id", F.col("vec").alias("query_vec")))
        t = t.withColumn("similarity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("vec"), F.col("query_vec")))), 6)).drop("vec", "query_vec").filter(F.col("similarity") >= threshold)
    by = W.partitionBy("query_id").orderBy(F.desc("similarity"), "genome_hash", "ts")
    t = t.withColumn("_n", F.row_number().over(by)).filter((F.col("_n") <= 2 * limit) & (F.col("stability") >= min_stability))
    return t.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit).drop("_n")


def seeds(top: DataFrame, alike: DataFrame) -> DataFrame:
    """The genomes to begin with: the top ones, and similar ones that they lack, each genome once (its best record)."""
    both = top.select("genome_hash", "score", "ts", F.lit(0).alias("_from")).unionByName(alike.select("genome_hash", "score", "ts", F.lit(1).alias("_from")))
    best = both.groupBy("genome_hash").agg(F.min_by(F.struct("score", "ts", "_from"), F.struct("_from", -F.col("score"), "ts")).alias("b"))
    return best.select("genome_hash", "b.score", "b.ts", (F.col("b._from") == 1).alias("similar"))


def merged_with_selection(new_top: DataFrame, selected: DataFrame, run: int) -> DataFrame:
    """The new results better than the best selected record; where none is, the selected records, their run appended to
    the source. status: IMPROVED or NO_IMPROVEMENT."""
    best = selected.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_best"))
    better = new_top.crossJoin(F.broadcast(best)).filter(F.col("score") > F.col("_best")).drop("_best")  # one row
    some = better.agg((F.count("*") > 0).alias("_some"))
    kept = selected.withColumn("source", F.concat_ws(".", F.when(F.col("source") != "", F.col("source")), F.lit(str(run)))).crossJoin(F.broadcast(some)).filter(~F.col("_some")).drop("_some")  # one row
    columns = new_top.columns
    return better.withColumn("status", F.lit("IMPROVED")).unionByName(kept.select(*columns).withColumn("status", F.lit("NO_IMPROVEMENT")))


def seeds_marked(results: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds is_new: the genome is not among the seeds."""
    known = seeds.select("genome_hash").distinct().withColumn("_seed", F.lit(True))
    return results.join(known, "genome_hash", "left").withColumn("is_new", F.col("_seed").isNull()).drop("_seed")


def merged(new_top: DataFrame, board: DataFrame, keep: int) -> DataFrame:
    """The new top and those records that it lacks, the best `keep`."""
    rest = board.join(new_top.select("genome_hash"), "genome_hash", "left_anti")
    return new_top.unionByName(rest).orderBy(F.desc("score"), "genome_hash", "ts").limit(keep)


def improvement(new: DataFrame, board: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """One row: the best score of either side, the difference, and whether it is an improvement."""
    a, b = new.agg(F.max("score").alias("new_best")), board.agg(F.max("score").alias("old_best"))
    return a.crossJoin(b).withColumn("delta", F.round(F.coalesce("new_best", F.lit(0.0)) - F.coalesce("old_best", F.lit(0.0)), 6)).withColumn("improved", F.col("delta") > epsilon)  # one row each


def statistics(board: DataFrame) -> DataFrame:
    """Totals over all records, by symbol and by timeframe, in one pass of grouping sets."""
    grouped = board.groupingSets([[], ["symbol"], ["timeframe"]], "symbol", "timeframe")
    score = F.when(F.col("score") != 0, F.col("score"))
    return grouped.agg(F.count("*").alias("records"), F.count_if("passed").alias("robust"), F.round(F.avg(score), 6).alias("mean_score"))


def latest_marked(board: DataFrame) -> DataFrame:
    """Adds last_run (the last number of the source) and is_new: it is the latest of all, or the source is compound."""
    t = board.withColumn("last_run", F.element_at(F.split("source", r"\."), -1).cast("int"))
    latest = t.agg(F.max("last_run").alias("_latest"))
    return t.crossJoin(F.broadcast(latest)).withColumn("is_new", (F.col("last_run") == F.col("_latest")) | F.col("source").contains(".")).drop("_latest")  # one row


def upgraded(old: DataFrame) -> DataFrame:
    """Records of five profile fields -> records with a nested profile, with defaults for what they lack."""
    c = lambda name, value: F.coalesce(F.col(name), F.lit(value))
    profile = F.struct(F.struct(c("atr_pct", 0.0).alias("atr_pct"), c("volatility", 0.3).alias("vol_ratio")).alias("volatility"), F.struct(c("adx", 20.0).alias("adx"), c("trend_ratio", 0.5).alias("trend_ratio")).alias("trend"), F.struct(c("rsi_mean", 50.0).alias("rsi_mean")).alias("momentum"))
    return old.select(*KEY, "genome_hash", F.coalesce("score", F.lit(0.0)).alias("brain_score"), F.lit(0.0).alias("stability"), F.lit(False).alias("passed"), profile.alias("profile"))


def best_for_conditions(board: DataFrame, profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each profile (query_id, vec) the similar record with the best similarity * score * (1 + stability / 2); the
    best of all records where none is similar."""
    t = similar(board, profiles, 20, threshold).withColumn("value", F.round(F.col("similarity") * F.col("score") * (1 + 0.5 * F.col("stability")), 6))
    best = t.groupBy("query_id").agg(F.max_by(F.struct("genome_hash", "ts", "value"), F.struct("value", "genome_hash", "ts")).alias("b")).select("query_id", "b.*")
    top = board.orderBy(F.desc("score"), "genome_hash", "ts").limit(1).select(F.col("genome_hash").alias("_h"), F.col("ts").alias("_t"))
    missing = profiles.select("query_id").join(best, "query_id", "left").crossJoin(F.broadcast(top))  # one row
    return missing.select("query_id", F.coalesce("genome_hash", "_h").alias("genome_hash"), F.coalesce("ts", "_t").alias("ts"), "value")


def with_new(results: DataFrame, n: int) -> DataFrame:
    """results (genome_hash, score, is_new) -> the best n; where none of them is new, the last one gives way to the best
    new one. Two top-k lists and one flag, no full sort."""
    order = [F.desc("score"), F.asc("genome_hash")]
    top = results.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    first_new = results.filter("is_new").orderBy(*order).limit(1).withColumn("rank", F.lit(n))
    flag = top.agg(F.coalesce(F.max("is_new"), F.lit(True)).alias("_has"), F.coalesce(F.max("rank"), F.lit(0)).alias("_n"))
    room = first_new.crossJoin(F.broadcast(flag)).filter(~F.col("_has")).drop("_has", "_n")  # one row each
    kept = top.join(F.broadcast(room.select(F.col("rank").alias("_gone"))), F.col("rank") == F.col("_gone"), "left_anti")
    return kept.unionByName(room)


def best_label(results: DataFrame, label: str, least: int = 3) -> DataFrame:
    """The label with the best mean score among those with `least` results."""
    a = results.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).filter(F.col("n") >= least)
    return a.orderBy(F.desc("mean_score"), label).limit(1)


#: A range has to be as long as this many months (of 30.44 days) for its results to be stored.
MIN_MONTHS = 11


def worth_storing(results: DataFrame, keep: int = 5, months: float = MIN_MONTHS) -> DataFrame:
    """results (genome_hash, profit_factor, range_from, range_to) -> the `keep` best genomes by profit factor, each once,
    of results with a factor over 0 whose range is long enough."""
    long = F.datediff("range_to", "range_from") / 30.44 >= months
    once = results.filter(long & (F.col("profit_factor") > 0)).groupBy("genome_hash").agg(F.max("profit_factor").alias("profit_factor"))
    return once.orderBy(F.desc("profit_factor"), "genome_hash").limit(keep)


def to_record(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds record: the columns as JSON, numbers that JSON doesn't have as null."""
    kinds = dict(rows.dtypes)

    def clean(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        return F.when(~bad, F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)

    return rows.withColumn("record", F.to_json(F.struct(*map(clean, columns)), {"ignoreNullFields": "false"}))


def from_record(rows: DataFrame, schema: str) -> DataFrame:
    """Adds the fields of record; null where it isn't JSON of that schema."""
    return rows.withColumn("_r", F.from_json("record", schema)).select("*", "_r.*").drop("_r")
