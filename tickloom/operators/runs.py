"""Runs of a sweep: grids, filters, ranking, agreement, stability, sampling, Pareto front."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.operators import blocks
from tickloom.sources.shared import written


def with_score(runs: DataFrame) -> DataFrame:
    """Adds score, from the summary and its smoothness (0 where there is none)."""
    smooth = F.coalesce(F.col("smoothness"), F.lit(0.0)) if "smoothness" in runs.columns else F.lit(0.0)
    return runs.withColumn("score", s.strategy_score(F.col("profit_factor"), F.col("winrate"), smooth, F.col("max_drawdown_pct")))


def ema_grid(spark: SparkSession, fast: tuple[int, int, int], slow: tuple[int, int, int]) -> DataFrame:
    """All (fast, slow) with fast < slow; ranges are (first, last, step). Small by its parameters, whatever the data."""
    a = spark.range(1).select(F.explode(F.sequence(*map(F.lit, fast))).alias("fast"))
    b = spark.range(1).select(F.explode(F.sequence(*map(F.lit, slow))).alias("slow"))
    return a.join(b, F.col("fast") < F.col("slow"))


def build_runs(series: DataFrame, grid: DataFrame, windows: list[tuple[str, str]]) -> DataFrame:
    """One row per (symbol, timeframe), parameters and window, with a run_id that depends on these values alone."""
    spans = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in windows])).alias("w")
    both = series.crossJoin(F.broadcast(grid)).select("*", spans).select("*", "w.*").drop("w")  # grid is bounded by its parameters
    return both.withColumn("run_id", F.xxhash64(F.to_json(F.struct(*sorted(both.columns)))))


def profitable(runs: DataFrame, min_pnl: float = 0.0, min_trades: int = 10) -> DataFrame:
    return runs.filter((F.col("net_profit") > min_pnl) & (F.col("total_trades") >= min_trades))


def quality(runs: DataFrame, min_pf: float = 1.0, min_trades: int = 30, max_dd: float = 40.0) -> DataFrame:
    return runs.filter((F.col("profit_factor") >= min_pf) & (F.col("total_trades") >= min_trades) & (F.col("max_drawdown_pct") <= max_dd))


def ranked(runs: DataFrame, max_dd: float = 200.0, min_pf: float = 0.9, min_trades: int = 80) -> DataFrame:
    """Runs that pass the limits, with rank_score, best first."""
    t = quality(runs, min_pf, min_trades, max_dd)
    return t.withColumn("rank_score", s.rank_score(F.col("net_profit"), F.col("profit_factor"), F.col("winrate"), F.col("max_drawdown_pct"))).orderBy(F.desc("rank_score"), "run_id")


def agreement(runs: DataFrame, params: list[str], min_tf: int = 2) -> DataFrame:
    """Runs whose symbol and parameters occur min_tf times or more (rows are counted, not timeframes)."""
    n = F.count("*").over(W.partitionBy("symbol", *params))
    return runs.withColumn("_n", n).filter(F.col("_n") >= min_tf).drop("_n")


def stability(runs: DataFrame, params: list[str]) -> DataFrame:
    """Per symbol and parameters: how profit factor, drawdown and win rate hold over the runs."""
    pf = F.col("profit_factor")
    return runs.groupBy("symbol", *params).agg(F.round(F.median(pf), 4).alias("median_pf"), F.round(F.min(pf), 4).alias("worst_pf"), F.round(F.stddev_pop(pf), 4).alias("pf_std"), F.round(F.max("max_drawdown_pct"), 4).alias("worst_dd"), F.round(F.median("winrate"), 2).alias("median_wr"), F.count("*").alias("windows"))


def is_stable(min_median_pf: float = 1.0, min_worst_pf: float = 0.9, max_worst_dd: float = 45.0, max_pf_std: float = 0.6) -> Column:
    return (F.col("median_pf") >= min_median_pf) & (F.col("worst_pf") >= min_worst_pf) & (F.col("worst_dd") <= max_worst_dd) & (F.col("pf_std") <= max_pf_std)


def optimize(runs: DataFrame, params: list[str], min_tf: int = 2, rules: dict | None = None) -> DataFrame:
    """All runs with score and passed: profitable, agreed on, and stable under the optimizer's stricter rules."""
    scored = with_score(runs)
    good = agreement(profitable(scored), params, min_tf)
    stable = stability(good, params).filter(is_stable(**(rules or {"min_median_pf": 1.05, "min_worst_pf": 0.95}))).select("symbol", *params)
    passed = good.join(stable, ["symbol", *params], "left_semi").select("run_id", F.lit(True).alias("passed"))
    return scored.join(passed, "run_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def sweep_stats(optimized: DataFrame) -> DataFrame:
    return optimized.agg(F.count("*").alias("total_runs"), F.count_if("passed").alias("passed_runs"), F.count_if(~F.col("passed")).alias("rejected_runs"))


def top(runs: DataFrame, by: str, n: int, descending: bool = True) -> DataFrame:
    """The n best rows with rank 1..n: a top-k, no full sort; the numbering runs over n rows."""
    order = [F.desc(by) if descending else F.asc(by), F.asc("run_id")]
    return runs.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def mode_ranking(runs: DataFrame, mode: Column) -> DataFrame:
    """Adds ranked_by (fast, brain or net profit by mode) and keeps robust runs, or all of a mode that has none."""
    value = F.when(mode == "ULTRA", s.fast_score(F.col("net_profit"), F.col("max_drawdown_pct"))).when(mode == "BRAIN", F.col("brain_score")).otherwise(F.col("net_profit"))
    t = runs.withColumn("mode", mode).withColumn("ranked_by", F.round(value, 6))
    some = t.groupBy("mode").agg(F.max("robust").alias("_any"))  # a row per mode
    return t.join(F.broadcast(some), "mode").filter(F.col("robust") | ~F.col("_any")).drop("_any")


def one_each(runs: DataFrame, key: list[Column], by: str = "score") -> DataFrame:
    """The best run of each key."""
    t = runs.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(by), "run_id")))
    return t.filter("_n = 1").drop("_n")


#: A key with more runs than this is dealt over SALT tasks where it meets its best run.
HOT, SALT = 100_000, 32


def one_of_both(runs: DataFrame, first: list[Column], second: list[Column], by: str = "score", tail: int = 10_000) -> DataFrame:
    """Runs that a walk from the best on keeps, if a run is kept where neither of its two keys was kept before.

    The walk in parallel rounds: a run is kept once it is the best undecided one of both its keys; its rivals of either
    key then go. Runs that share both keys with a better one never count, so only the best of each pair of keys goes in. A
    rejected run leaves its other key free, as in the walk. The last `tail` undecided runs are walked in one task, so a
    chain of runs that hold each other back ends. Each round writes what is left. A null score ranks last; keys that are
    null are equal. run_id is unique."""
    rank = F.struct(F.coalesce(F.col(by).cast("double"), F.lit(float("-inf"))).alias("s"), F.bitwise_not("run_id").alias("r"))
    keyed = runs.select(rank.alias("_rank"), F.to_json(F.struct(*first)).alias("_k1"), F.to_json(F.struct(*second)).alias("_k2"))
    left = written(keyed.groupBy("_k1", "_k2").agg(F.max("_rank").alias("_rank")), "both-keys")
    chosen: list[DataFrame] = []
    while (n := left.count()) > tail:
        best = left
        for k in ("_k1", "_k2"):
            best = _with_best(best, k)
        new = written(best.filter((F.col("_rank") == F.col("_best_k1")) & (F.col("_rank") == F.col("_best_k2"))).select("_k1", "_k2", "_rank"), "both-kept")
        chosen.append(new)
        left = written(left.join(new.select("_k1"), "_k1", "left_anti").join(new.select("_k2"), "_k2", "left_anti"), "both-left")
    if n:
        chosen.append(left.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_walk_both, left.schema))
    if not chosen:
        return runs.limit(0)
    kept = functools.reduce(DataFrame.unionByName, [c.select(F.bitwise_not("_rank.r").alias("run_id")) for c in chosen])
    return runs.join(kept, "run_id", "left_semi")


def _with_best(left: DataFrame, key: str) -> DataFrame:
    """left and the best rank of each row's key. A key that many rows share is spread over tasks by a salt."""
    best = left.groupBy(key).agg(F.max("_rank").alias(f"_best{key}"), F.count("*").alias("_n"))
    best = written(best, "both-best")
    hot = best.filter(F.col("_n") > HOT).select(key, F.lit(SALT).alias("_salts"))  # one key for every HOT rows at most
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_rank"), F.col("_salts")), F.lit(0)).cast("int"))
    told = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > HOT, SALT - 1).otherwise(0)))).drop("_n")
    return salted.join(told, [key, "_salt"]).drop("_salt", "_salts")


def _walk_both(rows):
    import pyarrow as pa

    rank = rows["_rank"].combine_chunks()
    order = np.lexsort((-rank.field("r").to_numpy(zero_copy_only=False), -rank.field("s").to_numpy(zero_copy_only=False)))
    one, two, seen, kept = rows["_k1"].to_pylist(), rows["_k2"].to_pylist(), (set(), set()), []
    for i in order.tolist():
        if one[i] not in seen[0] and two[i] not in seen[1]:
            seen[0].add(one[i])
            seen[1].add(two[i])
            kept.append(i)
    return rows.drop_columns(["_one"]).take(pa.array(kept, pa.int64()))


def stratified_sample(runs: DataFrame, n: int, seed: str = "sample-1") -> DataFrame:
    """n runs, dealt to timeframes by their share (one at least; the remainder to the largest), chosen by a seeded hash."""
    counts = runs.groupBy("timeframe").agg(F.count("*").alias("_c"))
    all_rows, first = W.partitionBy(), W.orderBy(F.desc("_c"), "timeframe")  # one row per timeframe
    quota = counts.withColumn("_total", F.sum("_c").over(all_rows)).withColumn("_q", F.greatest(F.lit(1), F.floor(F.lit(n) * (F.col("_c") / F.col("_total")))))
    quota = quota.withColumn("_left", F.greatest(F.lit(0), n - F.sum("_q").over(all_rows))).withColumn("_q", F.col("_q") + F.when(F.row_number().over(first) == 1, F.col("_left")).otherwise(0))
    quota = quota.withColumn("_q", F.when(F.col("_total") <= n, F.col("_c")).otherwise(F.col("_q")))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("run_id").cast("string")).cast("binary"))
    t = runs.withColumn("_n", F.row_number().over(W.partitionBy("timeframe").orderBy(draw, "run_id"))).filter(F.col("_n") <= n)  # cut before the shuffle
    t = t.join(F.broadcast(quota), "timeframe")  # a row per timeframe
    return t.filter(F.col("_n") <= F.col("_q")).drop("_n", "_q", "_c", "_total", "_left")


def downsampled(curve: DataFrame, max_points: int) -> DataFrame:
    """Every step-th point of each curve, and its last, max_points at most."""
    whole = W.partitionBy("run_id")
    t = curve.withColumn("_i", F.row_number().over(whole.orderBy("idx")) - 1).withColumn("_n", F.count("*").over(whole))
    step = F.floor((F.col("_n") - 1) / (max_points - 1)) + 1
    t = t.filter((F.col("_n") <= max_points) | (F.pmod("_i", step) == 0) | (F.col("_i") == F.col("_n") - 1))
    return t.withColumn("_k", F.row_number().over(whole.orderBy("idx"))).filter(F.col("_k") <= max_points).drop("_i", "_n", "_k")


OBJECTIVES = {"net_profit_pct": 1, "sharpe": 1, "winrate": 1, "max_drawdown_pct": -1}


#: Points that blocks are held against as a whole before their rows are.
CHAMPIONS = 1000


def pareto_front(runs: DataFrame, objectives: dict[str, int] | None = None, per_block: int = 2000) -> DataFrame:
    """Runs that no other run dominates (as good in all objectives, better in one).

    Equal points are one. Points are sliced by all objectives into blocks of a bounded size; a block keeps its own front;
    blocks whose best corner a champion (the best point of a block by its mean share of the ranges, CHAMPIONS of them)
    dominates go as a whole; of the others, a block meets only those whose best corner is no worse than its worst one. So
    no task sees more than two blocks, and a front that is most of the table is spread like the table itself. A run with
    a null objective neither dominates nor is dominated; NaN is like infinite."""
    goals = objectives or OBJECTIVES
    clean = [F.when(F.isnan(x), float("inf")).otherwise(x) * sign + 0.0 for c, sign in goals.items() for x in [F.col(f"`{c}`").cast("double")]]
    whole = functools.reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in goals])
    points = runs.filter(whole).select(F.array(*clean).alias("_p")).distinct()
    dealt = blocks.in_blocks(points, per_block, len(goals))
    own = written(dealt.groupBy("_block").applyInArrow(_own_front, "_p array<double>, _slice int, _block long"), "pareto-own")
    bounds = written(blocks.boxes(own), "pareto-boxes")
    if bounds.count() <= 1:
        left = own.select(F.col("_p").alias("_front"))
        return runs.filter(~whole).unionByName(runs.filter(whole).join(left, F.array(*clean) == F.col("_front"), "left_semi"))

    ends = bounds.select(*[f(F.col(c)[j]).alias(f"{c}{j}") for j in range(len(goals)) for f, c in ((F.min, "low"), (F.max, "high"))])
    mean = sum((F.col("_p")[j] - F.col(f"low{j}")) / F.greatest(F.col(f"high{j}") - F.col(f"low{j}"), F.lit(1e-300)) for j in range(len(goals)))
    best = own.crossJoin(F.broadcast(ends)).groupBy("_block").agg(F.max_by("_p", mean).alias("best"), F.max(mean).alias("m"))  # ends is one row
    champions = best.orderBy(F.desc("m")).limit(CHAMPIONS).select("best")
    beaten = functools.reduce(Column.__and__, [F.col("best")[j] >= F.col("high")[j] for j in range(len(goals))]) & (F.col("best") != F.col("high"))
    bounds = written(bounds.join(F.broadcast(champions), beaten, "left_anti"), "pareto-left")

    may = functools.reduce(Column.__and__, [F.col("high0")[j] >= F.col("low1")[j] for j in range(len(goals))]) & (F.col("_a") != F.col("_b"))
    held = blocks.packed(own.join(F.broadcast(bounds.select("_block")), "_block", "left_semi"), ["_p"], "pareto-blocks")  # a row for each block
    left = blocks.unpacked(held, blocks.meet(held, held, may, _beaten)).filter("_mark = 0").select(F.col("_p").alias("_front"))
    return runs.filter(~whole).unionByName(runs.filter(whole).join(left, F.array(*clean) == F.col("_front"), "left_semi"))


def _dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of x some row of `by` is no worse than in all columns and better in one."""
    out = np.zeros(len(x), bool)
    by = by[np.argsort(-by.sum(axis=1), kind="stable")]  # the best first: most rows fall to the first few
    left = np.arange(len(x))
    for at in range(0, len(by), 64):
        part = by[at : at + 64]
        hit = ((part[None] >= x[left][:, None]).all(axis=2) & (part[None] > x[left][:, None]).any(axis=2)).any(axis=1)
        out[left[hit]] = True
        left = left[~hit]
    return out


def _own_front(rows):
    import pyarrow as pa

    x = blocks.matrix(rows["_p"])
    return rows.select(["_p", "_slice", "_block"]).filter(pa.array(~_dominated(x, x)))


def _beaten(left, right, own):
    return None, _dominated(blocks.matrix(right["_p"]), blocks.matrix(left["_p"]))


def pruned_trades(trades: DataFrame, keep: int = 1200) -> DataFrame:
    """The last `keep` trades of each run; Spark cuts each run before the shuffle."""
    t = trades.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("trade_no"))))
    return t.filter(F.col("_n") <= keep).drop("_n")


def even_points(curve: DataFrame, points: int = 200) -> DataFrame:
    """As many evenly spaced points of each curve, first and last included; shorter curves whole."""
    whole = W.partitionBy("run_id")
    t = curve.withColumn("_i", F.row_number().over(whole.orderBy("idx")) - 1).withColumn("_n", F.count("*").over(whole))
    step = (F.col("_n") - 1).cast("double") / (points - 1)
    place = F.ceil(F.col("_i") / step)  # the first grid place at or after the point
    taken = F.exists(F.array(place - 1, place, place + 1), lambda j: (j >= 0) & (j < points) & (F.floor(j * step) == F.col("_i")))
    return t.filter((F.col("_n") <= points) | taken).drop("_i", "_n")


def best_runs(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (symbol, timeframe, params) with the best scored run (run_id, score) of the same place and parameters."""
    key = F.to_json("params")
    best = runs.groupBy("symbol", "timeframe", key.alias("_key")).agg(F.max_by(F.struct("run_id", "score"), F.struct("score", -F.col("run_id"))).alias("_b"))
    return asked.withColumn("_key", key).join(best, ["symbol", "timeframe", "_key"]).select("*", "_b.run_id", "_b.score").drop("_key", "_b")


def differing(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """keys, n and n_differing: rows of the first execution, and rows of either that the other lacks (repeats count)."""
    one, two = (a.exceptAll(b).groupBy(*keys).agg(F.count("*").alias("_d")) for a, b in ((first, second), (second, first)))
    off = one.unionByName(two).groupBy(*keys).agg(F.sum("_d").alias("n_differing"))
    n = first.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(off, list(keys), "full").select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("n_differing", F.lit(0).cast("long")).alias("n_differing"))


def loss_streaks(trades: DataFrame) -> DataFrame:
    """run_id and streak: the longest run of trades without a profit."""
    by = W.partitionBy("run_id").orderBy("trade_no")
    won = F.sum((F.col("pnl") > 0).cast("int")).over(by)
    t = trades.select("run_id", "pnl", won.alias("_won")).groupBy("run_id", "_won").agg(F.count_if(F.col("pnl") <= 0).alias("n"))
    return t.groupBy("run_id").agg(F.max("n").alias("streak"))


def ulcer(trades: DataFrame, initial: float) -> DataFrame:
    """run_id and ulcer: the root of the mean squared percentage drawdown after each trade."""
    by = W.partitionBy("run_id").orderBy("trade_no")
    t = trades.withColumn("_e", F.round(initial + F.sum("pnl").over(by), 6)).withColumn("_p", F.greatest(F.lit(initial), F.max("_e").over(by)))
    return t.groupBy("run_id").agg(F.sqrt(F.avg(F.pow((F.col("_p") - F.col("_e")) / F.col("_p") * 100, 2))).alias("ulcer"))
