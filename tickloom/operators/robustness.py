"""Stress tests as exploded scenario tables: bootstrap, slippage, walk-forward, perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def r(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def bootstrap(trades: DataFrame, sims: int = 500, initial: float = 10_000.0, min_trades: int = 10) -> DataFrame:
    """Resampling with replacement: sims outcomes per run and what they say.

    A simulation's k-th draw is trade (sim * 7919 + k * 104729 + sim * k * 31) mod n, the same everywhere. A run's trades
    lie in one array, so a simulation is a sum over indices in its own row: the sims x trades rows are never shuffled."""
    packed = trades.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("trade_no", "pnl"))), lambda x: x["pnl"]).alias("p"))
    n = F.size("p")
    sim = packed.select("run_id", "p", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim"))
    drawn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + F.element_at("p", (F.pmod(F.col("sim") * 7919 + k * 104729 + F.col("sim") * k * 31, n) + 1).cast("int")))
    t = sim.select("run_id", n.alias("n"), r(drawn / initial * 100, 6).alias("pct"))
    a = t.groupBy("run_id").agg(F.first("n").alias("n"), F.avg("pct").alias("mean"), F.stddev_pop("pct").alias("std"), F.percentile("pct", 0.05).alias("var"), F.avg((F.col("pct") > 0).cast("double")).alias("prob"))
    return _judged(a, min_trades)


def _judged(a: DataFrame, min_trades: int) -> DataFrame:
    """(run_id, n, mean, std, var, prob) -> the rounded figures, score and passed; runs of too few trades fail with zeros."""
    enough = F.col("n") >= min_trades
    score = F.col("prob") * 0.4 + F.greatest(F.lit(0.0), 1 - F.col("std") / 50) * 0.3 + F.greatest(F.lit(0.0), (F.col("var") + 50) / 100) * 0.3
    either = lambda c: F.when(enough, c).otherwise(0.0)
    return a.select("run_id", r(either(F.col("mean")), 8).alias("mean_profit"), r(either(F.col("std")), 6).alias("std_profit"), r(either(F.col("var")), 6).alias("var_95"), r(either(F.col("prob")), 6).alias("profit_probability"), r(either(score), 6).alias("score"), (enough & (F.col("prob") >= 0.6) & (F.col("var") > -30)).alias("passed"))


def order_shuffle(trades: DataFrame, initial: float = 10_000.0, min_trades: int = 10) -> DataFrame:
    """Monte Carlo over the order of trades: the end doesn't depend on the order, so it has no spread."""
    a = trades.groupBy("run_id").agg(F.count("*").alias("n"), (F.sum("pnl") / initial * 100).alias("mean"))
    return _judged(a.select("run_id", "n", "mean", F.lit(0.0).alias("std"), F.col("mean").alias("var"), (F.col("mean") > 0).cast("double").alias("prob")), min_trades)


def slippage(trades: DataFrame, levels: tuple[float, ...] = (0.001, 0.002, 0.005, 0.01), initial: float = 10_000.0, min_trades: int = 5) -> DataFrame:
    """What is left of the profit when entry and exit cost a share of the price: percent kept by level, score, passed.

    The levels are sums beside each other in one aggregate, not rows."""
    cost = F.when(F.col("entry_price") > 0, F.col("entry_price") * F.col("size") * 2).otherwise(F.abs("pnl") * 2)
    a = trades.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("pnl").alias("base"), F.sum(cost).alias("cost"))
    base = F.col("base") / initial * 100
    kept = [F.when(base > 0, r((F.col("base") - x * F.col("cost")) / initial * 100 / F.greatest(base, F.lit(0.01)) * 100, 2)).otherwise(0.0) for x in levels]
    enough = F.col("n") >= min_trades
    score = sum((F.greatest(F.lit(0.0), k / 100) for k in kept), F.lit(0.0)) / len(levels)
    return a.select("run_id", r(base, 4).alias("base_profit_pct"), *[k.alias(f"kept_{i}") for i, k in enumerate(kept, 1)], F.when(enough, r(score, 6)).otherwise(0.0).alias("score"), (enough & (kept[1] > 50)).alias("passed"))


def segments(bars: DataFrame, windows: int = 3, in_sample: float = 0.7, least: int = 100) -> DataFrame:
    """Adds window (0..) and segment (IS, OOS): each series cut into windows of floor(n / windows) bars, the rest left
    out; windows under `least` bars are dropped. These are group keys for a backtest."""
    series = W.partitionBy("symbol", "timeframe")
    t = bars.withColumn("_i", F.row_number().over(series.orderBy("time")) - 1).withColumn("_size", F.floor(F.count("*").over(series) / windows))
    t = t.filter(F.col("_size") >= least).withColumn("window", F.floor(F.col("_i") / F.col("_size")).cast("int")).filter(F.col("window") < windows)
    inside = F.col("_i") - F.col("window") * F.col("_size") < F.floor(F.col("_size") * in_sample)
    return t.withColumn("segment", F.when(inside, "IS").otherwise("OOS")).drop("_i", "_size")


def walk_forward(scores: DataFrame) -> DataFrame:
    """scores (run_id, window, segment, score) -> consistency, correlation, degradation, score and passed per run."""
    w = scores.groupBy("run_id", "window").agg(F.max(F.when(F.col("segment") == "IS", F.col("score"))).alias("i"), F.max(F.when(F.col("segment") == "OOS", F.col("score"))).alias("o")).filter("i is not null and o is not null")
    a = w.groupBy("run_id").agg(F.count("*").alias("windows"), F.avg((F.col("o") > 0).cast("double")).alias("consistency"), F.corr("i", "o").alias("c"), F.avg("i").alias("mi"), F.avg("o").alias("mo"))
    corr = F.when(F.col("windows") > 2, F.coalesce(F.when(~F.isnan("c"), F.col("c")), F.lit(0.0))).otherwise(0.0)
    a = a.withColumn("correlation", corr).withColumn("degradation", F.when(F.col("mi") > 0, (F.col("mi") - F.col("mo")) / F.col("mi")).otherwise(0.0))
    score = F.col("consistency") * 0.5 + F.greatest(F.lit(0.0), F.col("correlation")) * 0.2 + F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("degradation"))) * 0.3
    return a.select("run_id", "windows", r(F.col("consistency"), 4).alias("consistency"), r(F.col("correlation"), 4).alias("correlation"), r(F.col("degradation"), 4).alias("degradation"), r(score, 4).alias("score"), (score >= 0.5).alias("passed"))


def variants(runs: DataFrame, columns: list[str], change: float = 0.10) -> DataFrame:
    """runs with map params -> base rows and, for each parameter, one lowered and one raised by `change`.

    All variants go into one backtest; `sensitivity` puts the scores together again."""
    kinds = [F.struct(F.lit("").alias("param"), F.lit(0.0).alias("delta"))] + [F.struct(F.lit(c).alias("param"), F.lit(x).alias("delta")) for c in columns for x in (-change, change)]
    t = runs.select("*", F.explode(F.array(*kinds)).alias("v")).withColumn("param", F.col("v.param")).withColumn("delta", F.col("v.delta")).drop("v")
    moved = F.transform_values("params", lambda k, x: F.when(k == F.col("param"), x * (1 + F.col("delta"))).otherwise(x))
    return t.withColumn("params", moved).withColumnRenamed("run_id", "base_id").withColumn("run_id", F.xxhash64("base_id", "param", "delta"))


def sensitivity(scored: DataFrame) -> DataFrame:
    """scored (base_id, param, delta, score) -> mean stability over parameters, the most and the least sensitive one.

    A parameter's stability is 1 less the mean relative change of the score, 0 at least."""
    base = scored.filter("param = ''").select("base_id", F.col("score").alias("base"))
    t = scored.filter("param <> ''").join(base, "base_id")
    change = F.abs(F.col("score") - F.col("base")) / F.greatest(F.abs("base"), F.lit(1e-9))
    p = t.groupBy("base_id", "param").agg(F.greatest(F.lit(0.0), 1 - F.avg(change)).alias("s"))
    return p.groupBy("base_id").agg(r(F.avg("s"), 4).alias("stability"), F.min_by("param", F.struct("s", "param")).alias("most_sensitive"), F.max_by("param", F.struct("s", "param")).alias("least_sensitive")).withColumn("passed", F.col("stability") >= 0.6)


def perturbation(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scored (base_id, delta, score; delta 0 is the base) -> .7 of the worst and .3 of the mean kept share."""
    base = scored.filter("delta = 0").select("base_id", F.col("score").alias("base"))
    t = scored.filter("delta <> 0").join(base, "base_id").withColumn("kept", F.when(F.col("base") > 0, F.greatest(F.lit(0.0), F.col("score") / F.col("base"))).otherwise(0.0))
    a = t.groupBy("base_id").agg(F.min("kept").alias("worst"), F.avg("kept").alias("mean"))
    return a.select("base_id", r(F.col("worst"), 4).alias("worst"), r(F.col("mean"), 4).alias("mean"), r(F.col("worst") * 0.7 + F.col("mean") * 0.3, 4).alias("stability"), (F.col("worst") >= threshold).alias("passed"))


#: Weights of the tests in the comprehensive score; a missing test counts as 0.5.
WEIGHTS = {"walk_forward": 0.3, "monte_carlo": 0.3, "sensitivity": 0.2, "slippage": 0.1, "noise": 0.1}


def comprehensive(runs: DataFrame, parts: dict[str, DataFrame], threshold: float = 0.6) -> DataFrame:
    """runs (run_id) and score tables (run_id, score) by the names in WEIGHTS -> stability and passed."""
    t, total = runs.select("run_id"), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in parts:
            t = t.join(parts[name].select("run_id", F.col("score").alias(f"_{name}")), "run_id", "left")
        total = total + weight * (F.coalesce(f"_{name}", F.lit(0.5)) if name in parts else F.lit(0.5))
    return t.withColumn("stability", r(total, 6)).withColumn("passed", F.col("stability") >= threshold).select("run_id", "stability", "passed")


def noisy(runs: DataFrame, columns: list[str], levels: tuple[float, ...] = (0.05, 0.1, 0.2), copies: int = 10) -> DataFrame:
    """runs with map params -> the base (level 0) and, for each level, copies whose parameters are times 1 + level * z, z
    normal, drawn by a hash of run, level, copy and parameter."""
    kinds = F.array(F.struct(F.lit(0.0).alias("level"), F.lit(0).alias("copy")), *[F.struct(F.lit(x).alias("level"), F.lit(k).alias("copy")) for x in levels for k in range(copies)])
    t = runs.select("*", F.explode(kinds).alias("v")).select("*", "v.level", "v.copy").drop("v")

    def unit(k: Column, tag: str) -> Column:
        text = F.concat_ws("|", F.lit(tag), F.col("run_id").cast("string"), F.col("level").cast("string"), F.col("copy").cast("string"), k)
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 1) / float((1 << 32) + 1)

    normal = lambda k: F.sqrt(-2 * F.log(unit(k, "u"))) * F.cos(2 * F.pi() * unit(k, "v"))
    moved = F.transform_values("params", lambda k, x: F.when(k.isin(*columns), x * (1 + F.col("level") * normal(k))).otherwise(x))
    return t.withColumn("params", moved).withColumnRenamed("run_id", "base_id").withColumn("run_id", F.xxhash64("base_id", "level", "copy"))


def noise_retention(scored: DataFrame) -> DataFrame:
    """scored (base_id, level, score; level 0 is the base) -> share of the score kept and its deviation by level."""
    base = scored.filter("level = 0").select("base_id", F.col("score").alias("base"))
    t = scored.filter("level > 0").join(base, "base_id")
    a = t.groupBy("base_id", "level").agg(F.first("base").alias("base"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return a.select("base_id", "level", r(F.when(F.col("base") > 0, F.greatest(F.lit(0.0), F.col("mean") / F.col("base"))).otherwise(0.0), 4).alias("retention"), r(F.col("std"), 4).alias("std"))


def quick(scored: DataFrame, least: float = 0.7) -> DataFrame:
    """scored (base_id, param, score; param '' is the base) -> the mean share of the score that raised parameters keep,
    of those that keep any, and whether it is enough. A base without a profit keeps nothing."""
    base = scored.filter("param = ''").select("base_id", F.col("score").alias("base"))
    t = base.join(scored.filter("param <> ''").select("base_id", "score"), "base_id", "left")
    a = t.groupBy("base_id", "base").agg(F.avg(F.when((F.col("score") > 0) & (F.col("base") > 0), F.col("score") / F.col("base"))).alias("kept"))
    return a.select("base_id", r(F.coalesce("kept", F.lit(0.0)), 4).alias("score"), F.coalesce(F.col("kept") >= least, F.lit(False)).alias("passed"))


def split(checked: DataFrame, threshold: float) -> DataFrame:
    """checked (score, passed) with kind: robust, or fragile."""
    return checked.withColumn("kind", F.when(F.col("passed") & (F.col("score") >= threshold), "robust").otherwise("fragile"))


def score_sharpe(scores: DataFrame) -> DataFrame:
    """scores (run_id, score) -> mean, population deviation and their ratio: 0 for one score, infinite without spread."""
    a = scores.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    std = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("std"))
    a = a.withColumn("std", std)
    flat = F.when(F.col("mean") > 0, float("inf")).otherwise(float("-inf"))
    sharpe = F.when(F.col("n") < 2, 0.0).when(F.col("std") == 0, flat).otherwise(r(F.col("mean") / F.col("std"), 6))
    return a.select("run_id", r(F.col("mean"), 6).alias("mean"), r(F.col("std"), 6).alias("std"), sharpe.alias("sharpe"))
