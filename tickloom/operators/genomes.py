"""Parameter sets (genomes) as nested structs: coherence, repair, bounds, distances, niches."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import clamp
from tickloom.operators import blocks
from tickloom.operators.ranks import best_share
from tickloom.sources.shared import written

#: Bounds of every number in a genome, by block and parameter.
BOUNDS = {
    "entry": {"st_atrPeriod": (1, 20), "st_mult": (0.5, 5.0), "rf_period": (30, 200), "rf_mult": (1.0, 10.0), "rsi_length": (5, 30), "rsi_ma_length": (2, 20)},
    "sl": {"st_atrPeriod": (1, 20), "st_mult": (2.0, 10.0), "rf_period": (30, 200), "rf_mult": (3.0, 15.0)},
    "tp_dual": {"st_atrPeriod": (1, 20), "st_mult": (0.5, 5.0), "rr_mult": (0.5, 5.0)},
    "tp_rsi": {"st_atrPeriod": (1, 20), "st_mult": (0.5, 5.0), "rr_mult": (0.5, 5.0)},
}
NUMBERS = [(block, p) for block, ps in BOUNDS.items() for p in ps]

#: Coherence rules, name -> SQL over the blocks' columns.
RULES = {
    "rf_period_vs_st_atr": "entry.rf_period >= entry.st_atrPeriod * 5",
    "rsi_ma_vs_rsi_length": "entry.rsi_ma_length <= entry.rsi_length",
    "st_mult_range": "entry.st_mult between 0.5 and 5.0",
    "rf_mult_range": "entry.rf_mult between 1.0 and 10.0",
    "sl_st_mult_vs_entry_st_mult": "sl.st_mult >= entry.st_mult",
    "sl_rf_mult_vs_entry_rf_mult": "sl.rf_mult >= entry.rf_mult",
    "tp_dual_rr_range": "tp_dual.rr_mult between 0.5 and 5.0",
    "tp_rsi_rr_range": "tp_rsi.rr_mult between 0.5 and 5.0",
    "at_least_one_mode": "mode.showDualFlip or mode.showRSI",
    "tp_st_vs_sl_st": "tp_dual.st_atrPeriod <= sl.st_atrPeriod * 2",
}


def violations(rules: dict[str, str], blocks: list[str]) -> Column:
    """Names of the violated rules; a missing block is the only violation of its genome."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    out = broken
    for block in reversed([*blocks, "mode"]):
        out = F.when(F.col(block).isNull(), F.array(F.lit(f"missing {block}"))).otherwise(out)
    return out


def validated(genomes: DataFrame, rules: dict[str, str] = RULES, bounds: dict[str, dict] = BOUNDS) -> DataFrame:
    """Adds violations, n_violations and valid."""
    return genomes.withColumn("violations", violations(rules, list(bounds))).withColumn("n_violations", F.size("violations")).withColumn("valid", F.col("n_violations") == 0)


def repaired(genomes: DataFrame) -> DataFrame:
    """Genomes with the common faults mended, in this order: signal length, stops wider than entries, filter period,
    one mode on, ranges."""
    t = genomes.withColumn("entry", F.col("entry").withField("rsi_ma_length", F.when(F.col("entry.rsi_ma_length") > F.col("entry.rsi_length"), F.col("entry.rsi_length") - 2).otherwise(F.col("entry.rsi_ma_length"))))
    wider = F.col("sl").withField("st_mult", F.when(F.col("sl.st_mult") < F.col("entry.st_mult"), F.col("entry.st_mult") + 2).otherwise(F.col("sl.st_mult")))
    t = t.withColumn("sl", wider.withField("rf_mult", F.when(F.col("sl.rf_mult") < F.col("entry.rf_mult"), F.col("entry.rf_mult") + 3).otherwise(F.col("sl.rf_mult"))))
    t = t.withColumn("entry", F.col("entry").withField("rf_period", F.greatest("entry.rf_period", F.col("entry.st_atrPeriod") * 5)))
    t = t.withColumn("mode", F.col("mode").withField("showDualFlip", F.col("mode.showDualFlip") | ~F.col("mode.showRSI")))
    for block in ("tp_dual", "tp_rsi"):
        t = t.withColumn(block, F.col(block).withField("rr_mult", clamp(F.col(f"{block}.rr_mult"), 0.5, 5.0)))
    return t.withColumn("entry", F.col("entry").withField("st_mult", clamp(F.col("entry.st_mult"), 0.5, 5.0)).withField("rf_mult", clamp(F.col("entry.rf_mult"), 1.0, 10.0)))


def clamped(genomes: DataFrame, bounds: dict[str, dict] = BOUNDS) -> DataFrame:
    """Genomes with every number inside the bounds (block -> parameter -> lowest, highest), the caller's or BOUNDS."""
    for block, ps in bounds.items():
        value = F.col(block)
        for p, (lo, hi) in ps.items():
            value = value.withField(p, clamp(F.col(f"{block}.{p}"), lo, hi))
        genomes = genomes.withColumn(block, value)
    return genomes


MODES, COMBINED_MODES = ("showDualFlip", "showRSI"), ("showDualFlip", "showRSI", "enableLong", "enableShort")


def flat(genomes: DataFrame, bounds: dict[str, dict] = BOUNDS, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Nested -> flat columns block_param."""
    numbers = [F.col(f"{b}.{p}").alias(f"{b}_{p}") for b, ps in bounds.items() for p in ps]
    return genomes.select("genome_id", *numbers, *[F.col(f"mode.{m}").alias(f"mode_{m}") for m in modes])


def nested(params: DataFrame, bounds: dict[str, dict] = BOUNDS, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Flat columns block_param -> nested blocks; null parameters get the middle of their bounds."""
    blocks = [F.struct(*[F.coalesce(F.col(f"{b}_{p}"), F.lit((lo + hi) / 2).cast(params.schema[f"{b}_{p}"].dataType)).alias(p) for p, (lo, hi) in ps.items()]).alias(b) for b, ps in bounds.items()]
    mode = F.struct(*[F.coalesce(f"mode_{m}", F.lit(True)).alias(m) for m in modes]).alias("mode")
    return params.select("genome_id", *blocks, mode)


def long_form(genomes: DataFrame) -> DataFrame:
    """(genome_id, score, block, param, value), one row for each number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(p).alias("param"), F.col(f"{b}.{p}").cast("double").alias("value")) for b, p in NUMBERS])).alias("x")
    return genomes.select("genome_id", "score", pairs).select("genome_id", "score", "x.*")


def bounds_table(genomes: DataFrame) -> DataFrame:
    return genomes.sparkSession.createDataFrame([(b, p, float(lo), float(hi)) for b, ps in BOUNDS.items() for p, (lo, hi) in ps.items()], "block string, param string, lo double, hi double")


def expanded_bounds(genomes: DataFrame, margin: float = 0.1, share: float | None = None, floor: float = 0.5) -> DataFrame:
    """Bounds widened to what good genomes use, plus margin of the original range on the side that grows.

    Good ones have a score over 0; with `share` they are the best share of all genomes, and a widened lower bound stays at
    the floor."""
    good = genomes.filter("score > 0") if share is None else best_share(genomes, "score", share)
    used = long_form(good).groupBy("block", "param").agg(F.min("value").alias("used_lo"), F.max("value").alias("used_hi"))
    t = F.broadcast(bounds_table(genomes)).join(used, ["block", "param"], "left")
    pad = margin * (F.col("hi") - F.col("lo"))
    low = F.col("used_lo") - pad if share is None else F.greatest(F.lit(floor), F.col("used_lo") - pad)
    return t.select(
        "block", "param",
        F.round(F.when(F.col("used_lo") < F.col("lo"), low).otherwise(F.col("lo")), 6).alias("lo"),
        F.round(F.when(F.col("used_hi") > F.col("hi"), F.col("used_hi") + pad).otherwise(F.col("hi")), 6).alias("hi"),
    )


def promising_ranges(genomes: DataFrame, share: float = 0.2, least: int = 10, values: int = 3) -> DataFrame:
    """Range of each parameter among the best share of genomes, for `least` genomes and `values` values or more. The best
    share reaches to the score at rank int(n * share), ties included."""
    good = best_share(genomes, "score", share, least)
    ranges = F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"), F.count("*").alias("n")
    return long_form(good).groupBy("block", "param").agg(*ranges).filter(F.col("n") >= values)


def vector(genomes: DataFrame) -> DataFrame:
    """genome_id, score and vec: every number's place inside its bounds."""
    return genomes.select("genome_id", "score", F.array(*[(F.col(f"{b}.{p}").cast("double") - lo) / (hi - lo) for b, p in NUMBERS for lo, hi in [BOUNDS[b][p]]]).alias("vec"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, by the root of the number of dimensions, 1 at most."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.sqrt(squares / F.size(a)))


def sharing(distance: np.ndarray, sigma: float = 0.15) -> np.ndarray:
    """How much two genomes count as one."""
    return np.where(distance < sigma, 1 - (distance / sigma) ** 2, 0.0)


def niche_fitness(vectors: DataFrame, sigma: float = 0.15, per_block: int = blocks.PER_BLOCK) -> DataFrame:
    """score / niche count: the shared weights of all genomes within sigma, itself included.

    Equal vectors are one row with their number. The rows are dealt into blocks, and blocks meet where their boxes are
    within sigma; what leaves a task is a sum for each row that it saw, not pairs."""
    key = F.xxhash64(F.col("vec").cast("string"))
    same = vectors.groupBy("vec").agg(F.count("*").cast("double").alias("_w"))
    axes = blocks.EUCLIDEAN.directions(blocks.principal_axes(same, "vec", blocks.BOUNDED))
    dealt = blocks.in_blocks(blocks.with_places(same, "vec", axes), per_block)
    held = blocks.packed(dealt, ["vec", "_w"], "niche-blocks")
    near = (F.col("_a") == F.col("_b")) | (F.col("_a") < F.col("_b")) & blocks.reachable(sigma, blocks.EUCLIDEAN, min(blocks.BOUNDED, len(axes)))

    def shared(left, right, own):
        x, y, w, v = blocks.matrix(left["vec"]), blocks.matrix(right["vec"]), left["_w"].to_numpy(), right["_w"].to_numpy()
        i, j, d = blocks.EUCLIDEAN.near(x, y, sigma)
        weight = sharing(d, sigma)
        return np.bincount(i, weight * v[j], len(x)), None if own else np.bincount(j, weight * w[i], len(y))

    found = blocks.unpacked(held, blocks.meet(held, held, near, shared)).select("vec", F.col("_mark").alias("niche")).filter("niche > 0")
    keyed = found.select(key.alias("_key"), F.col("vec").alias("_vec"), "niche")
    out = vectors.withColumn("_key", key).join(keyed, "_key").filter(F.col("vec") == F.col("_vec"))
    return out.select("genome_id", F.round("niche", 6).alias("niche"), F.round(F.col("score") / F.col("niche"), 6).alias("shared"))


def crowding(vectors: DataFrame, per_bucket: int = 50_000) -> DataFrame:
    """Per genome the sum over dimensions of the gap between its neighbours, by the dimension's range; infinite at an end.

    Equal coordinates are one row with their first and last genome: those between have no gap. The distinct values of a
    dimension are cut at their quantiles into buckets, each sorted by itself, and the buckets' edges see each other; so
    neither a dimension nor a value that many genomes share is one task's."""
    t = vectors.select("genome_id", F.posexplode("vec").alias("dim", "x"))
    values = t.groupBy("dim", "x").agg(F.min("genome_id").alias("low"), F.max("genome_id").alias("high"), F.count("*").alias("n"))
    values = written(values, "crowding-values")
    buckets = max(1, -(-values.count() // (per_bucket * max(1, values.select("dim").distinct().count()))))
    spans = F.percentile_approx("x", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)
    cuts = values.groupBy("dim").agg(spans.alias("_cuts"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))  # a row per dimension
    dealt = values.join(F.broadcast(cuts), "dim").withColumn("bucket", F.size(F.filter("_cuts", lambda c: c < F.col("x"))) if buckets > 1 else F.lit(0))
    edges = dealt.groupBy("dim", "bucket").agg(F.min("x").alias("_first"), F.max("x").alias("_last"))
    by_bucket = W.partitionBy("dim").orderBy("bucket")  # a row per bucket
    edges = edges.select("dim", "bucket", F.lag("_last").over(by_bucket).alias("_left"), F.lead("_first").over(by_bucket).alias("_right"))
    by = W.partitionBy("dim", "bucket").orderBy("x")
    near = dealt.join(F.broadcast(edges), ["dim", "bucket"])
    near = near.withColumn("before", F.coalesce(F.lag("x").over(by), F.col("_left"))).withColumn("after", F.coalesce(F.lead("x").over(by), F.col("_right")))
    infinite = F.lit(float("inf"))
    left, right = F.coalesce(F.col("x") - F.col("before"), infinite), F.coalesce(F.col("after") - F.col("x"), infinite)
    ends = F.array(F.struct(F.col("low").alias("genome_id"), left.alias("gap")), F.struct(F.col("high").alias("genome_id"), right.alias("gap")))
    gaps = near.select(F.explode(ends).alias("e"), F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)).alias("range")).groupBy("e.genome_id").agg(F.sum(F.col("e.gap") / F.col("range")).alias("_gap"))
    return vectors.select("genome_id").join(gaps, "genome_id", "left").select("genome_id", F.round(F.coalesce("_gap", F.lit(0.0)), 6).alias("crowding"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled(ranges: DataFrame, n: int, seed: str = "ranges-1") -> DataFrame:
    """ranges (block, param, lo, hi; a row per parameter) -> n parameter sets drawn inside them, in long form."""
    t = ranges.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample_id"))
    u = uniform(F.lit(seed), F.col("sample_id"), F.col("block"), F.col("param"))
    return t.select("sample_id", "block", "param", F.round(F.col("lo") + u * (F.col("hi") - F.col("lo")), 4).alias("value"))


def widened(ranges: DataFrame, share: float = 0.2, least: float = 1.0, floor: float = 0.5) -> DataFrame:
    """Ranges grown on both sides by a share of their width, `least` at least, no lower than floor."""
    grow = F.greatest(F.lit(least), share * (F.col("hi") - F.col("lo")))
    return ranges.select("block", "param", F.round(F.greatest(F.lit(floor), F.col("lo") - grow), 6).alias("lo"), F.round(F.col("hi") + grow, 6).alias("hi"))


def mean_gap(a: Column, b: Column) -> Column:
    """Mean absolute difference of the coordinates, 1 at most."""
    gaps = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), gaps / F.size(a))


def both_distances(x: np.ndarray, _good: np.ndarray, q: np.ndarray, _fine: np.ndarray) -> list[np.ndarray]:
    """mean_gap and distance of every row of q from every row of x, to 6 places; 1 where a number is missing."""
    gaps, squares = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
    off = np.empty_like(gaps)
    for a, b in zip(q.T, x.T, strict=True):
        np.abs(np.subtract(a[:, None], b, out=off), out=off)
        gaps += off
        squares += np.multiply(off, off, out=off)
    dim = x.shape[1]
    return [blocks.rounded(np.fmin(1.0, d), 6) for d in (gaps / dim, np.sqrt(squares / dim))]


METRICS = {"mean": blocks.MEAN, "euclidean": blocks.EUCLIDEAN}
#: The greedy choice takes the best rows first: as many blocks of them, then GROWTH times as many, and so on.
WAVE, GROWTH = 10, 4


def _walked(apart: float, metric: blocks.Metric):
    """Settles what a block can settle by itself: (rows, how many better rows of others are near) -> rows with _kept."""

    def walk(rows, held):
        import pyarrow as pa

        order = np.argsort(rows["_order"].to_numpy())
        x, n = blocks.matrix(rows["vec"])[order], len(order)
        open_ = held[order] > 0  # a better row of another block may still reject it
        gone, kept = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(n):
            if gone[i]:
                continue
            near = np.flatnonzero(metric.rows(x[i + 1 :], x[i]) < apart) + i + 1
            kept[i] = not open_[i]
            (open_ if open_[i] else gone)[near] = True
        stay = np.flatnonzero(~gone)
        return rows.take(pa.array(order[stay])).append_column("_kept", pa.array(kept[stay]))

    return walk


def diverse(vectors: DataFrame, keep: int | None = None, apart: float = 0.15, by: str = "mean", per_block: int = blocks.PER_BLOCK, wave: int = WAVE) -> DataFrame:
    """Best first, the genomes that are `apart` from all kept before, up to keep (None: all of them).

    The greedy walk in waves: the best `wave` blocks of rows are settled first, those that they kept reject what is within
    reach of them among all others, then come the best of what is left. So most rows are only ever held against those that
    are kept. Only numbers of rows reach the driver. genome_id is unique; a null score, or one that is no number, ranks last."""
    metric = METRICS[by]
    rank = F.when(~F.isnan("score"), F.col("score").cast("double"))
    ranked = vectors.select("genome_id", "score", F.coalesce(rank, F.lit(float("-inf"))).alias("_rank"), F.col("vec").cast("array<double>").alias("vec"))
    axes = metric.directions(blocks.principal_axes(ranked, "vec", blocks.BOUNDED))
    near = blocks.reachable(apart, metric, min(blocks.BOUNDED, len(axes)))
    ordered = blocks.with_places(ranked, "vec", axes).orderBy(F.desc("_rank"), "genome_id").withColumn("_order", F.monotonically_increasing_id())
    rest = blocks.in_blocks(ordered, per_block)
    parts = sorted((r["part"], r["n"]) for r in rest.groupBy(F.shiftright("_order", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each sorted part
    n, at, size = sum(k for _, k in parts), 0, wave * per_block
    chosen: list[DataFrame] = []
    while at < n:
        at, size = at + size, size * GROWTH
        if at >= n:
            chosen.append(_settled(rest, near, apart, metric, per_block))
            break
        best = F.col("_order") < _place(parts, at)
        first = blocks.in_blocks(rest.filter(best).drop("_slice", "_block"), per_block)
        new = _settled(first, near, apart, metric, per_block)
        chosen.append(new)
        rest = written(_not_near(new, rest.filter(~best), near, apart, metric), "diverse-rest")
    if not chosen:
        return vectors.select("genome_id", "score").limit(0)
    found = functools.reduce(DataFrame.unionByName, [c.select("genome_id", "score", "_order") for c in chosen])
    if keep is not None:
        found = found.orderBy("_order").limit(keep)
    return found.select("genome_id", "score")


def _place(parts: list[tuple[int, int]], at: int) -> int:
    """The _order of row number `at` of rows in sorted parts (number, rows)."""
    for part, n in parts:
        if at < n:
            return (part << 33) + at
        at -= n
    raise ValueError("no such row")


def _settled(left: DataFrame, near: Column, apart: float, metric: blocks.Metric, per_block: int) -> DataFrame:
    """The rows of left (in blocks) that the walk along _order keeps, in parallel rounds: a row is kept once no undecided
    row within reach is better, and rejects those within reach of it.

    Blocks tell each other which rows have a better undecided neighbour elsewhere; each block walks the rest by itself; rows
    that the newly kept reject go, and what is left begins again, written. A chain of rows that hold each other back is as
    long as the logarithm of the rows where ranks don't follow places."""
    chosen: list[DataFrame] = []
    while True:
        held = blocks.packed(left, ["vec", "_order"], "diverse-blocks")
        back = blocks.meet(held, held, (F.col("_a") < F.col("_b")) & near, _held_back(apart, metric))
        schema = T.StructType([*held.schema.fields, T.StructField("_kept", T.BooleanType())])
        states = written(blocks.unpacked(held, back, _walked(apart, metric), schema), "diverse-states")
        new, rest = (states.filter(c).select(*left.columns) for c in ("_kept", "not _kept"))
        chosen.append(new)
        if rest.isEmpty():
            return functools.reduce(DataFrame.unionByName, chosen)
        left = written(_not_near(new, rest, near, apart, metric), "diverse-left")
        if left.count() <= per_block:  # what is left fits one block, which walks it to the end
            left = left.withColumn("_block", F.lit(0).cast("long")).withColumn("_slice", F.lit(0))


def _not_near(new: DataFrame, rest: DataFrame, near: Column, apart: float, metric: blocks.Metric) -> DataFrame:
    """The rows of rest with none of new within reach, both in blocks."""
    held = blocks.packed(rest, ["vec"], "diverse-rest")
    hit = blocks.meet(blocks.packed(new, ["vec"], "diverse-new"), held, near, _rejected(apart, metric))
    return blocks.unpacked(held, hit).filter("_mark = 0").select(*rest.columns)


def _held_back(apart: float, metric: blocks.Metric):
    """Marks rows of either block that have a better row of the other within reach."""

    def work(left, right, own):
        i, j, _ = metric.near(blocks.matrix(left["vec"]), blocks.matrix(right["vec"]), apart)
        worse = left["_order"].to_numpy()[i] > right["_order"].to_numpy()[j]
        return np.bincount(i[worse], minlength=len(left)), np.bincount(j[~worse], minlength=len(right))

    return work


def _rejected(apart: float, metric: blocks.Metric):
    def work(new, rest, own):
        _, j, _ = metric.near(blocks.matrix(new["vec"]), blocks.matrix(rest["vec"]), apart)
        return None, np.bincount(j, minlength=len(rest))

    return work


def elites(crowded: DataFrame, n: int) -> DataFrame:
    """crowded (genome_id, score, crowding) -> the n best by 0.8 of the score and 0.2 of the crowding (10 at most, in
    tenths; infinite is 1) times the best score. All where there are no more than n."""
    top = crowded.agg(F.max("score").alias("_top"))
    share = F.least(F.lit(1.0), F.col("crowding") / 10)
    value = F.round(F.col("score") * 0.8 + share * 0.2 * F.col("_top"), 6)
    t = crowded.filter("score is not null").crossJoin(F.broadcast(top)).withColumn("value", value)  # one row
    return t.orderBy(F.desc("value"), "genome_id").limit(n).drop("_top")


# ---- the long and short strategy's parameter sets --------------------------------------------------------------------

#: Bounds of every number, by block and parameter.
_STOP = {"st_atrPeriod": (1, 30), "st_mult": (1.0, 30.0), "rf_period": (1, 200), "rf_mult": (1.0, 30.0)}
_GOAL = {"st_atrPeriod": (1, 30), "st_mult": (1.0, 30.0), "rr_mult": (0.1, 5.0)}
COMBINED_BOUNDS = {
    "entry": {"st_atrPeriod": (1, 50), "st_mult": (0.5, 30.0), "rf_period": (1, 200), "rf_mult": (1.0, 30.0), "rsi_length": (5, 30), "rsi_ma_length": (2, 20), "dualFlipBarsLong": (1, 30), "dualFlipBarsShort": (1, 30)},
    "sl_long": _STOP, "sl_short": _STOP, "tp_dual_long": _GOAL, "tp_dual_short": _GOAL, "tp_rsi_long": _GOAL, "tp_rsi_short": _GOAL,
}
#: Coherence rules.
COMBINED_RULES = {
    "rsi_ma_vs_rsi_length": "entry.rsi_ma_length <= entry.rsi_length",
    "st_mult_range": "entry.st_mult between 0.5 and 30.0",
    "rf_mult_range": "entry.rf_mult between 1.0 and 30.0",
    **{f"{b}_rr_range": f"{b}.rr_mult between 0.1 and 5.0" for b in ("tp_dual_long", "tp_rsi_long", "tp_dual_short", "tp_rsi_short")},
    "at_least_one_mode": "mode.showDualFlip or mode.showRSI",
    "at_least_one_position_type": "mode.enableLong or mode.enableShort",
}


def combined_repaired(genomes: DataFrame) -> DataFrame:
    """Signal length, one mode and one side on, then every number inside its bounds."""
    entry, mode = F.col("entry"), F.col("mode")
    shorter = F.when(entry["rsi_ma_length"] > entry["rsi_length"], entry["rsi_length"] - 2).otherwise(entry["rsi_ma_length"])
    t = genomes.withColumn("entry", entry.withField("rsi_ma_length", shorter))
    neither = ~mode["enableLong"] & ~mode["enableShort"]
    on = mode.withField("showDualFlip", mode["showDualFlip"] | ~mode["showRSI"]).withField("enableLong", mode["enableLong"] | neither)
    return clamped(t.withColumn("mode", on.withField("enableShort", mode["enableShort"] | neither)), COMBINED_BOUNDS)


#: Ratios that a set has to keep; the last one is a difference.
RATIOS = {"sl_period": (0.1, 10.0), "sl_mult": (0.2, 15.0), "rr_min": 0.02, "tp_period": 8.0, "sides": 25.0}


def ratio_violations(sides: tuple[str, ...] = ("",)) -> Column:
    """Names of the violated ratios: sides are the suffixes of the blocks ('' for the long strategy, '_long', '_short')."""
    c = F.col
    period, mult = c("entry.st_atrPeriod"), c("entry.st_mult")
    checks = {"rsi_ma": c("entry.rsi_ma_length") >= c("entry.rsi_length")}
    for s in sides:
        stop, dual, rsi = f"sl{s}", f"tp_dual{s}", f"tp_rsi{s}"
        low, high = (c(f"{stop}.st_atrPeriod") < period * RATIOS["sl_period"][0]), (c(f"{stop}.st_atrPeriod") > period * RATIOS["sl_period"][1])
        least = c(f"{stop}.st_mult") * RATIOS["rr_min"]
        if s:
            checks |= {f"sl_period_fast{s}": low, f"sl_period_slow{s}": high, f"sl_mult_tight{s}": c(f"{stop}.st_mult") < mult * RATIOS["sl_mult"][0], f"sl_mult_wide{s}": c(f"{stop}.st_mult") > mult * RATIOS["sl_mult"][1]}
            checks |= {f"rr_dual{s}": c(f"{dual}.rr_mult") < least, f"rr_rsi{s}": c(f"{rsi}.rr_mult") < least}
            checks |= {f"tp_{k}{s}": c(f"{b}.st_atrPeriod") > period * RATIOS["tp_period"] for k, b in (("dual", dual), ("rsi", rsi))}
        else:
            checks |= {"sl_period": low | high, "rr": (c(f"{dual}.rr_mult") < least) | (c(f"{rsi}.rr_mult") < least)}
    if len(sides) == 2:
        a, b = (c(f"sl{s}.st_mult") for s in sides)
        checks["sides"] = F.abs(a - b) > RATIOS["sides"]
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


# ---- ranges from outside: a configuration's, a regime's --------------------------------------------------------------


def configured_bounds(ranges: DataFrame, bounds: dict[str, dict] = BOUNDS, floor: float = 0.5) -> DataFrame:
    """ranges (block, param, start, end; in either order) -> block, param, lo, hi of every parameter: grown on both sides
    where a range is given, the default bounds where none is."""
    given = ranges.filter("start is not null and end is not null").select("block", "param", F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"))
    return _over_defaults(widened(given, floor=floor), bounds)


def merged_bounds(values: DataFrame, bounds: dict[str, dict] = BOUNDS) -> DataFrame:
    """values (block, param, given: array of numbers) -> bounds: the smallest and largest number given, else the default."""
    return _over_defaults(values.filter("size(given) > 0").select("block", "param", F.array_min("given").alias("lo"), F.array_max("given").alias("hi")), bounds)


def _over_defaults(given: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    rows = [(b, p, float(lo), float(hi)) for b, ps in bounds.items() for p, (lo, hi) in ps.items()]
    base = given.sparkSession.createDataFrame(rows, "block string, param string, lo double, hi double")
    own = given.select("block", "param", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return base.join(own, ["block", "param"], "left").select("block", "param", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi"))


#: What each market regime suggests, and what holds in all of them.
REGIME_RANGES = {
    "trending_up": {"entry": {"rf_period": (100, 150), "st_mult": (1.5, 2.5), "rf_mult": (2.5, 4.0)}, "sl": {"st_mult": (3.0, 5.0), "rf_mult": (5.0, 8.0)}, "tp_dual": {"rr_mult": (1.5, 2.5)}, "tp_rsi": {"rr_mult": (1.5, 2.5)}},
    "trending_down": {"entry": {"rf_period": (100, 150), "st_mult": (1.5, 2.5), "rf_mult": (2.5, 4.0)}, "sl": {"st_mult": (3.0, 5.0), "rf_mult": (5.0, 8.0)}, "tp_dual": {"rr_mult": (1.0, 1.5)}, "tp_rsi": {"rr_mult": (1.0, 1.5)}},
    "ranging": {"entry": {"rf_period": (60, 100), "st_mult": (2.5, 3.5), "rf_mult": (3.0, 5.0)}, "sl": {"st_mult": (4.0, 6.0), "rf_mult": (6.0, 10.0)}, "tp_dual": {"rr_mult": (1.0, 1.3)}, "tp_rsi": {"rr_mult": (1.0, 1.3)}},
    "volatile": {"entry": {"rf_period": (80, 120), "st_mult": (3.0, 4.0), "rf_mult": (4.0, 6.0)}, "sl": {"st_mult": (5.0, 8.0), "rf_mult": (8.0, 12.0)}, "tp_dual": {"rr_mult": (2.0, 3.0)}, "tp_rsi": {"rr_mult": (2.0, 3.0)}},
    "low_volatility": {"entry": {"rf_period": (50, 80), "st_mult": (1.0, 2.0), "rf_mult": (2.0, 3.5)}, "sl": {"st_mult": (2.5, 4.0), "rf_mult": (4.0, 6.0)}, "tp_dual": {"rr_mult": (0.8, 1.2)}, "tp_rsi": {"rr_mult": (0.8, 1.2)}},
}
COMMON_RANGES = {"entry": {"st_atrPeriod": (8, 16), "rsi_length": (10, 18), "rsi_ma_length": (4, 8)}}
WHOLE = ("rf_period", "st_atrPeriod", "rsi_length", "rsi_ma_length")


def regime_samples(regimes: DataFrame, n: int, seed: str = "regimes-1") -> DataFrame:
    """regimes (symbol, timeframe, regime) -> n parameter sets for each, inside its regime's ranges, in long form; periods
    are whole numbers. The table of ranges has some dozens of rows."""
    rows = [(r, b, p, float(lo), float(hi)) for r, blocks in REGIME_RANGES.items() for part in (blocks, COMMON_RANGES) for b, ps in part.items() for p, (lo, hi) in ps.items()]
    table = regimes.sparkSession.createDataFrame(rows, "regime string, block string, param string, lo double, hi double")
    t = regimes.join(F.broadcast(table), "regime").select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample_id"))
    u = uniform(F.lit(seed), F.col("symbol"), F.col("timeframe"), F.col("sample_id"), F.col("block"), F.col("param"))
    value = F.col("lo") + u * (F.col("hi") - F.col("lo"))
    return t.select("symbol", "timeframe", "regime", "sample_id", "block", "param", F.when(F.col("param").isin(*WHOLE), F.floor(value).cast("double")).otherwise(F.round(value, 2)).alias("value"))
