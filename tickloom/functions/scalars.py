"""Column functions: scores, hashes, times, timeframes, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strategy_score(pf: Column, winrate: Column, smooth: Column, dd_pct: Column) -> Column:
    return F.round(F.least(pf, F.lit(100.0)) * 2 + winrate / 100 + smooth - dd_pct / 100, 4)


def rank_score(net: Column, pf: Column, winrate: Column, dd_pct: Column) -> Column:
    return F.round(net * 0.4 + pf * 30 + winrate * 0.2 - dd_pct * 0.3, 2)


def legacy_brain_score(pf: Column, winrate: Column, smooth: Column, dd_pct: Column, streak: Column, ulcer: Column) -> Column:
    return F.least(pf, F.lit(5.0)) * winrate * smooth / (F.greatest(dd_pct, F.lit(1.0)) * F.greatest(streak, F.lit(1)) * F.greatest(ulcer, F.lit(0.1))) * 1000


def fast_score(net: Column, dd_pct: Column) -> Column:
    return F.when(net > 0, net / F.greatest(dd_pct, F.lit(1.0))).otherwise(0.0)


def scaled(v: Column, in_min: float, in_max: float, out_min: float = 0.0, out_max: float = 100.0) -> Column:
    """v's place between in_min and in_max, clamped, between out_min and out_max; in_min may be the larger one."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - in_min) / (in_max - in_min)))
    return out_min + share * (out_max - out_min)


#: Weights of the brain score's components.
BRAIN_WEIGHTS = {"profitability": 0.4, "risk": 0.3, "consistency": 0.2, "significance": 0.1}


def brain_score(runs: DataFrame, terms: dict[str, list[tuple[float, str, float, float]]], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds each component (a sum of weighted, scaled columns: weight, column, worst, best) and brain_score."""
    parts = {name: sum((w * scaled(F.col(c), a, b) for w, c, a, b in own), F.lit(0.0)) for name, own in terms.items()}
    total = sum((w * parts[name] for name, w in (weights or BRAIN_WEIGHTS).items()), F.lit(0.0))
    return runs.select("*", *[F.round(x, 4).alias(name) for name, x in parts.items()], F.round(total, 4).alias("brain_score"))


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def genome_hash(genome: Column) -> Column:
    """Hash of a struct's JSON, its fields being in alphabetical order."""
    return short_hash(F.to_json(genome))


def local_time(ts: Column) -> Column:
    """The time at UTC+7 as a string."""
    return F.date_format(ts + F.expr("interval 7 hours"), "yyyy-MM-dd HH:mm:ss")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))


def timeframe_minutes(tf: Column) -> Column:
    """Minutes of "15m", "1h", "4h", "1d" or "1w"; 60 for anything else."""
    n = F.regexp_extract(tf, r"^([0-9]+)[mhdw]$", 1)
    unit = F.when(tf.endswith("m"), 1).when(tf.endswith("h"), 60).when(tf.endswith("d"), 1440).when(tf.endswith("w"), 10080)
    return F.when(n != "", F.when(n != "", n).otherwise("0").cast("int") * unit).otherwise(60)


def tick_size(close: Column) -> Column:
    """10 to the power of minus the number of decimals of a price; 1 for whole prices."""
    decimals = F.length(F.regexp_extract(F.rtrim(F.format_string("%.8f", close), F.lit("0")), r"\.([0-9]*)$", 1))
    return F.pow(F.lit(10.0), -decimals)


def fee_rate(kind: Column, value: Column) -> Column:
    return F.when(kind == "percent", value / 100).otherwise(value)


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles, by 0 infinite with the sign of a, and not a number where a is 0 too."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def clamp(v: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.greatest(lo if isinstance(lo, Column) else F.lit(lo), F.least(hi if isinstance(hi, Column) else F.lit(hi), v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)
