"""The exact value at a rank of a column of any length, by histograms that narrow to one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def value_at_rank(df: DataFrame, value: Column, rank: int, buckets: int = BUCKETS) -> float | None:
    """The value at place `rank` (from 0) of the falling values; null where there are not so many. Null values don't count,
    NaN is above all.

    Each round cuts the values between two bounds at some `buckets` of them, evenly spread by rank as far as a sketch
    tells, counts those between and at the cuts exactly (a few numbers a task leave for the driver), and goes on in the
    part that holds the rank, until that is one value. A round leaves about one part in `buckets` of the rows, and a value
    that many rows share is a part of its own as soon as it is a cut."""
    t = df.select(value.cast("double").alias("v")).filter("v is not null")
    ends = t.agg(F.count_if(F.isnan("v")).alias("nan"), F.count_if(~F.isnan("v")).alias("n"), F.min(F.when(F.abs("v") < float("inf"), F.col("v"))).alias("lo"), F.max(F.when(F.abs("v") < float("inf"), F.col("v"))).alias("hi"),
                 F.count_if(F.col("v") == float("inf")).alias("top"), F.count_if(F.col("v") == float("-inf")).alias("low")).first()
    if not 0 <= rank < ends["nan"] + ends["n"]:
        return None
    for name, at in (("nan", float("nan")), ("top", float("inf"))):
        if rank < ends[name]:
            return at
        rank -= ends[name]
    if rank >= ends["n"] - ends["top"] - ends["low"]:
        return float("-inf")
    lo, hi = ends["lo"], ends["hi"]
    while lo < hi:
        inside = t.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        cuts = inside.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 1000).alias("c")).first()["c"]
        edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
        part = 2 * F.size(F.filter(edges, lambda c: c < F.col("v"))) + F.array_contains(edges, F.col("v")).cast("int")
        for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(F.desc("part")).collect():
            if rank < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def best_share(df: DataFrame, score: str, share: float, least: int = 0) -> DataFrame:
    """Rows whose score is that at rank int(n * share) of the falling scores or better, ties included; none where there
    are fewer than `least` rows with a score."""
    n = df.filter(F.col(score).isNotNull()).count()
    cut = value_at_rank(df, F.col(score), int(n * share)) if n >= max(1, least) else None
    return df.filter(F.lit(False)) if cut is None else df.filter(F.col(score) >= cut)
