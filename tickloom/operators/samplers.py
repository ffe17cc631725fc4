"""Parameter sets drawn with dependence: stops from the drawn entry, targets from the drawn stop; or by trading style.

Every draw is a hash of the seed, the set's number, block and parameter, so a set is the same wherever it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.genomes import COMBINED_BOUNDS, RATIOS, WHOLE, uniform

#: Ranges of the entry by sensitivity, of stops' and targets' multiples by risk.
SENSITIVITY = {
    "fast": {"st_atrPeriod": (1, 30), "st_mult": (0.5, 8.0), "rf_period": (1, 150), "rf_mult": (1.0, 10.0)},
    "medium": {"st_atrPeriod": (1, 50), "st_mult": (0.5, 10.0), "rf_period": (1, 200), "rf_mult": (1.0, 10.0)},
    "slow": {"st_atrPeriod": (10, 50), "st_mult": (2.0, 10.0), "rf_period": (50, 200), "rf_mult": (2.0, 10.0)},
}
RISK = {
    "aggressive": {"sl": (0.5, 10.0), "rr": (1.0, 5.0)}, "balanced": {"sl": (1.0, 15.0), "rr": (0.5, 5.0)}, "conservative": {"sl": (3.0, 20.0), "rr": (0.2, 3.0)},
}
#: A target's multiple is no more than this times the stop's; ranges of the signal lengths.
RR_MOST = 5.0
RSI_LENGTH, RSI_MEAN = (5, 20), (2, 15)
#: Ranges by trading style.
ARCHETYPES = {
    "scalper": {
        "entry": {"st_atrPeriod": (1, 15), "st_mult": (0.5, 3.0), "rf_period": (1, 60), "rf_mult": (1.0, 4.0), "rsi_length": (5, 12), "rsi_ma_length": (2, 6)},
        "sl": {"st_atrPeriod": (1, 15), "st_mult": (1.0, 5.0), "rf_period": (1, 80), "rf_mult": (1.0, 6.0)}, "tp": {"st_atrPeriod": (1, 15), "st_mult": (0.5, 4.0), "rr_mult": (1.5, 5.0)},
    },
    "swing_trader": {
        "entry": {"st_atrPeriod": (10, 30), "st_mult": (2.0, 6.0), "rf_period": (50, 150), "rf_mult": (2.0, 7.0), "rsi_length": (10, 16), "rsi_ma_length": (4, 9)},
        "sl": {"st_atrPeriod": (8, 35), "st_mult": (3.0, 10.0), "rf_period": (40, 160), "rf_mult": (3.0, 12.0)}, "tp": {"st_atrPeriod": (8, 30), "st_mult": (2.0, 8.0), "rr_mult": (1.0, 3.5)},
    },
    "trend_follower": {
        "entry": {"st_atrPeriod": (20, 50), "st_mult": (4.0, 10.0), "rf_period": (100, 200), "rf_mult": (4.0, 10.0), "rsi_length": (14, 20), "rsi_ma_length": (6, 12)},
        "sl": {"st_atrPeriod": (15, 50), "st_mult": (6.0, 20.0), "rf_period": (80, 200), "rf_mult": (6.0, 20.0)}, "tp": {"st_atrPeriod": (15, 50), "st_mult": (4.0, 15.0), "rr_mult": (2.0, 5.0)},
    },
    "mean_reverter": {
        "entry": {"st_atrPeriod": (3, 20), "st_mult": (1.0, 5.0), "rf_period": (20, 100), "rf_mult": (1.5, 6.0), "rsi_length": (5, 14), "rsi_ma_length": (2, 7)},
        "sl": {"st_atrPeriod": (3, 25), "st_mult": (2.0, 8.0), "rf_period": (20, 120), "rf_mult": (2.0, 10.0)}, "tp": {"st_atrPeriod": (3, 20), "st_mult": (1.5, 6.0), "rr_mult": (0.8, 3.0)},
    },
}
SIDES, GOALS = ("long", "short"), ("tp_dual", "tp_rsi")


def _draw(seed: str, block: str, param: str) -> Column:
    return uniform(F.lit(seed), F.col("sample_id"), F.lit(block), F.lit(param))


def _pick(names: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(u * len(names)) + 1).cast("int"))


def _whole(lo: Column, hi: Column, u: Column) -> Column:
    """A whole number from lo to hi, both included."""
    return (lo + F.least(F.floor(u * (hi - lo + 1)), hi - lo)).cast("int")


def _real(lo: Column, hi: Column, u: Column) -> Column:
    return F.round(lo + u * (hi - lo), 2)


def _of(column: str, table: dict[str, tuple[float, float]], end: int) -> Column:
    """The end (0 low, 1 high) of the range that the column's value names."""
    out = F.lit(None).cast("double")
    for name, span in table.items():
        out = F.when(F.col(column) == name, float(span[end])).otherwise(out)
    return out


def _inside(lo: Column, hi: Column, outer: tuple[float, float], other: tuple[Column, Column]) -> tuple[Column, Column]:
    """The part of lo .. hi inside outer; `other` where there is none."""
    a, b = F.greatest(lo, F.lit(float(outer[0]))), F.least(hi, F.lit(float(outer[1])))
    return F.when(a > b, other[0]).otherwise(a), F.when(a > b, other[1]).otherwise(b)


def _ends(span: tuple[float, float]) -> tuple[Column, Column]:
    return F.lit(float(span[0])), F.lit(float(span[1]))


def _ints(lo: Column, hi: Column) -> tuple[Column, Column]:
    return F.floor(lo), F.floor(hi)


def _drawn(t: DataFrame, made: dict[str, Column]) -> DataFrame:
    """t and the columns made, each worked out once: later draws that depend on them don't repeat their expressions."""
    return t.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def correlated(spark: SparkSession, n: int, bounds: dict[str, dict] = COMBINED_BOUNDS, seed: str = "correlated-1") -> DataFrame:
    """n sets: sample_id, sensitivity, risk and a column for each block_param.

    Sensitivity and risk are drawn first. The entry lies inside its sensitivity's ranges and the bounds; a stop's period
    and multiple inside what the drawn entry's ratios, the risk and the bounds leave; a target's multiple inside what the
    drawn stop, the risk and the bounds leave. Where nothing is left, the entry takes its sensitivity's range, stops and
    targets the bounds."""
    t = spark.range(1, n + 1).select(F.col("id").alias("sample_id"))
    t = _drawn(t, {"sensitivity": _pick(list(SENSITIVITY), _draw(seed, "meta", "sensitivity")), "risk": _pick(list(RISK), _draw(seed, "meta", "risk"))})
    entry = bounds["entry"]
    made = {}
    for p in ("st_atrPeriod", "st_mult", "rf_period", "rf_mult"):
        own = tuple(_of("sensitivity", {k: v[p] for k, v in SENSITIVITY.items()}, e) for e in (0, 1))
        lo, hi = _inside(*own, entry[p], own)
        made[f"entry_{p}"] = _whole(*_ints(lo, hi), _draw(seed, "entry", p)) if p in WHOLE else _real(lo, hi, _draw(seed, "entry", p))
    made["entry_rsi_length"] = _whole(*_ints(*_inside(*_ends(RSI_LENGTH), entry["rsi_length"], _ends(RSI_LENGTH))), _draw(seed, "entry", "rsi_length"))
    t = _drawn(t, made)
    least = max(2, entry["rsi_ma_length"][0])
    most = F.greatest(F.lit(least), F.least(F.col("entry_rsi_length") - 2, F.lit(entry["rsi_ma_length"][1])))
    t = _drawn(t, {"entry_rsi_ma_length": _whole(F.lit(least), most, _draw(seed, "entry", "rsi_ma_length"))})
    for s in SIDES:
        b, own = f"sl_{s}", bounds[f"sl_{s}"]
        period, mult = F.col("entry_st_atrPeriod"), F.col("entry_st_mult")
        spans = _ints(*_inside(F.floor(period * RATIOS["sl_period"][0]), F.floor(period * RATIOS["sl_period"][1]), own["st_atrPeriod"], _ends(own["st_atrPeriod"])))
        risk = [_of("risk", {k: v["sl"] for k, v in RISK.items()}, e) for e in (0, 1)]
        tight = F.greatest(risk[0], mult * RATIOS["sl_mult"][0]), F.least(risk[1], mult * RATIOS["sl_mult"][1])
        t = _drawn(t, {
            f"{b}_st_atrPeriod": _whole(*spans, _draw(seed, b, "st_atrPeriod")), f"{b}_st_mult": _real(*_inside(*tight, own["st_mult"], _ends(own["st_mult"])), _draw(seed, b, "st_mult")),
            f"{b}_rf_period": _whole(*_ints(*_ends(own["rf_period"])), _draw(seed, b, "rf_period")), f"{b}_rf_mult": _real(*_ends(own["rf_mult"]), _draw(seed, b, "rf_mult")),
        })
        for g in GOALS:
            b, own, stop = f"{g}_{s}", bounds[f"{g}_{s}"], F.col(f"sl_{s}_st_mult")
            risk = [_of("risk", {k: v["rr"] for k, v in RISK.items()}, e) for e in (0, 1)]
            reward = F.greatest(risk[0], stop * RATIOS["rr_min"]), F.least(risk[1], stop * RR_MOST)
            t = _drawn(t, {
                f"{b}_st_atrPeriod": _whole(*_ints(*_ends(own["st_atrPeriod"])), _draw(seed, b, "st_atrPeriod")), f"{b}_st_mult": _real(*_ends(own["st_mult"]), _draw(seed, b, "st_mult")),
                f"{b}_rr_mult": _real(*_inside(*reward, own["rr_mult"], _ends(own["rr_mult"])), _draw(seed, b, "rr_mult")),
            })
    return t


def by_archetype(spark: SparkSession, n: int, bounds: dict[str, dict] = COMBINED_BOUNDS, mixed: float = 0.5, seed: str = "archetype-1") -> DataFrame:
    """n sets: sample_id, the styles of entry, stops and targets, and a column for each block_param.

    A share `mixed` of the sets takes each part from a style of its own, the others all from one. Ranges lie inside the
    bounds where they can. The signal's mean is shorter than the signal."""
    names = list(ARCHETYPES)
    t = spark.range(1, n + 1).select(F.col("id").alias("sample_id"))
    cross = _draw(seed, "meta", "mixed") < mixed
    t = _drawn(t, {f"{part}_style": _pick(names, F.when(cross, _draw(seed, "meta", part)).otherwise(_draw(seed, "meta", "all"))) for part in ("entry", "sl", "tp")})
    made = {}
    for block, own in bounds.items():
        part = block.split("_")[0]
        for p in ARCHETYPES["scalper"][part]:
            span = tuple(_of(f"{part}_style", {k: v[part][p] for k, v in ARCHETYPES.items()}, e) for e in (0, 1))
            lo, hi = _inside(*span, own.get(p, (float("-inf"), float("inf"))), span)
            made[f"{block}_{p}"] = _whole(*_ints(lo, hi), _draw(seed, block, p)) if p in WHOLE else _real(lo, hi, _draw(seed, block, p))
    t = _drawn(t, made)
    shorter = F.when(F.col("entry_rsi_ma_length") >= F.col("entry_rsi_length"), F.greatest(F.lit(2), F.col("entry_rsi_length") - 2)).otherwise(F.col("entry_rsi_ma_length"))
    return t.withColumn("entry_rsi_ma_length", shorter)
