"""Recurrences over series of any length: a series is cut into chunks of time, and chunks are separate tasks.

Linear ones are an associative scan: a chunk takes the state before it to the state after it by an affine map, the maps
of a series (one small row for each chunk) are applied in order, and a second pass works out the values. The others are
stitched: chunks are walked from a guess, each again from what the chunk before it left, until nothing changes; states
that forget where they began settle after a round or two, and a series that doesn't is walked as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import epoch_seconds
from tickloom.operators import recurrence as rec
from tickloom.sources.shared import written

KEYS = rec.KEYS
AT = (*KEYS, "_chunk")
#: What a chunk knows: bars of its series before it, the last bar's close before it, and the state before it.
Kernel = Callable[[pd.DataFrame, int, float, np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]]
#: Bars that are worked out at once.
BLOCK = 64
#: Rounds after which series that still change are walked as a whole.
ROUNDS = 8


def carried(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """y[i] = keep * y[i - 1] + x[i] with y[-1] = start, BLOCK values at a time."""
    n = len(x)
    padded = np.zeros(-(-n // BLOCK) * BLOCK)
    padded[:n] = x
    power = keep ** np.arange(BLOCK + 1)
    gap = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    out = padded.reshape(-1, BLOCK) @ np.where(gap >= 0, power[np.maximum(gap, 0)], 0.0).T
    for row in out:
        row += power[1:] * start
        start = row[-1]
    return out.ravel()[:n]


def mean_from(x: np.ndarray, alpha: float, before: int, start: float) -> tuple[np.ndarray, float]:
    """An exponential mean that began at the series' first value, of which `before` are known and start is the last mean."""
    if before == 0 and len(x):
        out = np.concatenate([x[:1], carried(alpha * x[1:], 1 - alpha, x[0])])
    else:
        out = carried(alpha * x, 1 - alpha, start)
    return out, out[-1] if len(out) else start


def seeded_from(x: np.ndarray, n: int, alpha: float, before: int, start: float) -> tuple[np.ndarray, float]:
    """An exponential mean that begins with the mean of the series' first n values at the n-th one; until then the state is
    their sum, and the values are null."""
    out = np.full(len(x), np.nan)
    head = max(0, min(len(x), n - before))
    y = start + x[:head].sum()
    if head and before + head == n:
        out[head - 1] = y = y / n
    if head < len(x):
        out[head:] = carried(alpha * x[head:], 1 - alpha, y)
        y = out[-1]
    return out, y


def chunks(bars: DataFrame, seconds: int) -> DataFrame:
    """bars with _chunk (spans of `seconds`), _before (bars of the series in earlier chunks) and _last (the close before
    the chunk), written. What is ordered over a whole series has a row for each chunk."""
    t = bars.withColumn("_chunk", F.floor(epoch_seconds(F.col("time").cast("timestamp_ntz")) / seconds))
    facts = t.groupBy(*AT).agg(F.count("*").alias("_n"), F.max_by("close", "time").alias("_close"))
    by = W.partitionBy(*KEYS).orderBy("_chunk")
    before = F.coalesce(F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    facts = facts.select(*AT, before.alias("_before"), F.coalesce(F.lag("_close").over(by), F.lit(float("nan"))).alias("_last"))
    return written(t.join(facts, list(AT)), "scan-chunks")


def _ordered(frame: pd.DataFrame) -> tuple[pd.DataFrame, int, float]:
    frame = frame.sort_values("time", kind="stable").reset_index(drop=True)
    return frame, int(frame["_before"].iloc[0]), float(frame["_last"].iloc[0])


def _row(frame: pd.DataFrame, **more) -> pd.DataFrame:
    return pd.DataFrame([{c: frame[c].iloc[0] for c in AT} | more])


def _with_columns(held: DataFrame, bars: DataFrame, columns: dict[str, str], make: Callable) -> DataFrame:
    """held in chunks -> the columns of bars and those that make gives."""
    schema = T.StructType([*bars.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in columns.items())).fields])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, before, last = _ordered(frame)
        return frame.assign(**make(frame, before, last))[[f.name for f in schema.fields]]

    return held.groupBy(*AT).applyInPandas(run, schema)


def affine(bars: DataFrame, kernel: Kernel, dim: int, columns: dict[str, str], seconds: int) -> DataFrame:
    """bars and the columns of a kernel whose end state is an affine function of its `dim` start numbers.

    A chunk's map is found by running the kernel from zero and from one in each place."""
    held = chunks(bars, seconds)
    fields = ", ".join([f"{k} string" for k in KEYS] + ["_chunk long"])

    def maps(frame: pd.DataFrame) -> pd.DataFrame:
        frame, before, last = _ordered(frame)
        ends = [kernel(frame, before, last, start)[1] for start in (np.zeros(dim), *np.eye(dim))]
        return _row(frame, shift=[float(v) for v in ends[0]], keep=[float(v) for e in ends[1:] for v in e - ends[0]])

    def starts(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, out = frame.sort_values("_chunk").reset_index(drop=True), np.zeros(dim), []
        for shift, keep in zip(frame["shift"], frame["keep"], strict=True):
            out.append(state.tolist())
            state = np.asarray(shift) + state @ np.asarray(keep).reshape(dim, dim)
        return frame[list(AT)].assign(_start=out)

    found = written(held.groupBy(*AT).applyInPandas(maps, f"{fields}, shift array<double>, keep array<double>"), "scan-maps")
    begun = held.join(found.groupBy(*KEYS).applyInPandas(starts, f"{fields}, _start array<double>"), list(AT))  # a row for each chunk
    return _with_columns(begun, bars, columns, lambda f, before, last: kernel(f, before, last, np.asarray(f["_start"].iloc[0], float))[0])


def stitched(bars: DataFrame, kernel: Kernel, columns: dict[str, str], seconds: int, rounds: int = ROUNDS, told: dict | None = None) -> DataFrame:
    """bars and the columns of a kernel with any state (numbers; an empty array before the first bar), exactly as one walk
    over the series gives them.

    told, if given, gets `rounds` (how often chunks were walked until all starts held), `walked` (walks of chunks by
    chunks) and `whole` (the share of chunks in series that had to be walked as a whole)."""
    held = chunks(bars, seconds)
    fields = ", ".join([f"{k} string" for k in KEYS] + ["_chunk long", "_start array<double>", "_end array<double>"])
    by = W.partitionBy(*KEYS).orderBy("_chunk")

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame, before, last = _ordered(frame)
        start = frame["_start"].iloc[0]
        return _row(frame, _start=start, _end=[float(v) for v in kernel(frame, before, last, np.asarray(start, float))[1]])

    nothing = F.array().cast("array<double>")
    known = written(held.withColumn("_start", nothing).groupBy(*AT).applyInPandas(ends, fields), "stitch-ends")
    n, walked, done = known.count(), 0, 0
    walked = n
    while True:
        wanted = written(known.select(*AT, "_start", "_end", F.coalesce(F.lag("_end").over(by), nothing).alias("_want")), "stitch-wanted")  # a row for each chunk
        wrong = wanted.filter("_start != _want")
        left = wrong.count()
        if not left or done == rounds:
            break
        again = held.join(wrong.select(*AT, F.col("_want").alias("_start")), list(AT)).groupBy(*AT).applyInPandas(ends, fields)
        known = written(wanted.filter("_start = _want").select(*AT, "_start", "_end").unionByName(again), "stitch-ends")
        done, walked = done + 1, walked + left
    whole = wrong.select(*KEYS).distinct()
    slow = wanted.join(whole, list(KEYS), "left_semi").count() if left else 0
    if told is not None:
        told |= {"rounds": done + 1, "walked": walked / max(1, n), "whole": slow / max(1, n)}
    make = lambda f, before, last: kernel(f, before, last, np.asarray(f["_start"].iloc[0], float))[0]
    fine = held.join(wanted.select(*AT, F.col("_want").alias("_start")), list(AT))
    if not slow:
        return _with_columns(fine, bars, columns, make)
    one = held.join(whole, list(KEYS), "left_semi").withColumn("_chunk", F.lit(0).cast("long")).withColumn("_start", nothing)
    one = one.withColumn("_before", F.lit(0).cast("long")).withColumn("_last", F.lit(float("nan")))
    return _with_columns(fine.join(whole, list(KEYS), "left_anti"), bars, columns, make).unionByName(_with_columns(one, bars, columns, make))


# ---- the kernels -----------------------------------------------------------------------------------------------------


def _before_each(frame: pd.DataFrame, last: float) -> np.ndarray:
    return np.concatenate([[last], frame["close"].to_numpy()[:-1]])


def _ranges(frame: pd.DataFrame, last: float) -> np.ndarray:
    high, low, before = frame["high"].to_numpy(), frame["low"].to_numpy(), _before_each(frame, last)
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def exponential(bars: DataFrame, seconds: int, **spans: int) -> DataFrame:
    """Adds exponential means of close: name=span. close is not null."""

    def kernel(f, before, last, start):
        done = [mean_from(f["close"].to_numpy(), 2 / (n + 1), before, s) for n, s in zip(spans.values(), start, strict=True)]
        return {c: v for c, (v, _) in zip(spans, done, strict=True)}, np.array([e for _, e in done])

    return affine(bars, kernel, len(spans), dict.fromkeys(spans, "double"), seconds)


def macd(bars: DataFrame, seconds: int, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds macd, macd_signal and macd_hist."""

    def kernel(f, before, last, start):
        close = f["close"].to_numpy()
        (a, x), (b, y) = (mean_from(close, 2 / (n + 1), before, s) for n, s in ((fast, start[0]), (slow, start[1])))
        mean, z = mean_from(a - b, 2 / (signal + 1), before, start[2])
        return {"macd": a - b, "macd_signal": mean, "macd_hist": a - b - mean}, np.array([x, y, z])

    return affine(bars, kernel, 3, dict.fromkeys(("macd", "macd_signal", "macd_hist"), "double"), seconds)


def wilder(bars: DataFrame, seconds: int, n: int = 14) -> DataFrame:
    """Adds wilder_rsi and wilder_atr."""

    def kernel(f, before, last, start):
        d = f["close"].to_numpy() - _before_each(f, last)
        d[np.isnan(d)] = 0.0
        (up, x), (down, y), (atr, z) = (seeded_from(v, n, 1 / n, before, s) for v, s in zip((np.maximum(d, 0), np.maximum(-d, 0), _ranges(f, last)), start, strict=True))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = 100 - 100 / (1 + up / down)
        rsi = np.where(np.isnan(up), 50.0, np.where(down == 0, 100.0, np.where(up == 0, 0.0, rsi)))
        return {"wilder_rsi": rsi, "wilder_atr": atr}, np.array([x, y, z])

    return affine(bars, kernel, 3, {"wilder_rsi": "double", "wilder_atr": "double"}, seconds)


def trend_states(bars: DataFrame, seconds: int, atr: int = 10, mult: float = 3.0, period: int = 20, rng: float = 2.5, rounds: int = ROUNDS, told: dict | None = None) -> DataFrame:
    """Adds the supertrend (up, dn, trend, buy, sell) of hl2 and the range filter (filter, state, flips) of close: true
    ranges' and moves' means by an affine scan, the rest stitched."""

    def reaches(f, before, last, start):
        move = np.abs(f["close"].to_numpy() - _before_each(f, last))
        move[np.isnan(move)] = 0.0
        mean, x = seeded_from(_ranges(f, last), atr, 1 / atr, before, start[0])
        first, y = mean_from(move, 2 / (period + 1), before, start[1])
        second, z = mean_from(first, 2 / (2 * period), before, start[2])
        return {"_atr": mean, "_reach": second}, np.array([x, y, z])

    def states(f, before, last, start):
        high, low, close = (f[c].to_numpy() for c in ("high", "low", "close"))
        return walked((high + low) / 2, close, f["_atr"].to_numpy(), mult, f["_reach"].to_numpy() * rng, start)

    kinds = {"up": "double", "dn": "double", "trend": "int", "buy": "boolean", "sell": "boolean", "filter": "double", "state": "int", "flip_buy": "boolean", "flip_sell": "boolean"}
    ready = written(affine(bars, reaches, 3, {"_atr": "double", "_reach": "double"}, seconds), "scan-reaches")
    return stitched(ready, states, kinds, seconds, rounds, told).drop("_atr", "_reach")


def walked(src: np.ndarray, close: np.ndarray, atr: np.ndarray, mult: float, reach: np.ndarray, start: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Supertrend and range filter from a state (close, up, dn, trend, filter, state of the bar before; empty: none)."""
    n = len(close)
    width = mult * np.where(np.isnan(atr), 0.0, atr)
    up, dn, trend, line, state = src - width, src + width, np.ones(n, int), np.zeros(n), np.zeros(n, int)
    begun = len(start) > 0
    last, u, d, t, f, s = start if begun else (close[0], 0.0, 0.0, 1, close[0], 0)
    t0, s0 = int(t), int(s)
    for i in range(n):
        c = close[i]
        if i or begun:
            if last > u:
                up[i] = max(up[i], u)
            if last < d:
                dn[i] = min(dn[i], d)
            t = 1 if t == -1 and c > d else -1 if t == 1 and c < u else t
        new = max(c - reach[i], f) if c > f else min(c + reach[i], f)
        s = 1 if c > new > f else -1 if c < new < f else s
        last, u, d, f = c, up[i], dn[i], new
        trend[i], line[i], state[i] = t, new, s
    t1, s1 = np.concatenate([[t0 if begun else trend[0]], trend[:-1]]), np.concatenate([[s0], state[:-1]])
    columns = {
        "up": up, "dn": dn, "trend": trend, "buy": (trend == 1) & (t1 == -1), "sell": (trend == -1) & (t1 == 1),
        "filter": line, "state": state, "flip_buy": (state == 1) & (s1 == -1), "flip_sell": (state == -1) & (s1 == 1),
    }
    return columns, np.array([last, u, d, t, f, s], float)
