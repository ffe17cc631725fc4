"""Indicators that carry a state from bar to bar, as small NumPy steps over one series.

`over_series` hands each (symbol, timeframe) to one of them in Spark groups; the streaming job carries the same states
between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEYS = ("symbol", "timeframe")


def linear(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """y[i] = keep * y[i - 1] + x[i] with y[-1] = start."""
    out, y = np.empty(len(x)), start
    for i, v in enumerate(x):
        y = keep * y + v
        out[i] = y
    return out


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean that begins at the first value; leading nulls stay."""
    out, good = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    if len(good):
        k = good[0]
        out[k] = x[k]
        out[k + 1 :] = linear(alpha * x[k + 1 :], 1 - alpha, x[k])
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return ewm(x, 2 / (n + 1))


def seeded(x: np.ndarray, n: int, alpha: float, compat: bool = False) -> np.ndarray:
    """Exponential mean that begins with the mean of n values at the n-th one; null before.

    compat: the seed is followed by one value that is biased: (n * seed + x) / n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        k = n
        if compat and len(x) > n:
            out[n] = (out[n - 1] * n + x[n]) / n
            k = n + 1
        out[k:] = linear(alpha * x[k:], 1 - alpha, out[k - 1])
    return out


def warmed(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """The mean of all values so far up to the n-th; then n + 1 values by n, once; then an exponential mean."""
    total = np.cumsum(x)
    out = total / np.arange(1, len(x) + 1)
    if len(x) > n:
        out[n] = total[n] / n
        out[n + 1 :] = linear(alpha * x[n + 1 :], 1 - alpha, out[n])
    return out


def rma(x: np.ndarray, n: int, compat: bool = False) -> np.ndarray:
    return seeded(x, n, 1 / n, compat)


def wilder_rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """RSI of Wilder's means: 50 until they exist, 100 without losses, 0 without gains."""
    d = np.diff(close, prepend=close[:1])
    up, down = rma(np.where(d > 0, d, 0.0), n), rma(np.where(d < 0, -d, 0.0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    return np.where(np.isnan(up), 50.0, np.where(down == 0, 100.0, np.where(up == 0, 0.0, out)))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, +DI and -DI by exponential means over the exponential mean of the n-bar mean true range; null before that is.

    A fall counts against the already masked rise."""
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > plus) & (down > 0), down, 0.0)
    tr = true_range(high, low, close)
    total = np.cumsum(tr)
    ranges = np.full(len(tr), np.nan)
    ranges[n - 1 :] = (total[n - 1 :] - np.concatenate([[0.0], total[:-n]])) / n
    ranges = ema(ranges, n)
    plus, minus = 100 * (ema(plus, n) / ranges), 100 * (ema(minus, n) / ranges)
    return ema(100 * np.abs(plus - minus) / (plus + minus + 1e-10), n), plus, minus


def supertrend(src: np.ndarray, close: np.ndarray, atr: np.ndarray, mult: float) -> dict[str, np.ndarray]:
    """Bands that only tighten while close stays inside, the trend (1 or -1) and where it turns."""
    n = len(close)
    up, dn, trend = np.zeros(n), np.zeros(n), np.ones(n, int)
    for i in range(n):
        a = 0.0 if np.isnan(atr[i]) else atr[i]
        up[i], dn[i] = src[i] - mult * a, src[i] + mult * a
        if i:
            if close[i - 1] > up[i - 1]:
                up[i] = max(up[i], up[i - 1])
            if close[i - 1] < dn[i - 1]:
                dn[i] = min(dn[i], dn[i - 1])
            trend[i] = 1 if trend[i - 1] == -1 and close[i] > dn[i - 1] else -1 if trend[i - 1] == 1 and close[i] < up[i - 1] else trend[i - 1]
    before = np.concatenate([trend[:1], trend[:-1]])
    return {"up": up, "dn": dn, "trend": trend, "buy": (trend == 1) & (before == -1), "sell": (trend == -1) & (before == 1)}


def smooth_range(src: np.ndarray, n: int, mult: float) -> np.ndarray:
    d = np.abs(np.diff(src, prepend=src[:1]))
    return ema(ema(d, n), 2 * n - 1) * mult


def range_filter(src: np.ndarray, rng: np.ndarray, counters: bool = False, need_move: bool = True) -> dict[str, np.ndarray]:
    """A line that follows src beyond its range only, the state (1 above a rising line, -1 below a falling one, else as
    before) and where that flips.

    counters: the line counts as rising since its last rise, until it falls, and (need_move) only bars whose src differs
    from the one before change the state; else a bar's own rise or fall decides."""
    n = len(src)
    f, state, rising, falling = np.zeros(n), np.zeros(n, int), 0, 0
    for i in range(n):
        before = f[i - 1] if i else src[0]
        f[i] = max(src[i] - rng[i], before) if src[i] > before else min(src[i] + rng[i], before)
        up, down = f[i] > before, f[i] < before
        if counters:
            rising, falling = (rising + 1, 0) if up else (0, falling + 1) if down else (rising, falling)
            moved = not need_move or (i > 0 and src[i] != src[i - 1])
            up, down = rising > 0 and moved, falling > 0 and moved
        state[i] = 1 if src[i] > f[i] and up else -1 if src[i] < f[i] and down else (state[i - 1] if i else 0)
    before = np.concatenate([[0], state[:-1]])
    return {"filter": f, "state": state, "flip_buy": (state == 1) & (before == -1), "flip_sell": (state == -1) & (before == 1)}


def over_series(bars: DataFrame, columns: dict[str, str], make: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """Adds columns (name -> type) that make computes from a whole series in time order. A series is one group."""
    added = T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in columns.items()))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("time", kind="stable").reset_index(drop=True)
        return frame.assign(**make(frame))

    return bars.groupBy(*KEYS).applyInPandas(run, T.StructType([*bars.schema.fields, *added.fields]))


def exponential(bars: DataFrame, **spans: int) -> DataFrame:
    """Adds exponential means of close: name=span."""
    return over_series(bars, {c: "double" for c in spans}, lambda f: {c: ema(f["close"].to_numpy(), n) for c, n in spans.items()})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def make(f: pd.DataFrame) -> dict[str, np.ndarray]:
        line = ema(f["close"].to_numpy(), fast) - ema(f["close"].to_numpy(), slow)
        mean = ema(line, signal)
        return {"macd": line, "macd_signal": mean, "macd_hist": line - mean}

    return over_series(bars, {"macd": "double", "macd_signal": "double", "macd_hist": "double"}, make)


def wilder(bars: DataFrame, n: int = 14, compat: bool = False) -> DataFrame:
    """Adds wilder_rsi and wilder_atr."""

    def make(f: pd.DataFrame) -> dict[str, np.ndarray]:
        tr = true_range(*(f[c].to_numpy() for c in ("high", "low", "close")))
        return {"wilder_rsi": wilder_rsi(f["close"].to_numpy(), n), "wilder_atr": rma(tr, n, compat)}

    return over_series(bars, {"wilder_rsi": "double", "wilder_atr": "double"}, make)


def trend_states(bars: DataFrame, atr: int = 10, mult: float = 3.0, period: int = 20, rng: float = 2.5) -> DataFrame:
    """Adds the supertrend (up, dn, trend, buy, sell) of hl2 and the range filter (filter, state, flips) of close."""

    def make(f: pd.DataFrame) -> dict[str, np.ndarray]:
        high, low, close = (f[c].to_numpy() for c in ("high", "low", "close"))
        return supertrend((high + low) / 2, close, rma(true_range(high, low, close), atr), mult) | range_filter(close, smooth_range(close, period, rng))

    kinds = {"up": "double", "dn": "double", "trend": "int", "buy": "boolean", "sell": "boolean", "filter": "double", "state": "int", "flip_buy": "boolean", "flip_sell": "boolean"}
    return over_series(bars, kinds, make)


def filter_bands(bars: DataFrame, period: int = 20, rng: float = 2.5, counters: bool = False) -> DataFrame:
    """Adds the range filter of close with its bands: filter, high_band, low_band, state, flips."""

    def make(f: pd.DataFrame) -> dict[str, np.ndarray]:
        close = f["close"].to_numpy()
        reach = smooth_range(close, period, rng)
        out = range_filter(close, reach, counters)
        return out | {"high_band": out["filter"] + reach, "low_band": out["filter"] - reach}

    kinds = {"filter": "double", "high_band": "double", "low_band": "double", "state": "int", "flip_buy": "boolean", "flip_sell": "boolean"}
    return over_series(bars, kinds, make)
