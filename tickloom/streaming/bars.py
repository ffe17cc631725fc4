"""Streams of bars: duplicates dropped within a watermark, and indicators whose state is carried between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(bars: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first bar of each (symbol, timeframe, time); state older than the watermark goes. time must be a timestamp."""
    return bars.withWatermark("time", late).dropDuplicatesWithinWatermark(["symbol", "timeframe", "time"])


OUT = "symbol string, timeframe string, time timestamp, close double, ema double, rsi double"
STATE = "n long, close double, ema double, gains array<double>, losses array<double>, up double, down double, last_time timestamp"


def step(state: dict, close: float, span: int, n: int) -> tuple[float, float]:
    """One bar: the exponential mean from the first value, and Wilder's RSI (50 until n changes are known)."""
    a = 2 / (span + 1)
    state["ema"] = close if state["n"] == 0 else a * close + (1 - a) * state["ema"]
    d = close - state["close"] if state["n"] else 0.0
    gain, loss = max(d, 0.0), max(-d, 0.0)
    if state["n"] < n:
        state["gains"].append(gain)
        state["losses"].append(loss)
        if state["n"] == n - 1:
            state["up"], state["down"] = float(np.mean(state["gains"])), float(np.mean(state["losses"]))
            state["gains"], state["losses"] = [], []
    else:
        k = 1 / n
        state["up"], state["down"] = (1 - k) * state["up"] + k * gain, (1 - k) * state["down"] + k * loss
    state["n"] += 1
    state["close"] = close
    if state["n"] < n:
        return state["ema"], 50.0
    return state["ema"], 100.0 if state["down"] == 0 else 0.0 if state["up"] == 0 else 100 - 100 / (1 + state["up"] / state["down"])


def incremental_indicators(bars: DataFrame, span: int = 20, rsi: int = 14, late: str = "1 hour") -> DataFrame:
    """A stream of bars -> the same bars with ema and rsi, as the batch kernels give them for the whole series.

    A bar that is not newer than the last one of its series is dropped, whatever batch it comes in."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        names = ("n", "close", "ema", "gains", "losses", "up", "down", "last_time")
        state = dict(zip(names, group.get, strict=True)) if group.exists else {"n": 0, "close": 0.0, "ema": 0.0, "gains": [], "losses": [], "up": 0.0, "down": 0.0, "last_time": pd.Timestamp(0)}
        state["gains"], state["losses"] = list(state["gains"]), list(state["losses"])
        frame = pd.concat(list(frames)).sort_values("time", kind="stable")
        rows = []
        for time, close in zip(frame["time"], frame["close"], strict=True):
            if time > state["last_time"]:
                rows.append((*key, time, close, *step(state, close, span, rsi)))
                state["last_time"] = time
        group.update(tuple(state[x] for x in names))
        yield pd.DataFrame(rows, columns=["symbol", "timeframe", "time", "close", "ema", "rsi"])

    keyed = bars.withWatermark("time", late).groupBy("symbol", "timeframe")
    return keyed.applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


TREND_OUT = "symbol string, timeframe string, time timestamp, up double, dn double, trend int, filter double, state int"
TREND_STATE = "n long, close double, ranges double, atr double, up double, dn double, trend int, e1 double, e2 double, filter double, state int, last_time timestamp"


def trend_step(s: dict, high: float, low: float, close: float, atr: int, mult: float, period: int, rng: float) -> None:
    """One bar for supertrend and range filter: s holds what the bar before left behind (n 0 before the first)."""
    first, last, a1, a2 = s["n"] == 0, s["close"], 2 / (period + 1), 2 / (2 * period)
    tr = high - low if first else max(high - low, abs(high - last), abs(low - last))
    s["ranges"] += tr if s["n"] < atr else 0.0
    s["atr"] = 0.0 if s["n"] < atr - 1 else s["ranges"] / atr if s["n"] == atr - 1 else tr / atr + (1 - 1 / atr) * s["atr"]
    up, dn, was = (high + low) / 2 - mult * s["atr"], (high + low) / 2 + mult * s["atr"], s["trend"]
    if not first:
        up = max(up, s["up"]) if last > s["up"] else up
        dn = min(dn, s["dn"]) if last < s["dn"] else dn
        s["trend"] = 1 if was < 0 and close > s["dn"] else -1 if was > 0 and close < s["up"] else was
    move = 0.0 if first else abs(close - last)
    s["e1"] = move if first else a1 * move + (1 - a1) * s["e1"]
    s["e2"] = s["e1"] if first else a2 * s["e1"] + (1 - a2) * s["e2"]
    before, reach = close if first else s["filter"], s["e2"] * rng
    s["filter"] = max(close - reach, before) if close > before else min(close + reach, before)
    if close > s["filter"] > before:
        s["state"] = 1
    elif close < s["filter"] < before:
        s["state"] = -1
    s["n"], s["close"], s["up"], s["dn"] = s["n"] + 1, close, up, dn


def incremental_trends(bars: DataFrame, atr: int = 10, mult: float = 3.0, period: int = 20, rng: float = 2.5, late: str = "1 hour") -> DataFrame:
    """A stream of bars -> supertrend and range filter, as the batch kernels give them for the whole series.

    A bar that is not newer than the last one of its series is dropped, whatever batch it comes in."""
    names = tuple(x.split()[0] for x in TREND_STATE.split(", "))
    empty = dict.fromkeys(names, 0.0) | {"n": 0, "trend": 1, "state": 0, "last_time": pd.Timestamp(0)}

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, group.get, strict=True)) if group.exists else dict(empty)
        frame, rows = pd.concat(list(frames)).sort_values("time", kind="stable"), []
        for time, high, low, close in zip(frame["time"], frame["high"], frame["low"], frame["close"], strict=True):
            if time > s["last_time"]:
                trend_step(s, high, low, close, atr, mult, period, rng)
                s["last_time"] = time
                rows.append((*key, time, s["up"], s["dn"], s["trend"], s["filter"], s["state"]))
        group.update(tuple(s[x] for x in names))
        yield pd.DataFrame(rows, columns=["symbol", "timeframe", "time", "up", "dn", "trend", "filter", "state"])

    keyed = bars.withWatermark("time", late).groupBy("symbol", "timeframe")
    return keyed.applyInPandasWithState(run, TREND_OUT, TREND_STATE, "append", GroupStateTimeout.NoTimeout)
