"""Streams of bars that arrive out of order: bars wait in a buffer until the watermark passes them, then go through the
same steps in the order of their times as the batch kernels take."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.bars import step, trend_step

#: A series without bars for so long (of its own time) is forgotten: its next bar begins it anew.
DEAD = 400 * 86_400_000


def millis(times: pd.Series) -> list[int]:
    return [t.value // 1_000_000 for t in pd.to_datetime(times)]


class Ordered(StatefulProcessor):
    """work(state, numbers of a bar) -> numbers to return; state is a dict of numbers and lists, `empty` at first.

    A bar that isn't newer than the last one released is late beyond the watermark and dropped; of bars with one time the
    first stays. A timer stands at the oldest waiting bar, or, where none waits, at the end of the series' life, when its
    state goes."""

    def __init__(self, work: Callable[[dict, list[float]], list], empty: dict, inputs: list[str], outputs: list[str], dead: int = DEAD) -> None:
        self.work, self.empty, self.inputs, self.outputs, self.dead = work, empty, inputs, outputs, dead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, state string, times array<bigint>, bars array<array<double>>")

    def load(self) -> tuple[int, dict, dict[int, list[float]]]:
        if not self.held.exists():
            return -(1 << 62), json.loads(json.dumps(self.empty)), {}
        last, state, times, bars = self.held.get()
        return last, json.loads(state), dict(zip(times, map(list, bars), strict=True))

    def released(self, key: tuple, last: int, state: dict, waiting: dict[int, list[float]], mark: int) -> Iterator[pd.DataFrame]:
        rows = []
        for t in sorted(t for t in waiting if t <= mark):
            if t - last > self.dead:
                state = json.loads(json.dumps(self.empty))
            rows.append((*key, pd.Timestamp(t, unit="ms"), *self.work(state, waiting.pop(t))))
            last = t
        left = sorted(waiting)
        self.held.update((last, json.dumps(state), left, [waiting[t] for t in left]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(left[0] if left else max(last + self.dead, mark + 1))
        yield pd.DataFrame(rows, columns=["symbol", "timeframe", "time", *self.outputs])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, state, waiting = self.load()
        for frame in rows:
            for t, *numbers in zip(millis(frame["time"]), *[frame[c].astype(float) for c in self.inputs], strict=True):
                if t > last:
                    waiting.setdefault(t, numbers)
        yield from self.released(key, last, state, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        last, state, waiting = self.load()
        if waiting:
            yield from self.released(key, last, state, waiting, timerValues.getCurrentWatermarkInMs())
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def _ordered(bars: DataFrame, processor: Ordered, schema: str, late: str) -> DataFrame:
    keyed = bars.withWatermark("time", late).groupBy("symbol", "timeframe")
    return keyed.transformWithStateInPandas(processor, schema, "Append", "EventTime")


def ordered_indicators(bars: DataFrame, span: int = 20, rsi: int = 14, late: str = "6 hours", dead: int = DEAD) -> DataFrame:
    """A stream of bars in any order within `late` -> the bars with ema and rsi, as the batch kernels give them. The session's
    state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    empty = {"n": 0, "close": 0.0, "ema": 0.0, "gains": [], "losses": [], "up": 0.0, "down": 0.0}
    work = lambda state, bar: [bar[0], *step(state, bar[0], span, rsi)]
    return _ordered(bars, Ordered(work, empty, ["close"], ["close", "ema", "rsi"], dead), "symbol string, timeframe string, time timestamp, close double, ema double, rsi double", late)


def ordered_trends(bars: DataFrame, atr: int = 10, mult: float = 3.0, period: int = 20, rng: float = 2.5, late: str = "6 hours", dead: int = DEAD) -> DataFrame:
    """A stream of bars in any order within `late` -> supertrend and range filter, as the batch kernels give them."""
    names = ["up", "dn", "trend", "filter", "state"]
    empty = dict.fromkeys(("close", "ranges", "atr", "up", "dn", "e1", "e2", "filter"), 0.0) | {"n": 0, "trend": 1, "state": 0}

    def work(state: dict, bar: list[float]) -> list:
        trend_step(state, *bar, atr, mult, period, rng)
        return [state[c] for c in names]

    schema = "symbol string, timeframe string, time timestamp, up double, dn double, trend int, filter double, state int"
    return _ordered(bars, Ordered(work, empty, ["high", "low", "close"], names, dead), schema, late)
