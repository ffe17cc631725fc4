"""Backtests: EMA-cross signals paired to trades natively, and a grouped fold for strategies with state.

Runs are never multiplied by bars. A series' signals are found once per parameter pair and only the bars where
something happens go on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import recurrence as rec
from tickloom.operators import strategies as st

EVENTS = "symbol string, timeframe string, fast int, slow int, bar int, time timestamp_ntz, kind int, price double"


def cross_events(bars: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """What happens on each series for each pair of spans (pairs is the sweep's parameter list, not data).

    kind 1: an entry, at the open of the bar after the fast mean crossed above the slow one; kind -1: an exit, at the
    close of the bar on which it crosses below; kind 0: the last bar's close, where open positions end."""
    spans = sorted({n for p in pairs for n in p})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("time", kind="stable").reset_index(drop=True)
        close, opened, time = (frame[c].to_numpy() for c in ("close", "open", "time"))
        means = {n: rec.ema(close, n) for n in spans}  # once per span, however many pairs share it
        parts = []
        for fast, slow in pairs:
            above = means[fast] > means[slow]
            below = means[fast] < means[slow]
            up = np.flatnonzero(~above[:-1] & above[1:]) + 1
            down = np.flatnonzero(~below[:-1] & below[1:]) + 1
            up = up[up + 1 < len(close)] + 1
            at = np.concatenate([up, down, [len(close) - 1]])
            parts.append(pd.DataFrame({"symbol": frame["symbol"][0], "timeframe": frame["timeframe"][0], "fast": fast, "slow": slow, "bar": at, "time": time[at], "kind": np.repeat([1, -1, 0], [len(up), len(down), 1]), "price": np.concatenate([opened[up], close[down], close[-1:]])}))
        return pd.concat(parts, ignore_index=True)

    return bars.groupBy("symbol", "timeframe").applyInPandas(run, EVENTS)


RUN = ("symbol", "timeframe", "fast", "slow")


def cross_trades(events: DataFrame, fee: float = 0.0004, notional: float = 1000.0) -> DataFrame:
    """One trade at a time: an entry counts while no position is open; it ends with the next exit or the last bar.

    On a bar an entry (at its open) comes before an exit (at its close). Fixed notional; pnl leaves the entry fee out."""
    order = W.partitionBy(*RUN).orderBy("bar", F.desc("kind"))
    later = F.min(F.when(F.col("kind") <= 0, F.struct("bar", "time", "price"))).over(order.rowsBetween(1, W.unboundedFollowing))
    entries = events.withColumn("exit", later).filter("kind = 1 and exit is not null")
    # Entries with the same exit belong to one position: the first of them opens it.
    first = F.row_number().over(W.partitionBy(*RUN, "exit.bar").orderBy("bar"))
    t = entries.withColumn("_n", first).filter("_n = 1")
    size = notional / F.col("price")
    t = t.select(*RUN, F.row_number().over(W.partitionBy(*RUN).orderBy("bar")).alias("trade_no"), F.col("time").alias("entry_time"), F.col("exit.time").alias("exit_time"), F.col("price").alias("entry_price"), F.col("exit.price").alias("exit_price"), size.alias("size"))
    return t.withColumn("entry_fee", fee * F.col("entry_price") * F.col("size")).withColumn("exit_fee", fee * F.col("exit_price") * F.col("size")).withColumn("pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("size") - F.col("exit_fee"))


# ---- strategies with state -------------------------------------------------------------------------------------------


@dataclass
class Orders:
    """How signals become positions. order: percent (of the equity that no open position holds), cash (an amount) or
    units; compound: percent of the running equity, not of the initial one; slip: added to what is bought and taken from
    what is sold (ticks x tick size); pyramiding: open positions of one side at most; start: bar from which on signals
    count (bars before it only warm indicators up)."""

    initial: float = 10_000.0
    value: float = 10.0
    order: str = "percent"
    compound: bool = True
    fee: float = 0.0004
    slip: float = 0.0
    pyramiding: int = 1
    start: int = 0

    def size(self, price: float, equity: float, exposed: float) -> float:
        base = equity - exposed if self.compound else max(self.initial - exposed, 0.0)
        return {"percent": max(self.value / 100 * base / price, 0.0), "cash": max(self.value / price, 0.0), "units": self.value}[self.order]


def fold(a: dict, rules: st.Rules, o: Orders) -> list[tuple]:
    """Trades of one run: a signal fills at the next bar's open, a position closes at its bar's close.

    An exit closes the first position that its kind of entry opened, else the side's first one; one position a bar. What
    is open at the last close ends there."""
    equity, opened, done, pending = o.initial, {1: [], -1: []}, [], None
    n = len(a["close"])

    def close(i: int, side: int, at: int, price: float, size: float, kind: str, why: str) -> float:
        out = a["close"][i] - side * o.slip
        fee = out * o.fee * size
        pnl = side * (out - price) * size - fee
        done.append((len(done) + 1, "Long" if side > 0 else "Short", kind, at, i, price, out, size, pnl, price * o.fee * size, fee, why))
        return pnl

    for i in range(n):
        if pending and i > o.start and len(opened[pending[0]]) < o.pyramiding:
            side, kind = pending
            price = round(a["open"][i] + side * o.slip, 6)
            size = o.size(price, equity, sum(x[1] * x[2] for held in opened.values() for x in held))
            equity -= price * o.fee * size
            opened[side].append((i, price, size, kind))
        pending = None
        if (not rules.needs_position or any(opened.values())) and (exit_ := rules.leave(i)):
            side, kind, why = exit_
            if held := opened[side]:
                at = next((k for k, x in enumerate(held) if x[3] == kind), 0)
                equity += close(i, side, *held.pop(at), why)
        if i >= o.start:
            pending = rules.enter(i)
    for side, held in opened.items():
        for x in held:
            close(n - 1, side, *x, "EOD")
    return done


TRADES = (
    "run_id long, trade_no int, side string, entry_type string, entry_bar int, exit_bar int, entry_price double, exit_price double, "
    "size double, pnl double, entry_fee double, exit_fee double, exit_reason string"
)


def backtest(bars: DataFrame, runs: DataFrame, orders: Orders | None = None, runs_per_block: int = 64) -> DataFrame:
    """bars and runs (run_id, symbol, timeframe, strategy, params map<string, double>) -> trades.

    Runs of a series are dealt into blocks of about runs_per_block; each block meets its series once, in one group of the
    cogroup. So a task holds one series and a bounded number of parameter sets, a sweep on a single symbol spreads over
    the cluster, and runs of a block share what they compute from equal parameters."""
    unknown = [r["strategy"] for r in runs.select("strategy").distinct().collect() if r["strategy"] not in st.STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategies: {unknown}")
    orders = orders or Orders()
    keys = ("symbol", "timeframe", "block")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides may stem from one table
    blocks = runs.groupBy("symbol", "timeframe").agg(F.ceil(F.count("*") / runs_per_block).cast("int").alias("blocks"))
    dealt = fresh(runs.join(blocks, ["symbol", "timeframe"]).withColumn("block", F.pmod(F.xxhash64("run_id"), F.col("blocks")).cast("int")).drop("blocks"))
    series = fresh(bars.join(dealt.select(*keys).distinct(), ["symbol", "timeframe"]))

    def run(frame: pd.DataFrame, sweep: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("time", kind="stable")
        a = {c: frame[c].to_numpy(float) for c in ("open", "high", "low", "close")}
        known, out = st.Series(a), []
        for run_id, name, params in zip(sweep["run_id"], sweep["strategy"], sweep["params"], strict=True):
            if len(frame):
                out += [(run_id, *t) for t in fold(a, st.STRATEGIES[name](known, dict(params)), orders)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")])

    return series.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, TRADES)
