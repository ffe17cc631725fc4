"""Both strategies with stops and targets, trade by trade, against a plain version that goes bar by bar."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, strategies


def prices(seed, n=700):
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, n) + 0.6 * np.sin(np.arange(n) / 25)), 4)
    spread = np.round(rng.random((2, n)), 4)
    opened = np.round(np.r_[close[0], close[:-1]] + rng.normal(0, 0.2, n), 4)
    return {"open": opened, "high": np.maximum(opened, close) + spread[0], "low": np.minimum(opened, close) - spread[1], "close": close}


class Mean:
    """Plain mean for n values, then n + 1 values by n, then exponential."""

    def __init__(self, n, alpha):
        self.n, self.alpha, self.seen, self.total, self.value = n, alpha, 0, 0.0, 0.0

    def add(self, x):
        if self.seen <= self.n:
            self.total += x
            self.value = self.total / (self.seen + 1 if self.seen < self.n else self.n)
        else:
            self.value = self.alpha * x + (1 - self.alpha) * self.value
        self.seen += 1
        return self.value


class Trend:
    def __init__(self, n, mult):
        self.mean, self.mult, self.trend, self.bands, self.last = Mean(n, 1 / n), mult, 1, None, None

    def add(self, high, low, close):
        tr = high - low if self.last is None else max(high - low, abs(high - self.last), abs(low - self.last))
        reach, mid, was = self.mult * self.mean.add(tr), (high + low) / 2, self.trend
        up, dn = mid - reach, mid + reach
        if self.bands:
            before_up, before_dn = self.bands
            up = max(up, before_up) if self.last > before_up else up
            dn = min(dn, before_dn) if self.last < before_dn else dn
            self.trend = 1 if was < 0 and close > before_dn else -1 if was > 0 and close < before_up else was
        self.bands, self.last = (up, dn), close
        return self.trend, self.trend > was, self.trend < was


class Filter:
    def __init__(self, n, mult, kind):
        self.one, self.two, self.mult, self.kind = Mean(n, 2 / (n + 1)), Mean(2 * n - 1, 1 / n), mult, kind
        self.line, self.state, self.last, self.ups, self.downs = None, 0, None, 0, 0

    def add(self, x):
        rng = self.two.add(self.one.add(0.0 if self.last is None else abs(x - self.last))) * self.mult
        before = x if self.line is None else self.line
        self.line = max(x - rng, before) if x > before else min(x + rng, before)
        if self.line > before:
            self.ups, self.downs = self.ups + 1, 0
        elif self.line < before:
            self.ups, self.downs = 0, self.downs + 1
        up, down = self.line > before, self.line < before
        if self.kind != "plain":
            free = self.kind == "any" or (self.last is not None and x != self.last)
            up, down = self.ups > 0 and free, self.downs > 0 and free
        was = self.state
        self.state = 1 if x > self.line and up else -1 if x < self.line and down else was
        self.last = x
        return {"state": self.state, "buy": self.state == 1 and was == -1, "sell": self.state == -1 and was == 1, "low": self.line - rng, "high": self.line + rng}


class Momentum:
    """RSI against its mean; swings of both kinds."""

    def __init__(self, n, m):
        self.up, self.down, self.m, self.values, self.last, self.mean = Mean(n, 1 / n), Mean(n, 1 / n), m, [], None, None
        self.swing, self.found = {1: None, -1: None}, {1: [], -1: []}

    def add(self, high, low, close):
        out = {1: False, -1: False}
        if self.last is not None:
            up, down = self.up.add(max(close - self.last, 0)), self.down.add(max(self.last - close, 0))
            rsi = 100.0 if down == 0 else 0.0 if up == 0 else 100 - 100 / (1 + up / down)
            window = (self.values + [rsi])[-self.m :]
            mean = sum(window) / len(window)
            rises = bool(self.values) and self.values[-1] <= self.mean and rsi > mean
            falls = bool(self.values) and self.values[-1] >= self.mean and rsi < mean
            self.values.append(rsi)
            self.mean = mean
            for side, begins, ends, key in ((1, falls, rises, (rsi, low)), (-1, rises, falls, (-rsi, -high))):
                if begins or (self.swing[side] and key[0] < self.swing[side][0]):
                    self.swing[side] = key
                if ends and self.swing[side]:
                    self.found[side] = (self.found[side] + [self.swing[side]])[-2:]
                    self.swing[side] = None
                    if len(self.found[side]) == 2:
                        (r1, p1), (r2, p2) = self.found[side]
                        out[side] = (p2 < p1 and r2 > r1) or (p2 > p1 and r2 < r1)
        self.last = close
        return out


def plain(a, p, both, order, value, fee, slip, pyramiding, compound, initial=10_000.0, start=0):
    """The trades of one run."""
    g = p.get
    main, rf = Trend(g("st_atrPeriod", 10), g("st_mult", 2.0)), Filter(g("rf_period", 100), g("rf_mult", 3.0), "plain")
    swings = Momentum(g("lenRSI", 14) if both else g("rsi_length", 14), g("lenMA", 6) if both else g("rsi_ma_length", 6))
    sides = (1, -1) if both else (1,)
    stop_trend, stop, tp = {}, {}, {}
    for s in sides:
        if both:
            o = "L" if s > 0 else "S"
            stop_trend[s] = Trend(g(f"st_sl_atrPeriod_{o}", 10), g(f"st_sl_mult_{o}", {1: 3.0, -1: 2.0}[s]))
            stop[s] = Filter(g(f"rf_sl_period_{o}", 20), g(f"rf_sl_mult_{o}", {1: 15.0, -1: 3.0}[s]), "any")
            tp[s, "flip"], tp[s, "rsi"] = (Trend(g(f"{k}_period_{o}", 10), g(f"{k}_mult_{o}", 2.0)) for k in ("st_tp_dual", "st_tp_rsi1"))
            tp[s, "flip", "rr"], tp[s, "rsi", "rr"] = g(f"rr_mult_dual_{o}", {1: 4.0, -1: 0.75}[s]), g(f"rr_mult_rsi1_{o}", {1: 4.0, -1: 0.75}[s])
        else:
            stop_trend[s], stop[s] = Trend(g("sl_st_atrPeriod", 10), g("sl_st_mult", 4.0)), Filter(g("sl_rf_period", 100), g("sl_rf_mult", 7.0), "moved")
            tp[s, "flip"], tp[s, "rsi"] = (Trend(g(f"{k}_st_atrPeriod", 10), g(f"{k}_st_mult", 2.0)) for k in ("tp_dual", "tp_rsi"))
            tp[s, "flip", "rr"], tp[s, "rsi", "rr"] = g("tp_dual_rr_mult", 1.3), g("tp_rsi_rr_mult", 1.3)
    since = {(k, s): 10**6 for k in ("rf", "st") for s in (1, -1)}
    equity, positions, trades, pending, held = initial, [], [], None, {}
    n = len(a["close"])

    def close_one(x, i, why):
        nonlocal equity
        out = a["close"][i] - x["side"] * slip
        pnl = x["side"] * (out - x["price"]) * x["size"] - out * fee * x["size"]
        equity += pnl
        positions.remove(x)
        trades.append((x["side"], x["kind"], x["bar"], i, round(x["price"], 6), round(out, 6), round(x["size"], 9), round(pnl, 6), why))

    for i in range(n):
        o, h, lo, c = (a[k][i] for k in ("open", "high", "low", "close"))
        trend, buy, sell = main.add(h, lo, c)
        f, div = rf.add(c), swings.add(h, lo, c)
        bar = {s: (stop_trend[s].add(h, lo, c), stop[s].add(c), tp[s, "flip"].add(h, lo, c), tp[s, "rsi"].add(h, lo, c)) for s in sides}
        for s, r, t in ((1, f["buy"], buy), (-1, f["sell"], sell)):
            since["rf", s] = 0 if r else since["rf", s] + 1
            since["st", s] = 0 if t else since["st", s] + 1
        if pending and i > start:
            s, kind = pending
            if sum(x["side"] == s for x in positions) < pyramiding:
                price = round(o + s * slip, 6)
                base = equity if compound else initial
                base = base - sum(x["price"] * x["size"] for x in positions)
                size = max(value / 100 * (base if compound else max(base, 0)) / price, 0) if order == "percent" else value / price if order == "cash" else value
                equity -= price * fee * size
                positions.append({"side": s, "kind": kind, "bar": i, "price": price, "size": size})
        pending = None

        signal, wanted, risky = {}, {}, {}
        for s in sides:
            band = bar[s][1]["low" if s > 0 else "high"]
            main_band = f["low" if s > 0 else "high"]
            reach = g("dualFlipBarsLong" if s > 0 else "dualFlipBarsShort", 8 if s > 0 else 12) - 1 if both else 8
            dual = (since["rf", s] == 0 and since["st", s] <= reach) or (since["st", s] == 0 and since["rf", s] <= reach)
            signal[s] = dual and (f["state"] == s or (both and s < 0))
            risky[s] = {"flip": signal[s] and s * (c - main_band) > 0, "rsi": div[s] and f["state"] == s and s * (c - band) > 0}
            wanted[s] = signal[s] or risky[s]["rsi"]

        def find_exit():
            if both:
                for s in sides:
                    if s in held and wanted[-s]:
                        return s, "REVERSAL"
            for kind in ("flip", "rsi"):
                for s in sides:
                    if s not in held or held[s]["kind"] != kind:
                        continue
                    x, (st_now, st_buy, st_sell), sl, *turns = held[s], *bar[s]
                    st_against, sl_against = (st_sell, sl["sell"]) if s > 0 else (st_buy, sl["buy"])
                    second = f["state"] if both else sl["state"]
                    against = (sl_against and st_now == -s) or (st_against and second == -s)
                    band = sl["low" if s > 0 else "high"] if both and kind == "flip" else x["band"]
                    profit, risk = s * (c - x["price"]), s * (x["price"] - x["band"])
                    beyond = c <= band if s > 0 else c >= band
                    if kind == "flip" and (beyond or against) or kind == "rsi" and risk > 0 and (beyond or (against and profit <= 0)):
                        return s, "SL"
                    _, up, down = turns[0 if kind == "flip" else 1]
                    if (down if s > 0 else up) and profit > risk * tp[s, kind, "rr"]:
                        return s, "TP"
            return None

        if i >= 1 and (both or positions) and (found := find_exit()):
            s, why = found
            kind = held.pop(s)["kind"]
            mine = [x for x in positions if x["side"] == s]
            if mine:
                close_one(next((x for x in mine if x["kind"] == kind), mine[0]), i, why)
        if i >= max(1, start):
            for kind in ("flip", "rsi"):
                for s in sides:
                    if not pending and s not in held and risky[s][kind]:
                        held[s] = {"kind": kind, "price": c, "band": bar[s][1]["low" if s > 0 else "high"]}
                        pending = s, kind
    for s in (1, -1):
        for x in [x for x in positions if x["side"] == s]:
            close_one(x, n - 1, "EOD")
    return trades


LONG = [
    {"st_atrPeriod": 5, "st_mult": 1.0, "rf_period": 20, "rf_mult": 1.0, "sl_rf_period": 20, "sl_rf_mult": 2.0, "sl_st_mult": 2.0, "tp_dual_rr_mult": 0.5, "tp_rsi_rr_mult": 0.5},
    {"st_atrPeriod": 3, "st_mult": 0.7, "rf_period": 10, "rf_mult": 0.8, "sl_rf_period": 30, "sl_rf_mult": 4.0, "rsi_length": 7, "rsi_ma_length": 4},
]
BOTH = [
    {"st_atrPeriod": 5, "st_mult": 1.0, "rf_period": 20, "rf_mult": 1.0, "rf_sl_mult_L": 3.0, "rr_mult_dual_L": 0.5, "rr_mult_rsi1_L": 0.5},
    {"st_atrPeriod": 3, "st_mult": 0.7, "rf_period": 10, "rf_mult": 0.8, "rf_sl_mult_L": 2.0, "rf_sl_mult_S": 1.5, "lenRSI": 7, "lenMA": 4, "dualFlipBarsShort": 5},
    {"st_mult": 1.5, "rf_period": 20, "rf_mult": 2.0, "rf_sl_mult_L": 6.0, "rf_sl_mult_S": 6.0} | {f"{k}_{s}": v for s in "LS" for k, v in (("st_tp_dual_mult", 0.3), ("rr_mult_dual", 0.05), ("st_tp_rsi1_mult", 0.3), ("rr_mult_rsi1", 0.05))},
]
ORDERS = [("percent", 10.0, True, 1, 0), ("percent", 30.0, False, 2, 0), ("cash", 500.0, True, 2, 60), ("units", 3.0, True, 1, 0)]


@pytest.mark.parametrize("name, sets", [("rf_st_rsi", LONG), ("rf_st_rsi_combined", BOTH)])
def test_trades_match_plain(name, sets):
    kinds, reasons, sides = set(), set(), set()
    for seed in (1, 2, 3):
        a = prices(seed)
        series = strategies.Series(a)
        for p in sets:
            for order, value, compound, pyramiding, start in ORDERS:
                o = backtest.Orders(10_000.0, value, order, compound, 0.0004, 0.02, pyramiding, start)
                got = backtest.fold(a, strategies.STRATEGIES[name](series, p), o)
                want = plain(a, p, name.endswith("combined"), order, value, 0.0004, 0.02, pyramiding, compound, start=start)
                own = [(1 if x[1] == "Long" else -1, x[2], x[3], x[4], round(x[5], 6), round(x[6], 6), round(x[7], 9), round(x[8], 6), x[11]) for x in got]
                assert own == want and len(own) > 5
                kinds |= {x[1] for x in own}
                sides |= {x[0] for x in own}
                reasons |= {x[-1] for x in own}
    assert kinds == {"flip", "rsi"} and {"SL", "TP"} <= reasons and (sides == {1, -1}) == name.endswith("combined") == ("REVERSAL" in reasons)


def test_toggles_and_summary(spark):
    """Sides and kinds can be switched off; trades reduce to summary and equity as of any other run."""
    from tickloom.operators import metrics

    a = prices(4)
    series = strategies.Series(a)
    run = lambda p: backtest.fold(a, strategies.STRATEGIES["rf_st_rsi_combined"](series, BOTH[1] | p), backtest.Orders())
    assert {x[1] for x in run({"enableShort": 0})} == {"Long"} and {x[1] for x in run({"enableLong": 0})} == {"Short"}
    assert {x[2] for x in run({"showEntryRSI_L": 0, "showEntryRSI_S": 0})} == {"flip"}
    bars = spark.createDataFrame([("A", "1h", i, *(float(a[c][i]) for c in ("open", "high", "low", "close"))) for i in range(700)], "symbol string, timeframe string, time long, open double, high double, low double, close double")
    runs = [(i, "A", "1h", "rf_st_rsi_combined" if i % 2 else "rf_st_rsi", {k: float(v) for k, v in (BOTH if i % 2 else LONG)[i // 2 % 2].items()}) for i in range(150)]
    sweep = spark.createDataFrame(runs, "run_id long, symbol string, timeframe string, strategy string, params map<string, double>")
    t = backtest.backtest(bars, sweep)
    per_run = {r["run_id"]: r["count"] for r in t.groupBy("run_id").count().collect()}
    assert len(per_run) == 150 and len({per_run[i] for i in range(0, 150, 4)}) == 1
    summary = metrics.run_metrics(t.withColumn("equity", 10_000.0 + F.sum("pnl").over(metrics.by_trade())), 10_000.0).filter("run_id = 1").first()
    assert summary["total_trades"] == per_run[1] and math.isclose(summary["net_profit"], sum(x[8] for x in backtest.fold(a, strategies.STRATEGIES["rf_st_rsi_combined"](series, BOTH[0]), backtest.Orders())), abs_tol=1e-3)
