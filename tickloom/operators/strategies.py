"""Strategies: what every bar of a series offers to each side, and the rules by which positions are entered and left.

What bars offer is computed for a whole series at once, in NumPy, and shared by all runs with equal parameters; the rules
walk over it bar by bar, since an exit depends on the entry before it. Long is 1 and short is -1 throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tickloom.operators import recurrence as rec

#: Sources of an indicator, by the number that parameters name them with.
SOURCES = ("close", "hl2", "hlc3", "ohlc4")


class Series:
    """One series' prices and the indicators that its runs have asked for."""

    def __init__(self, a: dict[str, np.ndarray]) -> None:
        self.a, self.known = a, {}
        high, low, close = a["high"], a["low"], a["close"]
        self.sources = {"close": close, "hl2": (high + low) / 2, "hlc3": (high + low + close) / 3, "ohlc4": (a["open"] + high + low + close) / 4}

    def shared(self, make: Callable, *args):
        if (key := (make.__name__, *args)) not in self.known:
            self.known[key] = make(self, *args)
        return self.known[key]

    def trend(self, period: float, mult: float, source: float = 1, wilder: float = 1) -> dict[str, np.ndarray]:
        return self.shared(_trend, int(period), float(mult), SOURCES[int(source)], bool(wilder))

    def filter(self, period: float, mult: float, source: float = 0, counters: bool = False, need_move: bool = True) -> dict[str, np.ndarray]:
        return self.shared(_filter, int(period), float(mult), SOURCES[int(source)], counters, need_move)

    def momentum(self, length: float, mean: float) -> dict[str, np.ndarray]:
        return self.shared(_momentum, int(length), int(mean))


def _trend(s: Series, period: int, mult: float, source: str, wilder: bool) -> dict[str, np.ndarray]:
    tr = rec.true_range(s.a["high"], s.a["low"], s.a["close"])
    return rec.supertrend(s.sources[source], s.a["close"], rec.warmed(tr, period, 1 / period) if wilder else running_mean(tr, period), mult)


def _filter(s: Series, period: int, mult: float, source: str, counters: bool, need_move: bool) -> dict[str, np.ndarray]:
    src = s.sources[source]
    moves = np.abs(np.diff(src, prepend=src[:1]))
    twice = 2 * period - 1
    rng = rec.warmed(rec.warmed(moves, period, 2 / (period + 1)), twice, 2 / (twice + 1)) * mult
    out = rec.range_filter(src, rng, counters, need_move)
    return out | {"low": out["filter"] - rng, "high": out["filter"] + rng}


def running_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last n values, of all where there are fewer."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(1, len(x) + 1)
    return (total[at] - total[np.maximum(at - n, 0)]) / np.minimum(at, n)


def _momentum(s: Series, length: int, mean: int) -> dict[str, np.ndarray]:
    """RSI (50 on the first bar), and the divergences of its swings from the prices' for both sides."""
    close = s.a["close"]
    if len(close) < 2:
        none = np.zeros(len(close), bool)
        return {"rsi": np.full(len(close), 50.0), "up": none, "down": none, 1: none, -1: none}
    d = np.diff(close)
    up, down = (rec.warmed(np.maximum(sign * d, 0.0), length, 1 / length) for sign in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(down == 0, 100.0, np.where(up == 0, 0.0, 100 - 100 / (1 + up / down)))
    signal = np.array([rsi[max(0, i - mean + 1) : i + 1].sum() / min(i + 1, mean) for i in range(len(rsi))])
    crossed = lambda x, m: np.r_[False, False, (x[:-1] <= m[:-1]) & (x[1:] > m[1:])]
    rises, falls = crossed(rsi, signal), crossed(-rsi, -signal)
    full = np.r_[50.0, rsi]
    return {"rsi": full, "up": rises, "down": falls, 1: divergence(falls, rises, full, s.a["low"]), -1: divergence(rises, falls, -full, -s.a["high"])}


def divergence(starts: np.ndarray, ends: np.ndarray, oscillator: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Ends of swings whose lowest oscillator moved the other way than the price of the same bar, against the swing before.

    A swing begins with the last start since the end before it."""
    out, last, before = np.zeros(len(starts), bool), None, None
    for i in np.flatnonzero(starts | ends):
        if starts[i]:
            last = i
        elif last is not None:
            k = last + int(np.argmin(oscillator[last : i + 1]))
            now, last = (oscillator[k], price[k]), None
            out[i] = before is not None and (now[0] - before[0]) * (now[1] - before[1]) < 0
            before = now
    return out


def bars_since(flag: np.ndarray) -> np.ndarray:
    """Bars since flag was last set (0 on that bar); very many before the first."""
    n = np.arange(len(flag))
    return n - np.maximum.accumulate(np.where(flag, n, -(10**6)))


@dataclass
class Offers:
    """One side's facts of every bar: entries of both kinds that are allowed and have a risk, whether the side is wanted
    at all (which turns the other side around), the stop band, whether filter and trend have both turned against the
    side, and for each kind the turns that may take a profit and the multiple of the risk that it takes."""

    flip: np.ndarray
    rsi: np.ndarray
    wanted: np.ndarray
    band: np.ndarray
    against: np.ndarray
    turns: dict[str, np.ndarray]
    reward: dict[str, float]


class Rules:
    """At most one entry of each side is held. needs_position: exits are only looked for while a position is open."""

    needs_position = False

    def __init__(self, close: np.ndarray, offers: dict[int, Offers], moving_stop: bool, reverses: bool) -> None:
        self.close, self.offers, self.moving_stop, self.reverses = close, offers, moving_stop, reverses
        self.held: dict[int, tuple[str, float, float]] = {}  # side -> kind, price, band at the entry
        self.needs_position = not reverses

    def leave(self, i: int) -> tuple[int, str, str] | None:
        """(side, kind of the entry, reason) of the position to close on bar i."""
        if i < 1:
            return None
        if self.reverses:
            for side in (1, -1):
                if side in self.held and -side in self.offers and self.offers[-side].wanted[i]:
                    return side, self.held.pop(side)[0], "REVERSAL"
        for kind in ("flip", "rsi"):
            for side in (1, -1):
                if side in self.held and self.held[side][0] == kind and (why := self.ends(i, side)):
                    self.held.pop(side)
                    return side, kind, why
        return None

    def ends(self, i: int, side: int) -> str | None:
        kind, price, band = self.held[side]
        o, close = self.offers[side], self.close[i]
        profit, risk = side * (close - price), side * (price - band)
        stop = o.band[i] if self.moving_stop and kind == "flip" else band
        stopped = side * (close - stop) <= 0
        if kind == "flip":
            stopped = stopped or o.against[i]
        else:
            stopped = risk > 0 and (stopped or (o.against[i] and profit <= 0))
        return "SL" if stopped else "TP" if o.turns[kind][i] and profit > risk * o.reward[kind] else None

    def enter(self, i: int) -> tuple[int, str] | None:
        """(side, kind) of the entry that bar i signals; it counts as held from here on."""
        if i < 1:
            return None
        for kind in ("flip", "rsi"):
            for side, o in self.offers.items():
                if side not in self.held and getattr(o, kind)[i]:
                    self.held[side] = kind, self.close[i], o.band[i]
                    return side, kind
        return None


class Crossing:
    """Entries and exits that don't depend on each other."""

    needs_position = True

    def __init__(self, entry: np.ndarray, exit_: np.ndarray) -> None:
        self.entry, self.exit = entry, exit_

    def leave(self, i: int) -> tuple[int, str, str] | None:
        return (1, "cross", "signal") if self.exit[i] else None

    def enter(self, i: int) -> tuple[int, str] | None:
        return (1, "cross") if self.entry[i] else None


#: name -> function of (series, parameters) to its rules.
STRATEGIES: dict[str, Callable[[Series, dict], Rules | Crossing]] = {}


def strategy(name: str) -> Callable:
    def keep(f: Callable) -> Callable:
        STRATEGIES[name] = f
        return f

    return keep


@strategy("ema_cross")
def ema_cross(s: Series, p: dict) -> Crossing:
    fast, slow = rec.ema(s.a["close"], int(p["fast"])), rec.ema(s.a["close"], int(p["slow"]))
    was_below, was_above = np.r_[False, (fast <= slow)[:-1]], np.r_[False, (fast >= slow)[:-1]]
    return Crossing(was_below & (fast > slow), was_above & (fast < slow))


def turned(x: dict[str, np.ndarray], side: int, buy: str, sell: str) -> np.ndarray:
    return x[buy] if side > 0 else x[sell]


def both_turn(trend: dict, rf: dict, side: int, within: int) -> np.ndarray:
    """One of the two turns to the side now, the other one did `within` bars ago at most."""
    t, f = turned(trend, side, "buy", "sell"), turned(rf, side, "flip_buy", "flip_sell")
    return (f & (bars_since(t) <= within)) | (t & (bars_since(f) <= within))


@strategy("rf_st_rsi")
def long_only(s: Series, p: dict) -> Rules:
    """Long entries when supertrend and range filter turn up within 8 bars, or on an RSI divergence, above a rising
    filter. The stop is the slower filter's band at the entry, or filter and trend of the stop turning down together."""
    g, close = p.get, s.a["close"]
    trend = s.trend(g("st_atrPeriod", 10), g("st_mult", 2.0), g("st_src", 1), g("st_useATR", 1))
    rf = s.filter(g("rf_period", 100), g("rf_mult", 3.0), g("rf_src", 0))
    stop_trend = s.trend(g("sl_st_atrPeriod", 10), g("sl_st_mult", 4.0), g("sl_st_src", 1), g("sl_st_useATR", 1))
    stop = s.filter(g("sl_rf_period", 100), g("sl_rf_mult", 7.0), g("rf_src", 0), counters=True)
    profit = {"flip": s.trend(g("tp_dual_st_atrPeriod", 10), g("tp_dual_st_mult", 2.0), g("st_src", 1)), "rsi": s.trend(g("tp_rsi_st_atrPeriod", 10), g("tp_rsi_st_mult", 2.0), g("st_src", 1))}
    rising, divergent = rf["state"] == 1, s.momentum(g("rsi_length", 14), g("rsi_ma_length", 6))[1]
    none = np.zeros(len(close), bool)
    flip = both_turn(trend, rf, 1, 8) & rising & (close > rf["low"]) if g("showDualFlip", 1) else none
    rsi = divergent & rising & (close > stop["low"]) if g("showRSI", 1) else none
    against = (stop["flip_sell"] & (stop_trend["trend"] == -1)) | (stop_trend["sell"] & (stop["state"] == -1))
    reward = {"flip": g("tp_dual_rr_mult", 1.3), "rsi": g("tp_rsi_rr_mult", 1.3)}
    offers = Offers(flip, rsi, flip | rsi, stop["low"], against, {k: x["sell"] for k, x in profit.items()}, reward)
    return Rules(close, {1: offers}, moving_stop=False, reverses=False)


#: The combined strategy's defaults that differ between its sides.
SIDES = {1: {"bars": 8, "st_sl_mult": 3.0, "rf_sl_mult": 15.0, "rr": 4.0}, -1: {"bars": 12, "st_sl_mult": 2.0, "rf_sl_mult": 3.0, "rr": 0.75}}


@strategy("rf_st_rsi_combined")
def long_and_short(s: Series, p: dict) -> Rules:
    """Both sides by mirrored rules; a signal of one side ends the other side's position. The stop of dual flips moves
    with the filter's band, and the main filter's state confirms the stop trend's turns. Short dual flips don't ask for a
    falling filter."""
    g, close = p.get, s.a["close"]
    trend = s.trend(g("st_atrPeriod", 10), g("st_mult", 2.0), g("st_src", 1), g("st_changeATR", 1))
    rf = s.filter(g("rf_period", 100), g("rf_mult", 3.0), g("rf_src_in", 0))
    divergent = s.momentum(g("lenRSI", 14), g("lenMA", 6))
    none, offers = np.zeros(len(close), bool), {}
    for side, (own, name) in {1: ("L", "Long"), -1: ("S", "Short")}.items():
        if not g(f"enable{name}", 1):
            continue
        fixed = SIDES[side]
        stop_trend = s.trend(g(f"st_sl_atrPeriod_{own}", 10), g(f"st_sl_mult_{own}", fixed["st_sl_mult"]), g(f"st_sl_src_{own}", 1), g(f"st_sl_useATR_{own}", 1))
        stop = s.filter(g(f"rf_sl_period_{own}", 20), g(f"rf_sl_mult_{own}", fixed["rf_sl_mult"]), g("rf_src_in", 0), counters=True, need_move=False)
        edge = "low" if side > 0 else "high"
        confirmed = rf["state"] == side
        signal = both_turn(trend, rf, side, int(g(f"dualFlipBars{name}", fixed["bars"])) - 1) & (confirmed if side > 0 else True)
        signal = signal if g(f"showEntry{name}", 1) else none
        rsi = divergent[side] & confirmed & (side * (close - stop[edge]) > 0) if g(f"showEntryRSI_{own}", 1) else none
        against = (turned(stop, -side, "flip_buy", "flip_sell") & (stop_trend["trend"] == -side)) | (turned(stop_trend, -side, "buy", "sell") & (rf["state"] == -side))
        turns = {k: turned(s.trend(g(f"{n}_period_{own}", 10), g(f"{n}_mult_{own}", 2.0), g("st_src", 1)), -side, "buy", "sell") for k, n in (("flip", "st_tp_dual"), ("rsi", "st_tp_rsi1"))}
        reward = {"flip": g(f"rr_mult_dual_{own}", fixed["rr"]), "rsi": g(f"rr_mult_rsi1_{own}", fixed["rr"])}
        offers[side] = Offers(signal & (side * (close - rf[edge]) > 0), rsi, signal | rsi, stop[edge], against, turns, reward)
    return Rules(close, offers, moving_stop=True, reverses=True)
