"""Chunked recurrences against the kernels that walk a whole series."""

import numpy as np
import pytest

from tickloom.operators import recurrence as rec
from tickloom.operators import scan

HOUR = 3600


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("A", 730), ("B", 95), ("C", 1)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            t = i + (i // 37) * 5  # gaps
            rows.append((name, "1h", t * HOUR, *map(float, (close[i] - 0.1, close[i] + abs(rng.normal()), close[i] - abs(rng.normal()), close[i], 1.0))))
    df = spark.createDataFrame(rows, "symbol string, timeframe string, s long, open double, high double, low double, close double, volume double")
    return df.selectExpr("symbol", "timeframe", "timestamp_seconds(s) as time", "open", "high", "low", "close", "volume").cache()


def same(got, want, columns):
    a, b = (t.toPandas().sort_values(["symbol", "time"]).reset_index(drop=True) for t in (got, want))
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), c


def test_linear_recurrences_in_chunks_of_100_bars(bars):
    same(scan.exponential(bars, 100 * HOUR, e5=5, e200=200), rec.exponential(bars, e5=5, e200=200), ["e5", "e200"])
    same(scan.macd(bars, 100 * HOUR), rec.macd(bars), ["macd", "macd_signal", "macd_hist"])
    for n in (14, 120):  # the seed spans chunks
        same(scan.wilder(bars, 50 * HOUR, n), rec.wilder(bars, n), ["wilder_rsi", "wilder_atr"])


def test_trends_in_chunks_of_50_bars(bars):
    columns = ["up", "dn", "trend", "buy", "sell", "filter", "state", "flip_buy", "flip_sell"]
    told = {}
    same(scan.trend_states(bars, 50 * HOUR, told=told), rec.trend_states(bars), columns)
    assert told["whole"] == 0 and told["walked"] < 4
    same(scan.trend_states(bars, 50 * HOUR, rounds=1, told=told), rec.trend_states(bars), columns)
    assert 0 < told["whole"] <= 1  # these series were walked as a whole


def test_no_bars(bars):
    assert scan.wilder(bars.limit(0), HOUR).count() == 0 and scan.trend_states(bars.limit(0), HOUR).count() == 0


def test_a_series_is_many_tasks(bars):
    held = scan.chunks(bars, 50 * HOUR)
    n = held.groupBy(*scan.AT).count().filter("symbol = 'A'").collect()
    assert len(n) > 14 and max(r["count"] for r in n) <= 50


def test_carried_equals_the_loop():
    x = np.random.default_rng(1).normal(size=1000)
    assert np.allclose(scan.carried(x, 0.99, 5.0), rec.linear(x, 0.99, 5.0), atol=1e-12) and len(scan.carried(x[:0], 0.5, 1.0)) == 0
