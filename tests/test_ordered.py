"""Streams of shuffled bars against the batch kernels."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import recurrence
from tickloom.streaming import ordered

SCHEMA = "symbol string, timeframe string, time timestamp, high double, low double, close double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield spark
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def walk(n, seed):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    return pd.DataFrame({"time": pd.date_range("2024-01-01", periods=n, freq="h"), "high": close + rng.random(n), "low": close - rng.random(n), "close": close})


def stream(spark, path, frame, make, cuts):
    """Five micro-batches; bars are up to five hours out of order, also across batches; repeats; then a far bar."""
    for places in np.array_split(np.arange(len(frame)), cuts):
        spark.createDataFrame(frame.iloc[places], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    far = pd.DataFrame({"symbol": ["A", "B"], "timeframe": "1h", "time": pd.Timestamp("2024-03-01"), "high": 1.0, "low": 1.0, "close": 1.0})
    spark.createDataFrame(far, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in")
    q = make(read).writeStream.format("memory").queryName("got").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table("got").toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)


def shuffled(frame, rng):
    place = np.arange(len(frame)) + rng.integers(0, 5, len(frame)) + 0.1 * rng.random(len(frame))
    return frame.iloc[np.argsort(place)]


def test_a_dead_series_is_forgotten(rocks, tmp_path):
    """After a gap that is longer than its life, a series begins anew."""
    f = walk(40, 7).assign(symbol="A", timeframe="1h")[["symbol", "timeframe", "time", "high", "low", "close"]]
    gap = f.iloc[20:].assign(time=f["time"].iloc[20:] + pd.Timedelta(days=20))
    tick = f.iloc[:1].assign(symbol="B", time=pd.Timestamp("2024-01-15"))  # takes the watermark past the life of A
    got = stream(rocks, str(tmp_path / "d"), pd.concat([f.iloc[:20], tick, tick.assign(time=pd.Timestamp("2024-01-16")), gap]), lambda t: ordered.ordered_indicators(t, dead=3 * 86_400_000), 3)
    g = got[(got["symbol"] == "A") & (got["time"] < "2024-02-25")]
    close = f["close"].to_numpy()
    assert len(g) == 40 and np.allclose(g["ema"], np.concatenate([recurrence.ema(close[:20], 20), recurrence.ema(close[20:], 20)]))


def test_shuffled_bars_equal_the_batch(rocks, tmp_path):
    rng = np.random.default_rng(2)
    own = {s: walk(100, k) for k, s in enumerate("AB")}
    mixed = pd.concat([f.assign(symbol=s, timeframe="1h") for s, f in own.items()]).sort_values("time", kind="stable")[["symbol", "timeframe", "time", "high", "low", "close"]]
    mixed = shuffled(mixed, rng)
    assert not mixed["time"].is_monotonic_increasing
    repeated = pd.concat([mixed, mixed.iloc[50:60].assign(close=0.0)])  # late beyond the watermark by then: dropped
    got = stream(rocks, str(tmp_path / "i"), repeated, ordered.ordered_indicators, 5)
    assert len(got) == 200
    for s, f in own.items():
        g = got[got["symbol"] == s]
        close = f["close"].to_numpy()
        assert np.allclose(g["close"], close) and np.allclose(g["ema"], recurrence.ema(close, 20)) and np.allclose(g["rsi"], recurrence.wilder_rsi(close, 14))
    got = stream(rocks, str(tmp_path / "t"), mixed, ordered.ordered_trends, 5)
    for s, f in own.items():
        g, (high, low, close) = got[got["symbol"] == s], (f[c].to_numpy() for c in ("high", "low", "close"))
        st = recurrence.supertrend((high + low) / 2, close, recurrence.rma(recurrence.true_range(high, low, close), 10), 3.0)
        rf = recurrence.range_filter(close, recurrence.smooth_range(close, 20, 2.5))
        assert len(g) == 100 and (g["trend"] == st["trend"]).all() and (g["state"] == rf["state"]).all()
        assert all(np.allclose(g[c], x) for c, x in (("up", st["up"]), ("dn", st["dn"]), ("filter", rf["filter"])))
