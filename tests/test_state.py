"""Recurrences, the backtest fold, sources and streams against plain loops and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, genomes, metrics, recurrence, runs, strategies
from tickloom.sources import bars as sources
from tickloom.streaming import bars as streams


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(42)
    close = 100 + np.cumsum(rng.normal(0, 1, 400))
    spread = rng.random((2, 400))
    return {"open": close + 0.1, "high": close + spread[0], "low": close - spread[1], "close": close}


def test_means_match_pandas(walk):
    s = pd.Series(walk["close"])
    assert np.allclose(recurrence.ema(walk["close"], 20), s.ewm(span=20, adjust=False).mean())
    x = recurrence.rma(walk["close"], 14)
    assert np.isnan(x[:13]).all() and np.isclose(x[13], s[:14].mean()) and np.isclose(x[14], x[13] * 13 / 14 + s[14] / 14)
    y = recurrence.rma(walk["close"], 14, compat=True)
    assert np.isclose(y[14], (y[13] * 14 + s[14]) / 14)
    gap = np.r_[np.nan, np.nan, walk["close"]]
    assert np.allclose(recurrence.ema(gap, 9)[2:], recurrence.ema(walk["close"], 9)) and np.isnan(recurrence.ema(gap, 9)[:2]).all()


def test_wilder_rsi(walk):
    x = recurrence.wilder_rsi(walk["close"], 14)
    assert (x[:13] == 50).all() and ((x >= 0) & (x <= 100)).all()
    assert (recurrence.wilder_rsi(np.arange(50.0), 14)[13:] == 100).all() and (recurrence.wilder_rsi(-np.arange(50.0), 14)[14:] == 0).all()


def test_supertrend_holds_its_rules(walk):
    h, lo, c = walk["high"], walk["low"], walk["close"]
    s = recurrence.supertrend((h + lo) / 2, c, recurrence.rma(recurrence.true_range(h, lo, c), 10), 3.0)
    for i in range(1, len(c)):
        if c[i - 1] > s["up"][i - 1]:
            assert s["up"][i] >= s["up"][i - 1]
        if s["trend"][i] != s["trend"][i - 1]:
            assert (c[i] > s["dn"][i - 1]) if s["trend"][i] == 1 else (c[i] < s["up"][i - 1])
    assert s["buy"].sum() + s["sell"].sum() == (np.diff(s["trend"]) != 0).sum() > 0


def test_range_filter_stays_within_its_range(walk):
    rng = recurrence.smooth_range(walk["close"], 20, 2.0)
    for counters in (False, True):
        f = recurrence.range_filter(walk["close"], rng, counters)
        assert (np.abs(walk["close"] - f["filter"]) <= rng + 1e-9).all()
        flips = np.flatnonzero(f["flip_buy"] | f["flip_sell"])
        assert len(flips) and all(f["state"][i] == -f["state"][i - 1] for i in flips)


def test_fold_accounts_for_every_trade(walk):
    rules = strategies.STRATEGIES["ema_cross"](strategies.Series(walk), {"fast": 5, "slow": 20})
    done = backtest.fold(walk, rules, backtest.Orders())
    assert len(done) > 3
    equity = 10_000.0
    for no, side, kind, a, b, entry, leave, size, pnl, fee_in, fee_out, why in done:
        assert a <= b and entry == round(walk["open"][a], 6) and leave == walk["close"][b] and (rules.exit[b] or why == "EOD") and side == "Long"
        assert np.isclose(size * entry, equity * 0.1)
        equity -= fee_in
        assert np.isclose(pnl, (leave - entry) * size - fee_out)
        equity += pnl
    assert all(x[3] <= y[4] for x, y in zip(done, done[1:], strict=False))


def test_backtest_is_deterministic_and_rejects_unknown(spark, walk):
    frame = pd.DataFrame(walk)
    frame.insert(0, "time", pd.date_range("2024-01-01", periods=400, freq="h"))
    bars = spark.createDataFrame(frame).withColumn("symbol", F.lit("A")).withColumn("timeframe", F.lit("1h"))
    sweep = spark.createDataFrame([(i, "A", "1h", "ema_cross", {"fast": float(5 + i), "slow": 30.0}) for i in range(6)], "run_id long, symbol string, timeframe string, strategy string, params map<string, double>")
    one, two = backtest.backtest(bars, sweep), backtest.backtest(bars, sweep)
    assert one.count() > 6 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    with pytest.raises(ValueError):
        backtest.backtest(bars, sweep.withColumn("strategy", F.lit("none")))


def test_erf():
    from math import erf

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    xs = [-2.0, -0.5, 0.0, 0.3, 1.0, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(metrics.erf(F.col("x"))).collect()]
    assert np.allclose(got, [erf(x) for x in xs], atol=2e-7)


def test_repaired_genomes_have_fewer_faults(spark):
    from tickloom.sources.derived import genomes as sample

    data = "/root/testdata/sf0.001"
    try:
        g = sample(spark, data)
    except Exception:
        pytest.skip("no test data")
    before = genomes.validated(g).agg(F.sum("n_violations")).first()[0]
    after = genomes.validated(genomes.repaired(g)).agg(F.sum("n_violations")).first()[0]
    assert after < before
    missing = genomes.validated(g.withColumn("sl", F.lit(None).cast(g.schema["sl"].dataType))).first()
    assert missing["violations"] == ["missing sl"] and not missing["valid"]


def test_pareto_front(spark):
    rows = [(1, 5.0, 1.0, 50.0, 10.0), (2, 4.0, 1.0, 50.0, 10.0), (3, 1.0, 2.0, 50.0, 10.0), (4, 5.0, 1.0, 50.0, 10.0)]
    df = spark.createDataFrame(rows, "run_id long, net_profit_pct double, sharpe double, winrate double, max_drawdown_pct double")
    assert {r["run_id"] for r in runs.pareto_front(df).collect()} == {1, 3, 4}


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "AAA").mkdir()
    head = "time,open,high,low,close,volume\n"
    (tmp_path / "AAA/1h.csv").write_text(head + "1704067200000,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n-5,1,1,1,1,1\n1704070800000000,2,3,1,x,5\n")
    (tmp_path / "AAA_1h.csv").write_text(head + "1704067200000,9,9,9,9,9\n")
    (tmp_path / "B_B_4h.csv").write_text(head + "1704067200000,7,7,7,7,7\n")
    got = sorted((r["symbol"], r["timeframe"], str(r["time"]), r["open"], r["close"]) for r in sources.read_csv(spark, str(tmp_path)).collect())
    assert got == [("AAA", "1h", "2024-01-01 00:00:00", 1.0, 1.5), ("AAA", "1h", "2024-01-01 01:00:00", 2.0, None), ("B_B", "4h", "2024-01-01 00:00:00", 7.0, 7.0)]
    sources.write_bars(sources.read_csv(spark, str(tmp_path)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and {(r["symbol"], r["timeframe"]) for r in sources.catalogue(back).collect()} == {("AAA", "1h"), ("B_B", "4h")}


def test_stream_equals_batch(spark, tmp_path, walk):
    prices = {k: walk[k][:120] for k in ("high", "low", "close")}
    frame = pd.DataFrame({"symbol": "A", "timeframe": "1h", "time": pd.date_range("2024-01-01", periods=120, freq="h"), **prices})
    schema = "symbol string, timeframe string, time timestamp, high double, low double, close double"
    for i in range(3):
        part = pd.concat([frame[i * 40 : (i + 1) * 40], frame[i * 40 : i * 40 + 2]])  # with repeats
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(streams.incremental_indicators(read()), "indicators").orderBy("time").toPandas()
    assert len(got) == 120
    assert np.allclose(got["ema"], recurrence.ema(walk["close"][:120], 20)) and np.allclose(got["rsi"], recurrence.wilder_rsi(walk["close"][:120], 14))
    assert run(streams.deduplicated(read(), "200 hours"), "deduplicated").count() == 120
    high, low, close = prices.values()
    st = recurrence.supertrend((high + low) / 2, close, recurrence.rma(recurrence.true_range(high, low, close), 10), 3.0)
    rf = recurrence.range_filter(close, recurrence.smooth_range(close, 20, 2.5))
    got = run(streams.incremental_trends(read()), "trends").orderBy("time").toPandas()
    assert len(got) == 120 and (got["trend"] == st["trend"]).all() and (got["state"] == rf["state"]).all() and len(set(got["state"])) > 1
    assert all(np.allclose(got[c], x) for c, x in (("up", st["up"]), ("dn", st["dn"]), ("filter", rf["filter"])))


def test_diverse_genomes_are_found_below_a_crowded_top(spark):
    """Six hundred near clones at the top, then genomes that are apart; against the whole walk."""
    import numpy as np

    from tickloom.operators import genomes

    rng = np.random.default_rng(3)
    x = np.concatenate([0.5 + rng.random((600, 4)) * 0.01, rng.random((300, 4))])
    rows = [(i, float(1000 - i), v.tolist()) for i, v in enumerate(x)]
    got = genomes.diverse(spark.createDataFrame(rows, "genome_id long, score double, vec array<double>"), 20, by="euclidean").collect()
    kept = []
    for i in range(len(x)):
        if len(kept) < 20 and all(np.sqrt(((x[k] - x[i]) ** 2).mean()) >= 0.15 for k in kept):
            kept.append(i)
    assert len(kept) == 20 and sorted(r["genome_id"] for r in got) == kept


def test_all_apart_genomes_are_kept(spark):
    """No limit; both distances; against the whole walk, over several rounds."""
    rng = np.random.default_rng(5)
    x = rng.random((700, 3))
    rows = [(i, float(i % 97), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "genome_id long, score double, vec array<double>")
    for by, far in (("mean", lambda a, b: np.abs(a - b).mean()), ("euclidean", lambda a, b: np.sqrt(((a - b) ** 2).mean()))):
        kept = []
        for i in sorted(range(700), key=lambda i: (-(i % 97), i)):
            if all(far(x[k], x[i]) >= 0.15 for k in kept):
                kept.append(i)
        got = [r["genome_id"] for r in genomes.diverse(df, per_block=60, by=by).collect()]
        assert sorted(got) == sorted(kept) and len(kept) > 10


def test_directional_matches_pandas(walk):
    s = {k: pd.Series(v) for k, v in walk.items()}
    up, down = s["high"].diff(), -s["low"].diff()
    up = up.where((up > down) & (up > 0), 0)
    down = down.where((down > up) & (down > 0), 0)
    tr = pd.concat([s["high"] - s["low"], (s["high"] - s["close"].shift()).abs(), (s["low"] - s["close"].shift()).abs()], axis=1).max(axis=1)
    mean = lambda x: x.ewm(span=14, adjust=False).mean()
    ranges = mean(tr.rolling(14).mean())
    p, m = 100 * mean(up) / ranges, 100 * mean(down) / ranges
    adx = mean(100 * (p - m).abs() / (p + m + 1e-10))
    for got, want in zip(recurrence.directional(walk["high"], walk["low"], walk["close"]), (adx, p, m), strict=True):
        assert np.allclose(got, want, equal_nan=True)


def test_queries_in_blocks_meet_all_rows(spark):
    from tickloom.operators import leaderboard

    rows, asked = spark.range(50), spark.range(23).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query_vec"))
    got = leaderboard.against_all(rows, asked, per_block=5)
    assert got.count() == 50 * 23 == got.select("id", "query_id").distinct().count()


def test_crowding_and_fronts_in_small_parts(spark):
    """Many buckets and cells give what one gives; values that many genomes share too."""
    rng = np.random.default_rng(6)
    x = np.round(rng.random((300, 3)), 2)
    x[:120, 0] = 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "genome_id long, vec array<double>")
    want = np.zeros(300)
    for k in range(3):
        order = np.lexsort((np.arange(300), x[:, k]))
        v = x[order, k]
        gaps = np.r_[np.inf, (v[2:] - v[:-2]) / (v[-1] - v[0]), np.inf]
        want[order] += gaps
    for size in (50_000, 7):
        got = {r["genome_id"]: r["crowding"] for r in genomes.crowding(df, size).collect()}
        assert all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-5 for i in range(300))
    rows = [(i, *map(float, v)) for i, v in enumerate(np.round(rng.random((400, 4)), 1))]
    t = spark.createDataFrame(rows, "run_id long, net_profit_pct double, sharpe double, winrate double, max_drawdown_pct double")
    front = {i for i, *a in rows if not any(all(y >= z for y, z in zip((*b[:3], -b[3]), (*a[:3], -a[3]), strict=True)) and b != a for _, *b in rows)}
    for size in (2000, 15):
        assert {r["run_id"] for r in runs.pareto_front(t, per_block=size).collect()} == front
