"""Tables on disk: the leaderboard's upsert and bucketed bars."""

import glob
import os

from pyspark.sql import functions as F

from tickloom.operators import indicators, leaderboard, recurrence
from tickloom.sources import bars as sources
from tickloom.sources import board, derived

SF = "/root/testdata/sf0.001"


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(str, df.select("symbol", "timeframe", "genome_hash", "score", "ts", "source", "test_count", "stability").collect()))


def test_only_touched_folders_are_written_and_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "board")
    t = derived.leaderboard(spark, SF)
    assert board.stored(spark, path) is None
    board.store(t.filter("ts % 2 = 0"), path, 0)
    first = files(path)
    part = t.filter("symbol = 'S1' and ts % 120 in (20, 80, 60, 0)")
    board.store(part, path, 1)
    second = files(path)
    kept = {f for f in first if "symbol=S1" not in f}
    assert kept and all(second.get(f) == first[f] for f in kept) and set(second) != set(first)
    want = rows(leaderboard.upserted(t.filter("ts % 2 = 0"), part))
    assert rows(board.stored(spark, path)) == want
    board.store(part, path, 1)  # the same batch again
    board.store(part.limit(3), path, 1)
    assert rows(board.stored(spark, path)) == want
    board.store(part, path, 2)  # a later batch counts
    assert rows(board.stored(spark, path)) != want


def test_the_stream_writes_what_the_batches_write(spark, tmp_path):
    t = derived.leaderboard(spark, SF)
    for k in range(2):
        t.filter(f"ts % 4 = {2 * k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = board.store_stream(read, str(tmp_path / "board"), str(tmp_path / "c"))
    assert q.awaitTermination(240)
    got = board.stored(spark, str(tmp_path / "board"))
    assert got.count() == t.filter("ts % 2 = 0").select(*leaderboard.KEY, "genome_hash").distinct().count()


def test_bucketed_bars_are_read_without_an_exchange(spark):
    saved = sources.save_bucketed(derived.bars_walk(spark, SF), "bars_in_buckets", 4)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        for df in (indicators.with_atr(saved), indicators.with_bollinger(saved), indicators.with_adx(saved), recurrence.exponential(saved, e=20), recurrence.trend_states(saved)):
            assert "Exchange" not in plan(df) and df.count() == saved.count()
        both = saved.groupBy("symbol", "timeframe").agg(F.count("*").alias("n")).join(saved, ["symbol", "timeframe"])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        assert "Exchange" not in plan(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bars_in_buckets")


def test_trades_as_csv(spark, tmp_path):
    t = derived.trades(spark, SF)
    sources.write_trades(t, str(tmp_path / "trades"))
    back = spark.read.option("header", True).option("timestampFormat", sources.TIMES).option("timestampNTZFormat", sources.TIMES).schema(t.schema).csv(str(tmp_path / "trades"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
