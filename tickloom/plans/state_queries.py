"""Queries over indicators with a state that stand beside those of bar_queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import recurrence as rec
from tickloom.operators import scan
from tickloom.plans import state_sql
from tickloom.plans.bar_queries import out
from tickloom.plans.registry import REGISTERED, query
from tickloom.sources import derived as d


@query("filter_bands", state_sql.BANDS)
def filter_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rec.filter_bands(d.bars_walk(spark, sf_dir))
    return t.select("symbol", "timeframe", "time", *[F.round(c, 6).alias(c) for c in ("filter", "high_band", "low_band")])


#: Seconds of a chunk: two weeks of bars of an hour.
CHUNK = 14 * 86_400


@query("long_ema", REGISTERED["ema"][1])
def long_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series cut into chunks of time; the statement walks them whole."""
    return out(scan.exponential(d.bars(spark, sf_dir), CHUNK, ema20=20), "ema20")


@query("long_macd", REGISTERED["macd"][1])
def long_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(scan.macd(d.bars(spark, sf_dir), CHUNK), "macd", "macd_signal", "macd_hist")


@query("long_trends", REGISTERED["trend_states"][1])
def long_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scan.trend_states(d.bars_walk(spark, sf_dir), CHUNK)
    return out(t, "up", "dn", "trend", "buy", "sell", "filter", "state", "flip_buy", "flip_sell")
