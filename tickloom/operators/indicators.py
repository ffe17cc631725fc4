"""Indicators that are windows over a series: one window specification, so one sort per (symbol, timeframe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

def series() -> WindowSpec:
    return W.partitionBy("symbol", "timeframe")


def by_time() -> WindowSpec:
    return series().orderBy("time")


def last(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)


def full(c: Column, n: int) -> Column:
    """c where the window has n rows, else null."""
    return F.when(F.row_number().over(by_time()) >= n, c)


def sma(c: Column, n: int, strict: bool = True) -> Column:
    mean = F.avg(c).over(last(n))
    return full(mean, n) if strict else mean


def deviation(c: Column, n: int) -> Column:
    """Sample deviation of the last n values, null unless all are there."""
    return F.when(F.count(c).over(last(n)) == n, F.stddev_samp(c).over(last(n)))


def price_sources() -> list[Column]:
    o, h, lo, c = map(F.col, ("open", "high", "low", "close"))
    return [((h + lo) / 2).alias("hl2"), ((h + lo + c) / 3).alias("hlc3"), ((o + h + lo + c) / 4).alias("ohlc4")]


def change() -> Column:
    return F.col("close") - F.lag("close").over(by_time())


def returns() -> Column:
    before = F.lag("close").over(by_time())
    return F.when(before != 0, F.col("close") / before - 1)


def true_range() -> Column:
    """The largest of three ranges; the first bar has its own only."""
    before = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds tr and atr, the mean of the last n true ranges (null before there are n)."""
    return bars.withColumn("tr", true_range()).withColumn("atr", sma(F.col("tr"), n))


def with_rsi(bars: DataFrame, n: int = 14, epsilon: float | None = None) -> DataFrame:
    """Adds rsi by plain means of gains and losses. epsilon None: no loss gives 100, neither gain nor loss null."""
    d = change()
    t = bars.withColumn("_g", F.when(d > 0, d).otherwise(0.0)).withColumn("_l", F.when(d < 0, -d).otherwise(0.0))
    up, down = sma(F.col("_g"), n), sma(F.col("_l"), n)
    t = t.withColumn("_up", up).withColumn("_down", down)
    if epsilon is None:
        value = F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_up") > 0, 100.0)
    else:
        value = 100 - 100 / (1 + F.col("_up") / (F.col("_down") + epsilon))
    return t.withColumn("rsi", value).drop("_g", "_l", "_up", "_down")


def directional(bars: DataFrame) -> DataFrame:
    """Adds plus_dm and minus_dm; a fall counts against the already masked rise."""
    up, down = F.col("high") - F.lag("high").over(by_time()), F.lag("low").over(by_time()) - F.col("low")
    t = bars.withColumn("_down", down).withColumn("plus_dm", F.when((up > down) & (up > 0), up).otherwise(0.0))
    return t.withColumn("minus_dm", F.when((F.col("_down") > F.col("plus_dm")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)).drop("_down")


def with_adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds adx by rolling sums: directional sums over the sum of atr, then the mean of the directional index."""
    t = directional(with_atr(bars, n))
    ranges = F.when(F.count("atr").over(last(n)) == n, F.sum("atr").over(last(n)))
    t = t.withColumn("_p", 100 * F.sum("plus_dm").over(last(n)) / ranges).withColumn("_m", 100 * F.sum("minus_dm").over(last(n)) / ranges)
    t = t.withColumn("_dx", 100 * F.abs(F.col("_p") - F.col("_m")) / (F.col("_p") + F.col("_m") + 1e-10))
    return t.withColumn("adx", F.when(F.count("_dx").over(last(n)) == n, F.avg("_dx").over(last(n)))).drop("_p", "_m", "_dx")


def with_efficiency(bars: DataFrame, n: int = 20) -> DataFrame:
    t = bars.withColumn("_c", F.abs(change()))
    way = F.when(F.count("_c").over(last(n)) == n, F.sum("_c").over(last(n)))
    return t.withColumn("efficiency", F.abs(F.col("close") - F.lag("close", n).over(by_time())) / (way + 1e-10)).drop("_c")


def with_obv(bars: DataFrame) -> DataFrame:
    t = bars.withColumn("_s", F.coalesce(F.signum(change()) * F.col("volume"), F.lit(0.0)))
    return t.withColumn("obv", F.sum("_s").over(by_time().rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def with_bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid, dev = sma(F.col("close"), n), deviation(F.col("close"), n)
    return bars.withColumn("bb_mid", mid).withColumn("_dev", dev).withColumn("bb_upper", F.col("bb_mid") + width * F.col("_dev")).withColumn("bb_lower", F.col("bb_mid") - width * F.col("_dev")).drop("_dev")


def with_volatility(bars: DataFrame, n: int = 20, periods: int = 252) -> DataFrame:
    t = bars.withColumn("ret", returns())
    return t.withColumn("volatility", deviation(F.col("ret"), n) * F.sqrt(F.lit(float(periods))))


def with_rsi_cross(bars: DataFrame, n: int = 14, mean: int = 9) -> DataFrame:
    """Adds rsi, its mean over at most `mean` bars, and the bars where it crosses above or below that mean."""
    t = with_rsi(bars, n)
    t = t.withColumn("rsi_ma", F.when(F.col("rsi").isNotNull(), F.avg("rsi").over(last(mean))))
    was, was_ma = F.lag("rsi").over(by_time()), F.lag("rsi_ma").over(by_time())
    no = F.lit(False)
    return t.withColumn("cross_up", F.coalesce((was <= was_ma) & (F.col("rsi") > F.col("rsi_ma")), no)).withColumn("cross_down", F.coalesce((was >= was_ma) & (F.col("rsi") < F.col("rsi_ma")), no))


def bars_since(flag: Column) -> Column:
    """Bars since the flag last held (0 on the bar itself), null before."""
    n = F.row_number().over(by_time())
    return n - F.last(F.when(flag, n), ignorenulls=True).over(by_time().rowsBetween(W.unboundedPreceding, 0))


def dual_flip(bars: DataFrame, a: str, b: str, window: int = 8) -> DataFrame:
    """Adds dual_flip: one of two flags holds now and the other one held within the last `window` bars."""
    t = bars.withColumn("_n", F.row_number().over(by_time()))
    so_far = by_time().rowsBetween(W.unboundedPreceding, 0)
    for name, flag in (("_a", a), ("_b", b)):
        t = t.withColumn(name, F.col("_n") - F.last(F.when(F.col(flag), F.col("_n")), ignorenulls=True).over(so_far))
    return t.withColumn("dual_flip", F.coalesce((F.col(a) & (F.col("_b") <= window)) | (F.col(b) & (F.col("_a") <= window)), F.lit(False))).drop("_n", "_a", "_b")


def rsi_segments(bars: DataFrame, bull: bool = True) -> DataFrame:
    """RSI divergences: bull ones over segments from a cross below the mean to the next cross above it, bear ones from a
    cross above to the next one below.

    At the end of a segment its lowest (highest) rsi, and the low (high) at that bar, are held against the segment
    before: a lower low with a higher rsi (a higher high with a lower rsi) is regular, the reverse hidden. Returns
    (symbol, timeframe, time of the cross, kind)."""
    starts, ends, price = ("cross_down", "cross_up", "low") if bull else ("cross_up", "cross_down", "high")
    sign = 1 if bull else -1
    t = with_rsi_cross(bars)
    t = t.withColumn("_seg", F.sum(F.col(starts).cast("int")).over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    closed = F.min(F.when(F.col(ends), F.col("time"))).over(W.partitionBy("symbol", "timeframe", "_seg"))
    t = t.withColumn("_end", closed).filter("_seg > 0 and _end is not null and time < _end")
    t = t.withColumn("_x", sign * F.col("rsi")).withColumn("_p", sign * F.col(price))
    s = t.groupBy("symbol", "timeframe", "_seg").agg(F.min("_x").alias("x"), F.min_by("_p", F.struct("_x", "time")).alias("p"), F.first("_end").alias("time"))
    before = W.partitionBy("symbol", "timeframe").orderBy("_seg")
    x, p = F.lag("x").over(before), F.lag("p").over(before)
    kind = F.when((F.col("p") < p) & (F.col("x") > x), "regular").when((F.col("p") > p) & (F.col("x") < x), "hidden")
    return s.withColumn("kind", kind).filter("kind is not null").select("symbol", "timeframe", "time", "kind")


def in_range(bars: DataFrame, start: str, end: str, warm_up: int = 300) -> DataFrame:
    """Bars up to end, from warm_up bars before the first one at or after start; executing marks those in the range."""
    t = bars.filter(F.col("time") <= F.lit(end).cast("timestamp_ntz")).withColumn("_n", F.row_number().over(by_time()))
    t = t.withColumn("_first", F.min(F.when(F.col("time") >= F.lit(start).cast("timestamp_ntz"), F.col("_n"))).over(series()))
    return t.filter(F.col("_n") >= F.col("_first") - warm_up).withColumn("executing", F.col("_n") >= F.col("_first")).drop("_n", "_first")


def positions(bars: DataFrame, last_n: int | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """The last n bars of each series, or those at positions a <= i < b."""
    if last_n is not None:
        return bars.withColumn("_n", F.row_number().over(series().orderBy(F.desc("time")))).filter(F.col("_n") <= last_n).drop("_n")
    return bars.withColumn("_n", F.row_number().over(by_time()) - 1).filter((F.col("_n") >= span[0]) & (F.col("_n") < span[1])).drop("_n")


def align(low: DataFrame, high: DataFrame, columns: list[str], prefix: str = "htf_") -> DataFrame:
    """As-of join: each bar of low with the last bar of high at or before its time; null before the first.

    Both are keyed by symbol. The sides are laid together and the last row of high is carried on: one shuffle and one
    sort, never a range join."""
    names = [c for c in low.columns if c != "symbol"]
    a = low.select("symbol", F.col("time").alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_low"), F.lit(None).cast(high.select(F.struct("time", *columns).alias("x")).schema["x"].dataType).alias("_high"))
    b = high.select("symbol", F.col("time").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(low.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("_low"), F.struct("time", *columns).alias("_high"))
    seen = F.last("_high", ignorenulls=True).over(W.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    t = a.unionByName(b).withColumn("_high", seen).filter("_side = 1")
    return t.select("symbol", "_low.*", *[F.col(f"_high.{c}").alias(prefix + c) for c in ("time", *columns)])
