"""Reading and writing of bars: CSV layouts, landed klines, merges, partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VALUES = ("open", "high", "low", "close", "volume")
CSV = "time string, open string, high string, low string, close string, volume string"
#: The last time that is believed, and the size from which a time counts microseconds.
LAST_MS, MICROS = 4_102_444_800_000, 1e13
BARS = ("symbol", "timeframe", "time", *VALUES)


def epoch_time(raw: Column) -> Column:
    """Epoch milliseconds (or microseconds) as text -> time; null for what isn't a number or lies outside 1970 to 2100."""
    n = raw.try_cast("double")
    ms = F.when(n > MICROS, F.floor(n / 1000)).otherwise(F.floor(n))
    good = F.when(ms.between(0, LAST_MS), ms)
    return F.timestamp_add("MILLISECOND", good, F.lit("1970-01-01").cast("timestamp_ntz"))


def normalised(raw: DataFrame) -> DataFrame:
    """Text columns -> typed bars; rows without a good time go."""
    t = raw.withColumn("time", epoch_time(F.col("time"))).filter("time is not null")
    return t.select(*[F.col(c).try_cast("double").alias(c) if c in VALUES else F.col(c) for c in t.columns])


def read_csv(spark: SparkSession, root: str) -> DataFrame:
    """All of root/{symbol}/{timeframe}.csv and root/{symbol}_{timeframe}.csv; where a series has both, the first counts.

    The series come from the files' names, so a filter on symbol or timeframe reads no column for it."""
    options = {"header": "true", "mode": "PERMISSIVE"}
    path = F.col("_metadata.file_path")
    raw = spark.read.options(**options, recursiveFileLookup="true", pathGlobFilter="*.csv").schema(CSV).csv(root).select("*", path.alias("_path"))
    inner = F.regexp_extract("_path", r"([^/]+)/([^/_]+)\.csv$", 2)
    nested = inner != ""
    t = raw.withColumn("symbol", F.when(nested, F.regexp_extract("_path", r"([^/]+)/[^/]+\.csv$", 1)).otherwise(F.regexp_extract("_path", r"([^/]+)_[^/_]+\.csv$", 1)))
    t = t.withColumn("timeframe", F.when(nested, inner).otherwise(F.regexp_extract("_path", r"_([^/_]+)\.csv$", 1))).withColumn("_nested", nested)
    has = F.max("_nested").over(W.partitionBy("symbol", "timeframe"))
    return normalised(t.withColumn("_has", has).filter(F.col("_nested") | ~F.col("_has")).drop("_path", "_nested", "_has")).select(*BARS)


def one_each(bars: DataFrame, order: list[Column], keys: tuple[str, ...] = ("symbol", "timeframe", "time")) -> DataFrame:
    """Of rows with one time the first in the given order."""
    return bars.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def merged(raw: DataFrame, file: str = "file", row: str = "row") -> DataFrame:
    """Raw files laid together: open_time is another name of time, of equal times the last row of the last file stays."""
    t = raw.withColumnRenamed("open_time", "time") if "open_time" in raw.columns else raw
    return one_each(t, [F.desc(file), F.desc(row)]).drop(file, row)


def from_klines(landed: DataFrame, column: str = "kline") -> DataFrame:
    """Landed 12-value arrays (of text) -> bars; of equal times the first stays. landed: symbol, timeframe, position, kline."""
    names = ("time", *VALUES)
    t = landed.select("symbol", "timeframe", "position", *[F.get(column, i).alias(c) for i, c in enumerate(names)])
    return one_each(normalised(t), [F.asc("position")]).select(*BARS)


def catalogue(bars: DataFrame) -> DataFrame:
    """The series there are."""
    return bars.select("symbol", "timeframe").distinct()


def write_bars(bars: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Bars in folders by symbol and timeframe, sorted by time within files; only the touched series are overwritten."""
    out = bars.repartition("symbol", "timeframe").sortWithinPartitions("symbol", "timeframe", "time")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("header", "true").partitionBy("symbol", "timeframe").format(kind).save(path)


def save_bucketed(bars: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Bars as a table of the catalogue in buckets by (symbol, timeframe), sorted by time within them.

    Windows, groups and joins by symbol and timeframe read it without an exchange, as each bucket is one task's already;
    `buckets` bounds the tasks, so it should be a few times the cores."""
    dealt = bars.repartition(buckets, "symbol", "timeframe")  # one file for each bucket
    dealt.write.mode("overwrite").bucketBy(buckets, "symbol", "timeframe").sortBy("symbol", "timeframe", "time").format("parquet").saveAsTable(table)
    return bars.sparkSession.table(table)


#: How times are written in CSV.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_trades(trades: DataFrame, path: str) -> None:
    """A trade list with its running columns, as CSV with a header; times to the microsecond (TIMES)."""
    trades.write.mode("overwrite").option("header", "true").option("timestampFormat", TIMES).option("timestampNTZFormat", TIMES).csv(path)
