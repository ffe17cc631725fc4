"""The leaderboard on disk: only the partitions that a batch touches are written, and a batch counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tickloom.operators.leaderboard import KEY, upserted
from tickloom.sources.shared import written

BATCH = "batch"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The records on disk; None where there are none yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return found if found.columns else None


def store(new: DataFrame, path: str, batch: int) -> None:
    """Upserts new records (as `upserted` does) into the Parquet table at path, in folders by KEY.

    Records remember the number of the last batch that changed them, and what a record has of this batch or a later one
    isn't counted again; so a batch that comes twice, or that failed half way and is replayed, changes nothing more.
    Numbers rise from batch to batch. Records of touched keys alone are read (their folders, by dynamic pruning); the
    result is staged in the shared folder, then swapped in folder by folder; other folders keep their files."""
    spark = new.sparkSession
    new = written(new.withColumn(BATCH, F.lit(batch).cast("long")), "board-new")
    old = stored(spark, path)
    if old is not None:
        touched = F.broadcast(new.select(*KEY).distinct()) if new.select(*KEY).distinct().count() <= 100_000 else new.select(*KEY).distinct()
        old = old.select(*new.columns).join(touched, list(KEY), "left_semi")
        done = old.filter(F.col(BATCH) >= batch).select(*KEY, "genome_hash")
        new = new.join(done, [*KEY, "genome_hash"], "left_anti").select(*old.columns)
        new = upserted(old, new)
    else:
        new = upserted(new.limit(0), new)
    staged = written(new, "board-staged")
    staged.repartition(*KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(path)


def store_stream(new: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of records into the table at path; a replayed micro-batch changes nothing."""
    writer = new.writeStream.foreachBatch(lambda part, batch: store(part, path, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
