"""Tables in the folder that driver and executors share: they cut lineage, and lost executors lose nothing of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; what is there goes when the driver's JVM ends.

    Where the session names no folder, a temporary one is set on a local master; on a cluster executors would write to
    disks of their own, so that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top}/tickloom/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Bytes of an Arrow batch where the session names no bound.
BATCH = 2_000_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session bounds the bytes of an Arrow batch from now on: by BATCH where it had no bound. Every operator that
    hands texts or blocks to Python workers asks for it, so none depends on what ran before."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
