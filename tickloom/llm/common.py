"""What the corpus operators share: reading, shared scratch tables, size-checked broadcasts, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.shared import written

#: Bytes of text that a task works on at once.
PIECE = 2_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A word is a maximal run of characters that are neither a blank nor one of TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write a table to the shared folder and read it again.
materialize = written


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32_000_000) -> DataFrame:
    """Hint a broadcast only where a count and the size of the files prove the bounds; else leave the join to Spark. Give
    it a materialized df."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes and df.limit(max_rows + 1).count() <= max_rows else df


def n_words(text: Column) -> Column:
    """Number of words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """name, with lines after it until no column of df has that name (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy_worker() -> None:
    """Give freed memory back: workers live on from task to task and would keep the most that any of them took."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def pieces(batches: Iterator, place: int, size: int = PIECE) -> Iterator:
    """Arrow batches cut into runs of rows with about `size` bytes of text (column number place); a longer text is one run.

    What a batch is turned into takes many times its own memory, so tasks work on a few megabytes at once."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
        cuts = (np.flatnonzero(np.diff(sizes // size)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns named c0, c1, .. and what gives them (and leaves further ones) their names back: Python
    workers can then be handed columns of any name, dots included."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), lambda out: out.toDF(*names, *out.columns[len(names) :])


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session bounds the bytes of an Arrow batch from now on: by PIECE where it had no bound. Every operator
    that hands texts to Python workers asks for it, so none depends on what ran before."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(PIECE))
    return df


def append_from_text(df: DataFrame, name: str, kind: str, start: Callable[[], Callable]) -> DataFrame:
    """The columns of df and `name` (of the DDL type kind), computed from the column text, batch by batch, in Arrow.

    start is called once in each task; what it returns makes the values (a pyarrow array) of a batch from a list of
    texts, null ones as None. All other columns pass through as they are, whatever their names; a column that is called
    `name` is replaced."""
    df = bounded_batches(df.drop(name))
    place = df.columns.index("text")
    held, restored = numbered(df)
    schema = T.StructType([*held.schema.fields, T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = start()
        for part in pieces(batches, place):
            yield pa.RecordBatch.from_arrays([*part.columns, make(part.column(place).to_pylist())], [*part.schema.names, name])
        del make
        tidy_worker()

    return restored(held.mapInArrow(run, schema))


def chunks(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """Runs of texts with about `size` characters each; a longer text is a run of its own or ends one."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > size or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, held = i + 1, 0
