"""Exact search by cosine: queries go only to the blocks of rows whose bound reaches what they have found already."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import blocks
from tickloom.sources.shared import written

#: Similarities are rounded to so many places before they are ranked; bounds allow for that.
PLACES, SLACK = 6, 1e-6
#: Axes along which blocks are bounded; what vectors have beside them is bounded by its length.
AXES = 8
#: Queries that meet a block at once.
QUERIES = 1000


def _unit(df: DataFrame, vec: str, axes: np.ndarray) -> DataFrame:
    """Rows whose vector has a length, with vec of length 1 and _p: places along the axes and the length of the rest."""
    held = df.select(vec, F.struct(*[F.col(f"`{c}`") for c in df.columns if c != vec]).alias("_row"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = blocks.matrix(batch.column(0))
            size = np.sqrt((x * x).sum(axis=1))
            good = np.flatnonzero(size > 0)
            x = x[good] / size[good, None]
            p = x @ axes.T
            p = np.concatenate([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))[:, None]], axis=1)
            double = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), double), batch.column(1).take(pa.array(good)), pa.array(list(p), double)], [vec, "_row", "_p"])

    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(vec, numbers), held.schema["_row"], T.StructField("_p", numbers)])
    return held.mapInArrow(run, schema).select(vec, "_row.*", "_p")


def most_similar(
    rows: DataFrame, queries: DataFrame, keep: int, threshold: float, order: list[str], per_block: int = blocks.PER_BLOCK, told: dict | None = None
) -> DataFrame:
    """rows (vec, ..) and queries (query_id, vec) -> the columns of rows but vec, query_id and similarity of each query's
    `keep` most similar rows, similarity (cosine in 0 to 1, rounded) being the threshold or more, which is over 0; equal
    ones in the given order of columns.

    Rows are dealt into blocks along their principal axes. By Cauchy and Schwarz, a query's cosine with a row is no more
    than the sum over the axes of its place times the better end of the block's range, plus the product of the lengths of
    what both have beside the axes. A query first meets the block with the best bound; the keep-th best cosine there
    bounds which other blocks it has to meet. A block meets its queries by QUERIES, so no task holds more than a block and
    these. told, if given, gets `share`: of all pairs, those that were compared."""
    axes = blocks.principal_axes(rows, "vec", AXES)
    m = len(axes)
    if not m:
        return rows.drop("vec").withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType)).withColumn("similarity", F.lit(0.0)).limit(0)
    data = blocks.in_blocks(_unit(rows, "vec", axes), per_block)
    asked = written(_unit(queries.select("query_id", "vec"), "vec", axes), "search-queries")
    sizes = data.groupBy("_block").agg(F.count("*").alias("_size"))
    bounds = F.broadcast(written(blocks.boxes(data).join(sizes, "_block").select("_block", "low", "high", "_size"), "search-boxes"))  # a row for each block
    best = sum((F.greatest(F.col("_p")[j] * F.col("low")[j], F.col("_p")[j] * F.col("high")[j]) for j in range(m)), F.col("_p")[m] * F.col("high")[m])
    reached = asked.crossJoin(bounds).withColumn("_best", best).filter(F.col("_best") >= threshold - SLACK)  # stated queries, a row for each block
    home = reached.groupBy("query_id").agg(F.max_by("_block", "_best").alias("_home"))
    first = reached.join(home, "query_id").filter(F.col("_block") == F.col("_home")).select("query_id", "vec", "_block", F.lit(threshold - SLACK).alias("_least"))
    begun = written(_met(data, first, keep, order), "search-first")
    least = begun.groupBy("query_id").agg(F.when(F.count("*") >= keep, F.min("similarity") - 2 * SLACK).otherwise(threshold - SLACK).alias("_least"))
    rest = reached.join(home, "query_id").filter(F.col("_block") != F.col("_home")).join(least, "query_id", "left")
    rest = rest.withColumn("_least", F.coalesce("_least", F.lit(threshold - SLACK))).filter(F.col("_best") >= F.col("_least"))
    visits = written(rest.select("query_id", "vec", "_block", "_least"), "search-visits")
    if told is not None:
        met = visits.select("_block").unionByName(first.select("_block")).join(sizes, "_block").agg(F.sum("_size")).first()[0]
        told["share"] = (met or 0) / max(1, rows.count() * queries.count())
    found = begun.unionByName(_met(data, visits, keep, order))
    return found.filter(F.col("similarity") >= threshold)


def _met(data: DataFrame, visits: DataFrame, keep: int, order: list[str]) -> DataFrame:
    """Each query's `keep` best rows of every block that it visits."""
    chunks = visits.groupBy("_block").agg(F.ceil(F.count("*") / QUERIES).alias("_chunks"))
    told = visits.join(chunks, "_block").select("query_id", F.col("vec").alias("_q"), "_least", "_block", F.pmod(F.xxhash64("query_id"), F.col("_chunks")).alias("_chunk"))
    held = data.drop("_p", "_slice").join(chunks.select("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk")), "_block")
    out = [f for f in held.schema.fields if f.name not in ("vec", "_block", "_chunk")]
    names = [f.name for f in out]

    def work(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return left.select(names).slice(0, 0).append_column("query_id", right["query_id"].slice(0, 0)).append_column("similarity", pa.array([], pa.float64()))
        x, q, least = blocks.matrix(left["vec"]), blocks.matrix(right["_q"]), right["_least"].to_numpy()
        place = np.empty(len(x), np.int64)
        place[np.lexsort([np.unique(left[c].to_numpy(zero_copy_only=False), return_inverse=True)[1] for c in order[::-1]])] = np.arange(len(x))
        rows, asked, values = [], [], []
        for k in range(len(q)):
            exact = np.clip((x * q[k]).sum(axis=1), 0, 1)
            near = np.flatnonzero(exact >= least[k])
            similar = np.round(exact[near], PLACES)
            top = np.lexsort((place[near], -similar))[:keep]
            rows.append(near[top])
            asked.append(np.full(len(top), k))
            values.append(similar[top])
        rows, asked = np.concatenate(rows), np.concatenate(asked)
        out = left.select(names).take(pa.array(rows))
        return out.append_column("query_id", right["query_id"].take(pa.array(asked))).append_column("similarity", pa.array(np.concatenate(values)))

    schema = T.StructType([*out, visits.schema["query_id"], T.StructField("similarity", T.DoubleType())])
    right = told.toDF(*told.columns)
    return held.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInArrow(work, schema)
