"""Approximate nearest neighbours by collision counting.

Unit vectors are projected on random lines and each line keeps its block's vectors in sorted order. A query opens a
window around its own projection on every line; windows widen round by round (virtual rehashing), each round reading
only what is new on both sides. Vectors that share enough windows with the query are verified by their exact cosine,
and the rounds end once the k-th best verified vector lies within the radius.

Vectors and queries are dealt into blocks. Each query first searches one block, in rounds; what it finds bounds its k-th
best over all blocks, so in every other block one window of that radius is enough. A task holds one block of vectors and
one of queries, whatever the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import broadcast_if_small, materialize

BLOCK, QUERY_BLOCK = 4096, 2048
LINES = 128
#: Half a window's width for radius 1, and the share of windows a candidate must share.
HALF, SHARE = 1.45, 0.82
#: Radii on the unit sphere, where no distance is over 2.
RADII = (0.3, 0.6, 0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.35, 1.4, 1.5, 1.7, 2.3)


def lines(dim: int) -> np.ndarray:
    """The projection lines (dim x LINES), the same everywhere."""
    return np.random.default_rng(7).standard_normal((dim, LINES)).astype(np.float32)


class Index:
    """Sorted projections of one block of vectors (rows of a float64 matrix)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.norms = ids, vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.lines = lines(vectors.shape[1])
        places = (vectors / self.norms[:, None]).astype(np.float32) @ self.lines
        self.order = np.argsort(places, axis=0).T.copy()
        self.sorted = np.take_along_axis(places.T, self.order, axis=1)

    def cosine(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Summed row by row in one fixed order, so that equal vectors get equal scores."""
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (one row per query, one column per line) of the windows around at."""
        half = HALF * radius[:, None]
        both = [[np.searchsorted(x, at[:, j] + sign * half[:, 0], side) for j, x in enumerate(self.sorted)] for sign, side in ((-1, "left"), (1, "right"))]
        return np.array(both[0]).T, np.array(both[1]).T

    def verified(self, rows: np.ndarray, query_id: int, query: np.ndarray, norm: float, k: int) -> list[tuple[int, int, float]]:
        rows = rows[self.ids[rows] != query_id]
        score = self.cosine(rows, query, norm)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return [(query_id, int(self.ids[rows[b]]), float(score[b])) for b in best]

    def rounds(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query id, vector id, cosine) of the k best of this block for each query, the query's own id left out."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / norms[:, None]).astype(np.float32) @ self.lines
        edges = [self.windows(at, np.full(len(at), r)) for r in RADII]
        out = []
        for i, (query_id, query, norm) in enumerate(zip(query_ids, queries, norms, strict=True)):
            shared, score = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), -np.inf)
            lows = highs = edges[0][0][i].tolist()
            for r, radius in enumerate(RADII):
                new_lows, new_highs = (e[i].tolist() for e in edges[r])
                fresh = [line[a:b] for line, a, b in zip(self.order, new_lows, lows, strict=True)] + [line[a:b] for line, a, b in zip(self.order, highs, new_highs, strict=True)]
                shared += np.bincount(np.concatenate(fresh), minlength=len(shared))
                lows, highs = new_lows, new_highs
                last = r == len(RADII) - 1  # every vector that no round let through is verified then
                fresh = np.flatnonzero((score == -np.inf) & (last | (shared >= SHARE * LINES)))
                fresh = fresh[self.ids[fresh] != query_id]
                score[fresh] = self.cosine(fresh, query, norm)
                found = np.flatnonzero(score > -np.inf)
                if len(found) >= k and math.sqrt(max(0.0, 2 - 2 * np.partition(score[found], -k)[-k])) <= radius:
                    break
            out += self.verified(found, query_id, query, norm, k)
        return out

    def within(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The same for queries whose k-th best has the cosine `bounds` at least (null: not known, all are verified).

        What lies outside a window is the shorter part of a line, so that is what is counted."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / norms[:, None]).astype(np.float32) @ self.lines
        radius = np.maximum(RADII[0], np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isnan(bounds), -1.0, bounds))))
        lows, highs = self.windows(at, radius)
        out = []
        for i, (query_id, query, norm) in enumerate(zip(query_ids, queries, norms, strict=True)):
            if np.isnan(bounds[i]):
                rows = np.arange(len(self.ids))
            else:
                outside = [x for line, a, b in zip(self.order, lows[i].tolist(), highs[i].tolist(), strict=True) for x in (line[:a], line[b:])]
                rows = np.flatnonzero(LINES - np.bincount(np.concatenate(outside), minlength=len(self.ids)) >= SHARE * LINES)
            out += self.verified(rows, query_id, query, norm, k)
        return out


def usable(embedding: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by cosine in double precision, ties to smaller ids.

    vectors and queries (vec_id, embedding array<float or double>). A vector that is null, empty, zero or has a null or
    non-finite component, or no id, takes no part; vectors of another length than the query's are no candidates; rows
    of one id count once (the smallest of their vectors). Fewer candidates than k are all returned; a query without
    candidates and empty tables give no rows. Other columns are not read.
    """

    def tidy(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
        return df.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    base, asked = materialize(tidy(vectors), "ann-vectors"), materialize(tidy(queries), "ann-queries")
    blocks, query_blocks = max(1, math.ceil(base.count() / BLOCK)), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda df: df.withColumn("rank", rank).filter(F.col("rank") <= k)
    dealt = base.select("dim", deal(blocks, 0).alias("block"), "vec_id", "v")

    def first(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = Index(own["vec_id"].to_numpy(), np.stack(own["v"])).rounds(asked["vec_id"].to_numpy(), np.stack(asked["v"]), k) if len(own) and len(asked) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def others(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = Index(own["vec_id"].to_numpy(), np.stack(own["v"])).within(asked["vec_id"].to_numpy(), np.stack(asked["v"]), asked["bound"].to_numpy(float), k) if len(own) and len(asked) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    # A query's first block is its own deal, cut into parts as small as a query block.
    home = asked.select("dim", deal(blocks, 1).alias("block"), deal(max(1, math.ceil(query_blocks / blocks)), 2).alias("part"), "vec_id", "v")
    parts = home.select("dim", "block", "part").distinct()
    near = dealt.join(broadcast_if_small(materialize(parts, "ann-parts")), ["dim", "block"])
    keys = ("dim", "block", "part")
    schema = "query_id long, vec_id long, score double"
    found = materialize(near.groupBy(*keys).cogroup(home.groupBy(*keys)).applyInPandas(first, schema), "ann-first")
    if blocks > 1:
        lowest = best(found).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        bounds = lowest.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).alias("bound"))
        bounded = asked.join(bounds, "vec_id", "left").withColumn("home", deal(blocks, 1))
        left = dealt.select("dim", "block", every(query_blocks).alias("part"), "vec_id", "v")
        right = bounded.select("dim", every(blocks).alias("block"), deal(query_blocks, 3).alias("part"), "home", "vec_id", "v", "bound").filter("block <> home").drop("home")
        found = found.unionByName(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(others, schema))
    return best(found).select("query_id", "rank", "vec_id", "score")
