"""Selection by rank and ranges of the best share against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import genomes, ranks


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(3)


@pytest.mark.parametrize("kind", ["spread", "tied", "tiny gaps", "odd"])
def test_value_at_rank(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "spread": (10.0 ** rng.uniform(-300, 300, 500)).tolist(), "tied": rng.integers(0, 4, 500).astype(float).tolist(),
        "tiny gaps": [1 + k * 2.0**-52 for k in range(200)], "odd": [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5.0, 1.7e308, -1.7e308, None],
    }[kind]
    held = sorted((v for v in values if v is not None), key=lambda v: math.inf if v != v else v, reverse=True)
    held.sort(key=lambda v: v == v)  # NaN first
    df = frame(spark, values)
    for rank in (0, 2, len(held) // 2, len(held) - 1):
        got = ranks.value_at_rank(df, F.col("v"), rank, 20)
        assert got == held[rank] or (got != got and held[rank] != held[rank]), (rank, got)
    assert ranks.value_at_rank(df, F.col("v"), len(held)) is None and ranks.value_at_rank(df, F.col("v"), -1) is None


def test_best_share_has_ten_scores_and_three_genomes(spark):
    """Scores 0 to 9, the best fifth: from the score at rank 2 on, three of them."""
    df = frame(spark, [float(i) for i in range(10)])
    assert sorted(r.v for r in ranks.best_share(df, "v", 0.2).collect()) == [7.0, 8.0, 9.0]
    assert ranks.best_share(df, "v", 0.2, least=11).count() == 0 and ranks.best_share(df.limit(0), "v", 0.2).count() == 0
    assert ranks.best_share(frame(spark, [1.0] * 9 + [2.0]), "v", 0.2).count() == 10  # ties stay


def test_bounds_by_the_best_share(spark):
    from tickloom.sources import derived

    g = derived.genomes(spark, "/root/testdata/sf0.001")
    rows = [(r.score, r.entry.st_mult, r.entry.rsi_length) for r in g.collect()]
    cut = sorted((s for s, *_ in rows), reverse=True)[int(len(rows) * 0.2)]
    mults = [m for s, m, _ in rows if s >= cut]
    got = {(r.block, r.param): (r.lo, r.hi) for r in genomes.expanded_bounds(g, share=0.2).collect()}
    lo, hi = (max(0.5, min(mults) - 0.45) if min(mults) < 0.5 else 0.5), (max(mults) + 0.45 if max(mults) > 5 else 5.0)
    assert got["entry", "st_mult"] == (pytest.approx(lo), pytest.approx(hi)) and len(got) == len(genomes.NUMBERS)
