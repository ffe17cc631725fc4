"""Neighbour operators in blocks against plain loops over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks, genomes, leaderboard, runs

FAR = {"mean": lambda a, b: np.abs(a - b).mean(axis=-1), "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).mean(axis=-1))}


def clustered(rng, n, dim, centres=40, spread=0.05):
    return np.clip(rng.random((centres, dim))[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dim)), 0, 1)


def frame(spark, x, scores):
    return spark.createDataFrame([(i, float(s), v.tolist()) for i, (s, v) in enumerate(zip(scores, x, strict=True))], "genome_id long, score double, vec array<double>").repartition(3)


def walk(x, scores, apart, far):
    kept = []
    for i in sorted(range(len(x)), key=lambda i: (-scores[i], i)):
        if not kept or far(x[kept], x[i]).min() >= apart:
            kept.append(i)
    return kept


@pytest.mark.parametrize("by", ["mean", "euclidean"])
def test_diverse_equals_the_walk_on_5000_vectors(spark, by, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([clustered(rng, 4000, 6), rng.random((1000, 6))])
    scores = rng.integers(0, 500, len(x))
    rounds = []
    real = blocks.boxes
    monkeypatch.setattr(blocks, "boxes", lambda b: rounds.append(1) or real(b))
    got = [r["genome_id"] for r in genomes.diverse(frame(spark, x, scores), by=by, per_block=900).collect()]
    assert sorted(got) == sorted(walk(x, scores, 0.15, FAR[by])) and 3 < len(rounds) <= 3 * 8
    best = genomes.diverse(frame(spark, x[:500], scores[:500]), keep=7, by=by, per_block=100)
    assert [r["genome_id"] for r in best.collect()] == walk(x[:500], scores[:500], 0.15, FAR[by])[:7]


def test_a_chain_of_rows_that_hold_each_other_back(spark):
    """Every row is near the next one and better than it: every other one stays, however the chain is cut into blocks."""
    x = np.array([[i * 0.01, 0.0] for i in range(30)])
    got = genomes.diverse(frame(spark, x, range(30, 0, -1)), apart=0.012 / np.sqrt(2), by="euclidean", per_block=14)
    assert sorted(r["genome_id"] for r in got.collect()) == list(range(0, 30, 2))


def test_diverse_of_nothing_null_scores_and_equal_vectors(spark):
    empty = spark.createDataFrame([], "genome_id long, score double, vec array<double>")
    assert genomes.diverse(empty).count() == 0
    rows = [(1, None, [0.5, 0.5]), (2, 1.0, [0.5, 0.5]), (3, None, [0.0, 0.0]), (4, 1.0, [0.5, 0.5])]
    got = genomes.diverse(spark.createDataFrame(rows, "genome_id long, score double, vec array<double>"), per_block=1)
    assert sorted(r["genome_id"] for r in got.collect()) == [2, 3]


@pytest.mark.parametrize("per_block", [70, 10_000])
def test_niche_counts_equal_all_pairs(spark, per_block):
    rng = np.random.default_rng(4)
    x = np.concatenate([clustered(rng, 500, 5), rng.random((150, 5))])
    x = np.concatenate([x, x[:120], np.repeat(x[:1], 300, axis=0)])  # equal vectors, one of them very often
    scores = rng.integers(1, 90, len(x))
    d = np.stack([FAR["euclidean"](x, v) for v in x])
    niche = np.where(d < 0.15, 1 - (d / 0.15) ** 2, 0).sum(axis=1)
    got = {r["genome_id"]: r for r in genomes.niche_fitness(frame(spark, x, scores), per_block=per_block).collect()}
    assert len(got) == len(x) and all(abs(got[i]["niche"] - niche[i]) < 2e-6 and abs(got[i]["shared"] - scores[i] / niche[i]) < 1e-5 for i in range(len(x)))
    assert genomes.niche_fitness(frame(spark, x[:0], [])).count() == 0


def test_compared_pairs_grow_slower_than_the_square(spark):
    """Ten times the vectors in a space that grows with them: blocks that meet, against all pairs of blocks."""
    shares = []
    for n in (600, 6000):
        rng = np.random.default_rng(n)
        df = frame(spark, clustered(rng, n, 4, centres=n // 30, spread=0.01), np.zeros(n))
        axes = blocks.EUCLIDEAN.directions(blocks.principal_axes(df, "vec", 4))
        dealt = blocks.in_blocks(blocks.with_places(df, "vec", axes), 60)
        sizes = {r["_block"]: r["n"] for r in dealt.groupBy("_block").agg(F.count("*").alias("n")).collect()}
        b = blocks.boxes(dealt)
        pairs = blocks.within_reach(b, b, 0.02, blocks.EUCLIDEAN, 4).collect()
        shares.append((sum(sizes[p["_a"]] * sizes[p["_b"]] for p in pairs) + sum(s * (s - 1) // 2 for s in sizes.values())) / (n * (n - 1) / 2))
        assert max(sizes.values()) < 130
    assert shares[1] < 0.5 * shares[0]


def test_near_is_exact():
    rng = np.random.default_rng(6)
    a, b = rng.random((80, 7)), rng.random((90, 7))
    for m in (blocks.EUCLIDEAN, blocks.MEAN):
        want = {(i, j) for i in range(80) for j in range(90) if FAR[m.name](a[i], b[j]) < 0.3}
        i, j, d = m.near(a, b, 0.3)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and np.allclose(d, FAR[m.name](a[i], b[j]))


def both_keys(rows):
    seen, kept = (set(), set()), []
    for i, s, a, b in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0])):
        if a not in seen[0] and b not in seen[1]:
            seen[0].add(a)
            seen[1].add(b)
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("tail,hot", [(0, 20), (10_000, 100_000)])
def test_one_of_both_keys_equals_the_walk(spark, tail, hot, monkeypatch):
    monkeypatch.setattr(runs, "HOT", hot)
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 300)), int(rng.integers(0, 60)) if i % 3 else 7, f"m{rng.integers(0, 80)}") for i in range(900)]  # a third has one key
    rows += [(1000, None, 500, "x"), (1001, None, 500, None), (1002, 5.0, None, None), (1003, 6.0, None, None)]
    # 2001 is rejected by 2000's first key and so leaves its second key to 2002
    rows += [(2000, 999.0, 600, "p"), (2001, 998.0, 600, "q"), (2002, 997.0, 601, "q")]
    df = spark.createDataFrame(rows, "run_id long, score double, a int, b string")
    got = sorted(r["run_id"] for r in runs.one_of_both(df, [F.col("a")], [F.col("b")], tail=tail).collect())
    assert got == both_keys(rows) and 2002 in got
    assert runs.one_of_both(df.limit(0), [F.col("a")], [F.col("b")], tail=tail).count() == 0


def test_front_that_is_much_of_the_table(spark, monkeypatch):
    """Anti-correlated objectives: more than a tenth of the rows is the front; no task sees more than two blocks."""
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.dirichlet(np.ones(4), n) * 100
    x[: n // 2] *= rng.uniform(0.8, 1.0, (n // 2, 1))
    rows = [(i, *map(float, np.round(v[:3], 6)), float(np.round(-v[3], 6))) for i, v in enumerate(x)] + [(n, 1.0, None, 2.0, 3.0), (n + 1, *map(float, np.round(x[0][:3], 6)), float(np.round(-x[0][3], 6)))]
    v = np.array([[a, b, c, -d] for _, a, b, c, d in rows if b is not None])
    front = {i for (i, *_), p in zip([r for r in rows if r[2] is not None], v, strict=True) if not ((v >= p).all(axis=1) & (v > p).any(axis=1)).any()} | {n}
    sizes = []
    real = blocks.boxes
    monkeypatch.setattr(blocks, "boxes", lambda b: sizes.extend(r["count"] for r in b.groupBy("_block").count().collect()) or real(b))
    t = spark.createDataFrame(rows, "run_id long, net_profit_pct double, sharpe double, winrate double, max_drawdown_pct double")
    assert {r["run_id"] for r in runs.pareto_front(t, per_block=200).collect()} == front
    assert len(front) > n / 10 and len(sizes) > 5 and max(sizes) <= 300


def test_search_in_blocks_equals_all_pairs(spark):
    """Clusters of records: most blocks are left out, and the ranks are those of all pairs."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.15, (3000, 16))
    x[5] = 0.0
    rows = [(f"g{i % 700}", int(i), float(i % 10) / 10, v.tolist()) for i, v in enumerate(x)]
    board = spark.createDataFrame(rows, "genome_hash string, ts long, stability double, vec array<double>")
    asked = spark.createDataFrame([(k, (x[k * 61] + 0.01).tolist()) for k in range(40)] + [(99, [0.0] * 16)], "query_id long, vec array<double>")
    told = {}
    show = lambda t: sorted(map(tuple, t.select("query_id", "rank", "genome_hash", "ts", "similarity").collect()))
    got = show(leaderboard.similar(board, asked, 10, 0.7, 0.3, small=0, per_block=100, told=told))
    want = show(leaderboard.similar(board, asked, 10, 0.7, 0.3))
    assert got == want and len(got) > 300 and told["share"] < 0.35
    assert leaderboard.similar(board.limit(0), asked, small=-1).count() == 0


def _shuffled(spark, run):
    """Bytes that stages wrote for others while run() ran."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))
    before = total()
    run()
    return total() - before


def test_vectors_are_not_copied_for_pairs_of_blocks(spark):
    """Four times the vectors, whose blocks all meet: what is shuffled grows with the vectors, not with their pairs."""
    written = []
    for n in (1000, 4000):
        df = frame(spark, np.random.default_rng(2).random((n, 16)), np.zeros(n))
        written.append(_shuffled(spark, lambda df=df: genomes.niche_fitness(df, per_block=50).collect()))
    assert 0 < written[1] < 7 * written[0], written


def test_diverse_in_waves_equals_the_walk_and_copies_no_vectors(spark):
    """Four times the vectors, in several waves of blocks that all meet: the walk's choice, and shuffles that grow with the
    vectors, not with their pairs."""
    written = []
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        x, scores = rng.random((n, 8)), rng.integers(0, 90, n)
        got = []
        written.append(_shuffled(spark, lambda x=x, scores=scores, got=got: got.extend(genomes.diverse(frame(spark, x, scores), per_block=25).collect())))
        assert sorted(r["genome_id"] for r in got) == sorted(walk(x, scores, 0.15, FAR["mean"]))
    assert 0 < written[1] < 8 * written[0], written


def test_distances_of_all_pairs_in_chunks(spark, tmp_path):
    """genome_distances works its pairs out in matrices, with no broadcast and no row of vectors for a pair."""
    from tickloom.plans import all_queries

    rng = np.random.default_rng(12)
    x = rng.random((330, 16)) * 1.4
    rows = frame(spark, x, np.zeros(len(x))).select("genome_id", "vec")
    asked = rows.filter("genome_id % 50 = 0").withColumnRenamed("genome_id", "query_id")
    got = blocks.all_pairs(rows, asked, genomes.both_distances, ["mean_gap", "euclidean"], per_rows=40, per_queries=3).collect()
    assert len(got) == 7 * 330 == len({(r["query_id"], r["genome_id"]) for r in got})
    for r in got:
        a, b = x[r["query_id"]], x[r["genome_id"]]
        assert abs(r["mean_gap"] - min(1, FAR["mean"](a, b))) < 6e-7 and abs(r["euclidean"] - min(1, FAR["euclidean"](a, b))) < 6e-7
    spark.range(200).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    plan = all_queries()["genome_distances"][0](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan


def test_similarities_of_all_pairs_equal_the_expression(spark, tmp_path):
    """Null vectors, nulls in them, no length, no number, infinite: as the column expression has it; and the query's plan."""
    from tickloom.operators import profile
    from tickloom.plans import all_queries

    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 3, [nan, 1.0, 0.5], [None, 1.0, 0.5], [inf, 1.0, 2.0], [-1.0, -2.0, 0.5]]
    rng = np.random.default_rng(13)
    vectors = odd + rng.normal(size=(60, 3)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, vec array<double>")
    asked = rows.filter("id < 12").withColumnRenamed("id", "query_id")
    show = lambda t: {(r["query_id"], r["id"]): r["similarity"] for r in t.collect()}
    got = show(blocks.all_pairs(rows, asked, profile.similarities, ["similarity"], per_rows=7, per_queries=2))
    both = leaderboard.against_all(rows, asked.withColumnRenamed("vec", "query_vec"))
    want = show(both.select("query_id", "id", profile.similarity(F.col("query_vec"), F.col("vec")).alias("similarity")))
    assert len(got) == 12 * 66 and got == want
    spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(9, 64)).tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = all_queries()["profile_similarity"][0](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
