"""Whitening against NumPy's eigenvectors and plain integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, `a.b` string, _white string"


def plain(rows, count=8):
    """Deviations, eigenvalues, explained and whitened up to sign, from exact sums and double-precision eigenvectors."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(dim)) for r in x]
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(dim)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    keep = values > 1e-9 * max(1.0, values[0])
    return deviation, values[keep], centred @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / (centred**2).sum(axis=1).mean()


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    white, parts = whitening.whiten(frame, **more)
    assert white.columns == ["vec_id", "a.b", "_white"]
    return sorted(white.collect(), key=lambda r: (r.vec_id is not None, r.vec_id)), sorted(parts.collect())


def same(rows, white, parts, count=8):
    deviation, values, whitened, explained = plain(rows, count)
    assert [int(r._white.deviation) for r in white] == deviation
    assert np.allclose([p.eigenvalue for p in parts], values, rtol=1e-10) and np.allclose([p.explained for p in parts], explained, rtol=1e-10)
    got = np.array([r._white.whitened for r in white])
    assert got.shape == whitened.shape
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.allclose(got * signs, whitened, atol=1e-8)
    assert parts[0].identity_error < 1e-9 and all(p.n == len(rows) for p in parts)


def test_whole_tables(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    white, parts = whitening.whiten(vectors)
    same(rows, sorted(white.collect()), sorted(parts.collect()))
    told = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.01").collect()
    assert len(told) == 8 * len(rows) and {r.component for r in told} == set(range(1, 9)) and max(r.identity_error for r in told) < 1e-9
    assert {r.vec_id: r.deviation for r in told} == dict(zip([i for i, _ in rows], plain(rows)[0], strict=True))


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(0, 0.2, 5)]) for i in range(40)] + [(40, [0.0] * 5), (40, [0.0] * 5)]
    bad = [(50, None), (51, [1.0, float("nan"), 0.0, 0.0, 0.0]), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [float("inf")] + [0.0] * 4), (54, [1.0, 2.0]), (55, [])]
    white, parts = run(spark, good + bad)
    same(good, white, parts)
    white, parts = run(spark, good, count=2)
    same(good, white, parts, 2)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 7, [(None, None)]])
def test_nothing_varies(spark, rows):
    white, parts = run(spark, rows)
    assert parts == [] and all(r._white.whitened == [] and r._white.deviation == 0 for r in white) and len(white) == sum(v is not None for _, v in rows)


def test_few_dimensions_vary_and_equal_eigenvalues(spark):
    rows = [(i, [a, b, 0.25, a]) for i, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)] * 3)]
    white, parts = run(spark, rows)
    assert [round(p.explained, 12) for p in parts] == [round(2 / 3, 12), round(1 / 3, 12)] and parts[0].identity_error < 1e-12
    square = [(i, [a, b]) for i, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])]
    white, parts = run(spark, square)
    assert [p.explained for p in parts] == [0.5, 0.5] and abs(np.dot(parts[0].vector, parts[1].vector)) < 1e-15 and parts[0].identity_error < 1e-12


def test_very_large_entries_stay_exact(spark):
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([(2.0**40, 1.0), (-(2.0**39), 3.0), (5.0, -(2.0**30))])]
    white, parts = run(spark, rows)
    assert [int(r._white.deviation) for r in white] == plain(rows)[0] and np.allclose([p.eigenvalue for p in parts][:1], plain(rows)[1][:1], rtol=1e-12)


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 10, (20, 6))
    m = (x.T @ x).astype(object)
    poly = whitening.characteristic_polynomial(spark, m)
    for t in (-3, 0, 5, 1000):  # det(t - m) by fractions
        a = [[Fraction((t if i == j else 0) - int(m[i, j])) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            pivot = next(r for r in range(k, 6) if a[r][k])
            if pivot != k:
                a[k], a[pivot], det = a[pivot], a[k], -det
            det *= a[k][k]
            for r in range(k + 1, 6):
                f = a[r][k] / a[k][k]
                a[r] = [y - f * z for y, z in zip(a[r], a[k], strict=True)]
        assert sum(c * t**i for i, c in enumerate(poly)) == det
    assert whitening.squarefree([-4, 8, -5, 1]) in ([2, -3, 1], [-2, 3, -1])  # (t - 1)(t - 2)^2
    roots = whitening.largest_roots([0, 0, 525, -460, 146, -20, 1], 6)  # 0, 0, 3, 5, 5, 7
    assert [(round((a + 1) / (1 << s)), times) for a, s, times, _ in roots] == [(7, 1), (5, 2), (3, 1)]
    assert all(whitening.is_prime(p) for p in (2, 3, 41, 2147483647)) and not whitening.is_prime(2147483645)


def test_products_of_limbs_are_exact():
    x = np.random.default_rng(1).integers(-(1 << 61), 1 << 61, (7, 3))
    want = x.astype(object).T @ x.astype(object)
    assert (whitening.products(x) == want).all()
    assert [sum(int(w) << (30 * k) for k, w in enumerate(r)) for r in whitening.in_words([5, -7, -(1 << 140), 1 << 100])] == [5, -7, -(1 << 140), 1 << 100]
