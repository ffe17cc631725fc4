"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

Entries become integers, so sums and products are exact. The scatter matrix's characteristic polynomial is found modulo
many primes by Hessenberg reduction, put together by Chinese remaindering, and its roots, all real, are isolated by
counting sign changes and refined by bisection with integers; null-space inverse iteration in fixed-point arithmetic
then gives the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import materialize, numbered

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries stop at this, so that they fit a long after scaling.
LARGEST = float(1 << 62)
#: Sums leave a task as numbers of 30 bits, lowest first; the last one has the sign.
WORD, WORDS = 30, 6
#: Bits of an entry that are multiplied at once, and rows: their sums stay whole in doubles.
LIMB, ROWS = 20, 4096
#: Bits behind the point of a refined root, beyond those that separate it from its neighbours.
BITS = 160
#: Primes that a task works on.
PRIMES_A_TASK = 16


# ---- the scatter matrix ----------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite entries and as many as most of the others have (of equally many the longer)."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.filter(v.isNotNull() & ~bad)
    sizes = whole.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.filter(F.size(v) == (sizes[0]["d"] if sizes else 0))


def integers(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(1024 c) of entries, as rows of a matrix; the shift that makes x of it changes no covariance."""
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, dim)


def products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, exact: entries are cut into limbs whose products sum to less than 2 to the 53."""
    dim = x.shape[1]
    total = np.zeros((dim, dim), object)
    for at in range(0, len(x), ROWS):
        rest, limbs = x[at : at + ROWS], []
        while True:
            small = np.abs(rest).max(initial=0) < 1 << LIMB
            limbs.append((rest if small else rest & ((1 << LIMB) - 1)).astype(np.float64))
            if small:
                break
            rest = rest >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def in_words(values: list[int]) -> np.ndarray:
    """Integers as WORDS numbers of WORD bits each, so that longs can sum any number of them exactly."""
    return np.array([[(v >> (WORD * k)) & ((1 << WORD) - 1) for k in range(WORDS - 1)] + [v >> (WORD * (WORDS - 1))] for v in values], np.int64).reshape(-1, WORDS)


def scatter(vectors: DataFrame, vector: str, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of every dimension and n * (sum of x x') - S S', all exact: n squared times the covariance.

    A task sends one row for each pair of dimensions; Spark sums them; what reaches the driver grows with the square of
    the dimension, not with the data."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums, total = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = integers(batch.column(0).flatten().to_numpy(), dim)
            n, sums, total = n + len(x), sums + [sum(c) for c in (x.T.tolist() if np.abs(x).max(initial=0) >= 1 << 40 else x.sum(axis=0)[:, None].tolist())], total + products(x)
        if n:
            i, j = np.triu_indices(dim)
            rows = np.concatenate([[-1], np.full(dim, -2), i]), np.concatenate([[0], np.arange(dim), j])
            words = in_words([n, *sums.tolist(), *total[i, j].tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in rows] + [pa.array(w) for w in words.T.copy()], ["i", "j", *[f"w{k}" for k in range(WORDS)]])

    words = [f"w{k}" for k in range(WORDS)]
    parts = vectors.select(f"`{vector}`").mapInArrow(run, ", ".join(["i int", "j int", *[f"{w} long" for w in words]]))
    n, sums, total = 0, [0] * dim, np.zeros((dim, dim), object)
    for i, j, *ws in parts.groupBy("i", "j").agg(*[F.sum(w).alias(w) for w in words]).collect():
        value = sum(w << (WORD * k) for k, w in enumerate(ws))
        if i == -1:
            n = value
        elif i == -2:
            sums[j] = value
        else:
            total[i, j] = total[j, i] = value
    return n, sums, n * total - np.outer(np.array(sums, object), np.array(sums, object))


# ---- the characteristic polynomial -----------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that are enough below 2 to the 64."""
    if n < 41 or not n % 2:
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    odd, twos = n - 1, 0
    while not odd % 2:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """The largest primes below 2 to the 31 whose product is over bound."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(t - m) modulo a prime p < 2 to the 31; m has entries in 0 .. p - 1.

    Similarity steps make m a Hessenberg matrix, whose leading minors follow a recurrence."""
    h, d = m.copy(), len(m)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        if r := int(below[0]):
            h[[k + 1, k + 1 + r]] = h[[k + 1 + r, k + 1]]
            h[:, [k + 1, k + 1 + r]] = h[:, [k + 1 + r, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    minors = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = minors[k]
        new[:-1] -= h[k, k] * minors[k] % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            new[: i + 1] -= run * int(h[i, k]) % p * minors[i] % p
        minors.append(new % p)
    return minors[d].tolist()


def remainders(matrix: np.ndarray, p: int) -> np.ndarray:
    return (matrix % p).astype(np.int64)


def joined(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least size with the residues given: Chinese remaindering by halves."""
    while len(residues) > 1:
        left = []
        for (p, a), (q, b) in zip(residues[::2], residues[1::2], strict=False):
            inverse = pow(p, -1, q)
            left.append((p * q, [x + p * ((y - x) * inverse % q) for x, y in zip(a, b, strict=True)]))
        residues = left + (residues[-1:] if len(residues) % 2 else [])
    p, values = residues[0]
    return [v - p if 2 * v > p else v for v in values]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Integer coefficients (constant first) of det(t - matrix), for a symmetric matrix without negative eigenvalues.

    The coefficient of t to the d - k is a sum of products of k eigenvalues, so none is above (1 + trace / d) to the d in
    size. Primes are dealt to Spark tasks."""
    d = len(matrix)
    bound = 2 * ((d + int(sum(matrix[i, i] for i in range(d)))) // d + 1) ** d
    primes = primes_above(2 * bound)
    text = spark.sparkContext.broadcast([[int(x) for x in row] for row in matrix])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.array(text.value, object)
        for batch in batches:
            found = [(p, polynomial_modulo(remainders(held, p), p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["p", "c"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    return joined([(r["p"], r["c"]) for r in dealt.mapInArrow(run, "p long, c array<long>").collect()])  # a row a prime


# ---- its roots -------------------------------------------------------------------------------------------------------


def at_dyadic(poly: list[int], a: int, bits: int) -> int:
    """The sign-true value of poly at a / 2^bits (times 2^(bits * degree))."""
    value, one = 0, 0
    for c in reversed(poly):
        value = value * a + (c << one)
        one += bits
    return value


def roots_above(poly: list[int], a: int, bits: int) -> int:
    """How many roots, each as often as it is one, are above a / 2^bits, for a polynomial whose roots are all real: the
    sign changes of the coefficients of poly(t + a)."""
    n = len(poly) - 1
    c = [x << (bits * (n - i)) for i, x in enumerate(poly)]  # of (2^bits)^n poly(t / 2^bits)
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def derivative(poly: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(poly)][1:]


def primitive(poly: list[int]) -> list[int]:
    while poly and not poly[-1]:
        poly = poly[:-1]
    g = math.gcd(*poly) if poly else 1
    return [c // g for c in poly] if g > 1 else poly


def divided(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of a multiple of a by b (the multiple is a power of b's leading coefficient)."""
    a, q = list(a), []
    while len(a) >= len(b):
        lead = a[-1]
        q = [x * b[-1] for x in q] + [lead]
        a = [x * b[-1] for x in a]
        for i, x in enumerate(b):
            a[len(a) - len(b) + i] -= lead * x
        a.pop()
    return q[::-1], a


def squarefree(poly: list[int]) -> list[int]:
    """The polynomial with the same roots, each once. A prime for which poly has no root in common with its derivative
    shows that there is nothing to do; else the common divisor is worked out."""
    for p in primes_above(1 << 80):
        if poly[-1] % p and len(common_modulo(poly, derivative(poly), p)) == 1:
            return poly
    a, b = primitive(poly), primitive(derivative(poly))
    while b:
        a, b = b, primitive(divided(a, b)[1])
    return primitive(divided(poly, a)[0])


def common_modulo(a: list[int], b: list[int], p: int) -> list[int]:
    trim = lambda x: next((x[: i + 1] for i in range(len(x) - 1, -1, -1) if x[i]), [])
    a, b = trim([x % p for x in a]), trim([x % p for x in b])
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            f = a[-1] * inverse % p
            at = len(a) - len(b)
            a = trim(a[:at] + [(x - f * y) % p for x, y in zip(a[at:], b, strict=True)])
        a, b = b, a
    return a


def largest_roots(poly: list[int], count: int, bits: int = BITS) -> list[tuple[int, int, int, int]]:
    """The distinct roots over 0, falling, until there are count with their multiplicities: (a, s, times, gap), the root
    in (a, a + 1] / 2^s, and `gap` bits of s being enough to separate it from its neighbours."""
    simple = squarefree(poly)
    top = 1
    while roots_above(simple, top, 0):
        top *= 2
    out, stack, found = [], [(0, top, 0)], 0  # (low, high, s): low / 2^s < root <= high / 2^s, the largest on top
    while stack and found < count:
        low, high, s = stack.pop()
        inside = roots_above(simple, low, s) - roots_above(simple, high, s)
        if inside > 1:
            if (low + high) % 2:
                low, high, s = 2 * low, 2 * high, s + 1
            middle = (low + high) // 2
            stack += [(low, middle, s), (middle, high, s)]
        elif inside:
            times = roots_above(poly, low, s) - roots_above(poly, high, s)
            gap = s - (high - low).bit_length()
            found += times
            out.append((*refined(simple, low, high, s, gap + bits), times, gap))
    return out


def refined(poly: list[int], low: int, high: int, s: int, bits: int) -> tuple[int, int]:
    """(a, bits): the one root in (low, high] / 2^s lies in (a, a + 1] / 2^bits."""
    extra = max(0, bits - s)
    low, high, s = low << extra, high << extra, s + extra
    below = at_dyadic(poly, low, s)
    sign_low = (below > 0) - (below < 0) if below else None
    if sign_low is None:  # low is itself a root, which isn't meant: look just above it
        value = at_dyadic(derivative(poly), low, s)
        sign_low = (value > 0) - (value < 0)
    while high - low > 1:
        middle = (low + high) // 2
        value = at_dyadic(poly, middle, s)
        if value and (value > 0) == (sign_low > 0):
            low = middle
        else:
            high = middle
    return low, s


# ---- components ------------------------------------------------------------------------------------------------------


def null_space(matrix: np.ndarray, root: int, s: int, times: int, bits: int) -> list[np.ndarray]:
    """`times` orthogonal vectors of length 1 (integers over 2^bits) that matrix - root / 2^s takes to nearly 0.

    Inverse iteration in fixed point: the shifted matrix is decomposed once with row swaps; a vanishing last pivot is
    replaced by the least step. Starts are fixed pseudo-random vectors, which are made orthogonal after each step."""
    d = len(matrix)
    a = np.array([[int(x) << bits for x in row] for row in matrix], object)
    shift = root << (bits - s) if bits >= s else root >> (s - bits)
    a[np.arange(d), np.arange(d)] -= shift
    order = np.arange(d)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factor = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k] = factor
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :]) >> bits

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d):
            x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> bits
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << bits) // a[k, k]
            x[:k] -= (a[:k, k] * x[k]) >> bits
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        size = math.isqrt(int((x * x).sum()))
        return (x << bits) // max(1, size)

    draws = np.random.default_rng(11).integers(1, 1 << 30, (times, d))
    basis = [unit(np.array([int(v) for v in row], object) << bits) for row in draws]
    for _ in range(3):
        new: list[np.ndarray] = []
        for b in basis:
            x = unit(solved(b))
            for _ in range(2):
                for y in new:
                    x = x - ((int((x * y).sum()) >> bits) * y >> bits)
                x = unit(x)
            new.append(x)
        basis = new
    return basis


def components(matrix: np.ndarray, poly: list[int], count: int = COMPONENTS) -> list[tuple[int, int, np.ndarray]]:
    """(root, s, vector) of the `count` largest eigenvalues root / 2^s over 0, falling, as doubles of length 1.

    Components of one eigenvalue are orthogonal vectors of its space. A vector's largest entry is over 0."""
    out = []
    for root, s, times, gap in largest_roots(poly, count):
        size = max(1, int(max(abs(x) for x in matrix.flat)).bit_length())
        bits = s + size + 2 * max(0, gap) + 64
        for v in null_space(matrix, 2 * root + 1, s + 1, times, bits):
            x = np.array([int(e) / (1 << bits) for e in v])
            out.append((2 * root + 1, s + 1, x * (1 if x[np.argmax(np.abs(x))] > 0 else -1)))
    return out[:count]


# ---- whitening -------------------------------------------------------------------------------------------------------


def whiten(vectors: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """Two tables: the columns of vectors but the vector, and _white, of every usable row; and one row for each component.

    _white: struct<deviation: decimal(38,0), whitened: array<double>>, whitened having one entry for each component. The
    components (component from 1, eigenvalue, explained, vector, n, identity_error) are those of the `count` largest
    eigenvalues over 0 of the covariance of x = floor(1024 c) + 100000, divisor n, over all usable rows. identity_error is
    the largest absolute entry of whitened's covariance minus the identity, measured on the rows written.

    Rows whose vector is null or has null, NaN or infinite entries go, and so do those whose length isn't that of most
    others (equally many: the longer length counts). Where the rows don't vary (one row, equal rows, an empty table) no
    component has an eigenvalue over 0: whitened is empty and there are no components. Repeated rows count and stay; other
    columns, whatever their names, pass through (only _white is replaced); a deviation over 38 digits is null. Entries of
    more than 2 to the 52 in size stop there. Vectors are read twice (sums, projections); only _white is written."""
    vectors, spark = vectors.drop("_white"), vectors.sparkSession
    rows = usable(vectors, vector)
    first = rows.select(F.size(f"`{vector}`").alias("d")).first()
    dim = first["d"] if first else 0
    n, sums, matrix = scatter(rows, vector, dim) if dim else (0, [], np.zeros((0, 0), object))
    trace = sum(int(matrix[i, i]) for i in range(dim))
    found = components(matrix, characteristic_polynomial(spark, matrix), min(count, dim)) if trace else []
    # matrix is n^2 times the covariance: a deviation of n x - S along a component is divided by the root of its eigenvalue.
    scale = [1 / math.sqrt(root / (1 << s)) for root, s, _ in found]
    projection = np.array([v * f for (_, _, v), f in zip(found, scale, strict=True)]).reshape(len(found), dim).T
    place = vectors.columns.index(vector)
    held, restored = numbered(rows)
    schema = T.StructType([*held.schema.fields, *T.StructType.fromDDL("_white struct<deviation: decimal(38,0), whitened: array<double>>").fields])

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import pyarrow as pa

        total = np.array(sums, object)
        fits = n * (1 << 11) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62
        for batch in batches:
            x = integers(batch.column(place).flatten().to_numpy(), dim) if dim else np.zeros((batch.num_rows, 0), np.int64)
            if fits and np.abs(x).max(initial=0) * n < 1 << 62:
                off = x * n - np.array(sums, np.int64)
                exact = float(np.abs(off).max(initial=0)) ** 2 * max(1, dim) < 2.0**62
                deviation = (off * off).sum(axis=1).tolist() if exact else (off.astype(object) ** 2).sum(axis=1).tolist()
            else:
                off = x.astype(object) * n - total
                deviation = (off * off).sum(axis=1).tolist()
            white = off.astype(np.float64) @ projection
            offsets = pa.array((np.arange(len(x) + 1) * len(found)).astype(np.int32))
            told = pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
            made = pa.StructArray.from_arrays([told, pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], ["deviation", "whitened"])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "_white"])

    white = materialize(restored(held.mapInArrow(run, schema)).drop(vector), "whitened")
    return white, _component_table(spark, n, trace, found, white)


def _component_table(spark, n: int, trace: int, found: list[tuple[int, int, np.ndarray]], white: DataFrame) -> DataFrame:
    rows = [(k + 1, root / (1 << s) / n / n, root / trace / (1 << s), v.tolist(), n) for k, (root, s, v) in enumerate(found)]
    table = spark.createDataFrame(rows, "component int, eigenvalue double, explained double, vector array<double>, n long")
    return table.withColumn("identity_error", F.lit(identity_error(white, len(found))))


def identity_error(white: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance of _white.whitened (divisor n) minus the identity; 0 of no rows."""
    w = [F.col("_white.whitened")[k] for k in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    if not pairs:
        return 0.0
    found = white.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs((found[f"c{i}_{j}"] or 0.0) - (i == j)) for i, j in pairs)
