"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so sums, scatter and covariance are exact: with n vectors in the fit list (each distinct vector once) and
sums S, the matrix M = n * sum(x x') - S S' is n^2 times the covariance V. Its eigenvectors are V's, its eigenvalues n^2 times V's.

1. Partial sums and scatter matrices are made where the vectors lie (exact: float products of 21-bit limbs, summed as integers) and
   added up by cell; the driver gets one row a cell.
2. The characteristic polynomial of M is found modulo many 31-bit primes, each by reduction to Hessenberg form; the primes are dealt to
   tasks. Their number follows a bound of the coefficients (M has no negative eigenvalue, so the k-th is at most
   C(d, k) (trace / d)^k), and Chinese remaindering gives the integer coefficients. Two more primes than needed must agree.
3. All roots are real, so the sign changes of the polynomial moved by a number count exactly the roots above it, repeated ones
   as often as they occur. Counts at binary fractions isolate the largest roots; bisection by the polynomial's sign narrows each to
   PRECISION bits. Roots that are not apart then are one root of higher multiplicity.
4. For each root r, (M - r) is factorised in fixed-point integers, and two steps of inverse iteration, with orthogonal starts for a repeated
   root, give vectors of its null space to far more than double precision. The roots are dealt to tasks.

Rows are then projected in doubles. Work on the driver and in tasks of steps 2 to 4 depends on the number of dimensions d and of
bits, not on the rows; what is sent to tasks is d^2 integers and MAX_COMPONENTS vectors.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries, or entries of 2^62 / 64 and more (no long holds their
integer), are left out, and so are vectors of another length than most have (of equally frequent lengths the larger
counts). Repeated rows and ties are all returned; null ids too. An empty table, or one whose vectors are all equal, has no component
of positive variance and gives no rows; with rank r there are r components at most. ``deviation`` is null where it exceeds a long.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

MAX_COMPONENTS = 16
#: Relative width, in bits, to which roots are narrowed.
PRECISION = 192
#: Entries are centred near this number before they are multiplied; any number gives the same result.
OFFSET = 1_000_000
LIMB = 21


def integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * 64).cast("long") + OFFSET)


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose entries are all numbers that become a long, of the most frequent length."""
    whole = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).where(F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double") * 64) < 2.0**62, F.lit(False))))
    lengths = whole.groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return whole.where(F.size(vec) == (lengths["d"] if lengths else 0))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_scatter(y: np.ndarray) -> np.ndarray:
    """sum(y y') of the rows as Python integers."""
    d = y.shape[1]
    if not len(y):
        return np.zeros((d, d), dtype=object)
    top = int(max(-int(y.min()), int(y.max()), 1))
    n_limbs = max(1, -(-(top.bit_length() + 1) // LIMB))
    limbs = [((y >> (LIMB * k)) & ((1 << LIMB) - 1) if k < n_limbs - 1 else y >> (LIMB * k)).astype(np.float64) for k in range(n_limbs)]
    total = np.zeros((d, d), dtype=object)
    rows = 1 << (53 - 2 * LIMB)
    for i, p in enumerate(limbs):
        for j, q in enumerate(limbs):
            part = np.zeros((d, d), dtype=object)
            for a in range(0, len(y), rows * 256):
                some = sum((p[b : b + rows].T @ q[b : b + rows]).astype(np.int64) for b in range(a, min(len(y), a + rows * 256), rows))
                part = part + some.astype(object)
            total = total + part * (1 << (LIMB * (i + j)))
    return total


class Moments:
    """n, the sums S of x and the matrix M = n * sum(x x') - S S' of a fit list."""

    def __init__(self, fit: DataFrame, d: int):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, scatter = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
            for b in batches:
                y = matrix(b.column("x"), d) - OFFSET
                n += len(y)
                sums, scatter = sums + y.astype(object).sum(axis=0), scatter + exact_scatter(y)
            if n:
                values = [n, *sums, *scatter[np.triu_indices(d)]]
                # 30 bits a row of the table, so that sums of longs are exact
                cells = [(c, k, int(v >> (30 * k)) & ((1 << 30) - 1) if k < last else int(v >> (30 * k))) for c, v in enumerate(values) for last in [int(abs(v)).bit_length() // 30] for k in range(last + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*cells)], names=["cell", "limb", "v"])

        got = fit.select("x").mapInArrow(partial, "cell long, limb long, v long").groupBy("cell", "limb").agg(F.sum("v").alias("v")).collect()
        values = [0] * (1 + d + d * (d + 1) // 2)
        for r in got:
            values[r["cell"]] += r["v"] << (30 * r["limb"])
        self.n, sums = values[0], np.array(values[1 : 1 + d], dtype=object)
        half = np.zeros((d, d), dtype=object)
        half[np.triu_indices(d)] = values[1 + d :]
        scatter = half + half.T - np.diag(np.diag(half))
        self.m = self.n * scatter - np.outer(sums, sums)
        #: Sums of x - OFFSET, and of x.
        self.y_sums, self.sums = sums, sums + self.n * OFFSET


def is_prime(n: int) -> bool:
    """Exact below 3 * 10^9 with these witnesses."""
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for w in (2, 3, 5, 7):
        x = pow(w, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(count: int) -> list[int]:
    """The largest primes below 2^31."""
    out, n = [], 2**31 - 1
    while len(out) < count:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def inverses(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(v, p)], dtype=np.int64)


def polynomials_modulo(m: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Coefficients of det(x - m), from that of x^0 up, modulo each of the primes."""
    d = len(m)
    p = np.array(moduli, dtype=np.int64)
    h = np.stack([(m % q).astype(np.int64) for q in moduli])
    row = np.arange(len(p))
    for k in range(d - 2):
        below = h[:, k + 1 :, k] != 0
        pivot = k + 1 + np.argmax(below, axis=1)
        # the pivot's row and column change places with the next ones
        h[row, pivot], h[:, k + 1] = h[:, k + 1].copy(), h[row, pivot]
        h[row, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), h[row, :, pivot]
        factor = h[:, k + 2 :, k] * inverses(h[:, k + 1, k], p)[:, None] % p[:, None]
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, k + 1, None, :] % p[:, None, None]) % p[:, None, None]
        for r in range(d - k - 2):
            h[:, :, k + 1] = (h[:, :, k + 1] + factor[:, r, None] * h[:, :, k + 2 + r]) % p[:, None]
    # polynomials of the leading blocks, each from those before
    known = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)
    known[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), dtype=np.int64)
        new[:, 1:] = known[k - 1, :, :-1]
        new = (new - h[:, k - 1, k - 1, None] * known[k - 1]) % p[:, None]
        chain = np.ones(len(p), dtype=np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % p
            new = (new - (chain * h[:, k - i - 1, k - 1] % p)[:, None] * known[k - i - 1]) % p[:, None]
        known[k] = new
    return known[d]


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The integers, of either sign, of these residues."""
    pairs = [(list(r), q) for r, q in zip(residues, moduli)]
    while len(pairs) > 1:
        joined = []
        for (a, p), (b, q) in zip(pairs[::2], pairs[1::2]):
            w = pow(p, -1, q)
            joined.append(([x + p * ((y - x) * w % q) for x, y in zip(a, b)], p * q))
        pairs = joined + pairs[2 * len(joined) :]
    values, whole = pairs[0]
    return [v - whole if 2 * v > whole else v for v in values]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - m), from that of x^0 up, of a matrix without negative eigenvalues."""
    d, trace = len(m), int(np.trace(m))
    bound = max(comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1
    count = (bound.bit_length() + 2) // 30 + 1
    moduli = primes(count + 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = b.column("id").to_pylist()
            if which:
                got = polynomials_modulo(m, [moduli[k] for k in which])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(got), pa.list_(pa.int64()))], names=["id", "residues"])

    parts = max(1, min(len(moduli), spark.sparkContext.defaultParallelism))
    rows = sorted(spark.range(0, len(moduli), 1, parts).mapInArrow(work, "id long, residues array<long>").collect())
    coefficients = remaindered([r["residues"] for r in rows[:count]], moduli[:count])
    for r, q in zip(rows[count:], moduli[count:]):
        if [c % q for c in coefficients] != list(r["residues"]):
            raise ArithmeticError("the characteristic polynomial does not hold modulo a further prime")
    return coefficients


class Roots:
    """The positive roots of a monic integer polynomial whose roots are all real and none negative."""

    def __init__(self, coefficients: list[int]):
        self.c, self.d = coefficients, len(coefficients) - 1

    def scaled(self, e: int) -> list[int]:
        """Coefficients of 2^(d s) q(x / 2^s) for e = -s below 0: its roots are those of q times 2^s."""
        return [v << (-e * (self.d - k)) for k, v in enumerate(self.c)] if e < 0 else list(self.c)

    def above(self, a: int, e: int) -> int:
        """How many roots are larger than a * 2^e: sign changes of the coefficients of q moved there."""
        moved = self.scaled(e)
        by = a << e if e > 0 else a
        if by:
            for k in range(self.d):
                for j in range(self.d - 1, k - 1, -1):
                    moved[j] += by * moved[j + 1]
        signs = [v > 0 for v in moved if v]
        return sum(x != y for x, y in zip(signs, signs[1:]))

    def sign(self, a: int, e: int) -> int:
        """Of q(a * 2^e)."""
        total, at = 0, a << e if e > 0 else a
        for v in reversed(self.scaled(e)):
            total = total * at + v
        return (total > 0) - (total < 0)

    def largest(self, most: int) -> list[tuple[int, int, int]]:
        """(a, e, multiplicity) of the largest positive roots, each within 2^-PRECISION of a * 2^e by its size; ``most`` roots or more."""
        top = abs(self.c[-2]).bit_length()  # no root is beyond their sum
        open_ = [(0, top, self.above(0, 0), 0)]  # (a, a + 1] * 2^e holds so many roots, and so many are above
        found: list[tuple[int, int, int]] = []
        while open_ and sum(f[2] for f in found) < most:
            a, e, n, over = open_.pop()
            if not n:
                continue
            if a and a.bit_length() > PRECISION:
                found.append((2 * a + 1, e - 1, n))
                continue
            if n == 1 and a:
                # below a simple root the sign differs from that above it
                side = -1 if over % 2 else 1
                while a.bit_length() <= PRECISION:
                    a, e = 2 * a, e - 1
                    if self.sign(a + 1, e) not in (side, 0):
                        a += 1
                found.append((2 * a + 1, e - 1, 1))
                continue
            high = self.above(2 * a + 1, e - 1) - over
            open_.append((2 * a, e - 1, n - high, over + high))
            open_.append((2 * a + 1, e - 1, high, over))
        return found


def orthonormal(vectors: list[list[int]], bits: int) -> list[list[int]]:
    """The vectors, in fixed point with ``bits`` bits, made orthogonal and of length one."""
    out: list[list[int]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                dot = sum(x * y for x, y in zip(u, v)) >> bits
                v = [x - (dot * y >> bits) for x, y in zip(v, u)]
            norm = isqrt(sum(x * x for x in v))
            v = [(x << bits) // norm for x in v]
        out.append(v)
    return out


def null_space(m: np.ndarray, a: int, e: int, n: int) -> list[list[float]]:
    """n orthonormal vectors that m - a * 2^e takes to (nearly) nothing, by inverse iteration in fixed-point integers."""
    d, bits = len(m), 2 * PRECISION
    fraction = max(0, -e)
    lu = (m * (1 << fraction) - np.diag([a << max(0, e)] * d)).astype(object)
    lu, order = lu * (1 << 64), list(range(d))
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda r: abs(lu[k + r, k]))
        if pivot != k:
            lu[[k, pivot]] = lu[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not lu[k, k]:
            lu[k, k] = 1
        if k + 1 < d:
            factor = (lu[k + 1 :, k] * (1 << bits)) // lu[k, k]
            lu[k + 1 :, k + 1 :] -= (factor[:, None] * lu[k, None, k + 1 :]) // (1 << bits)
            lu[k + 1 :, k] = factor
    vectors = [[((i + 1) * (2 * j + 3) ** 5 * 7919 + (i + 1) * j) % 10_007 - 5003 << bits for j in range(d)] for i in range(n)]
    for _ in range(2):
        solved = []
        for v in vectors:
            x = [v[r] for r in order]
            for k in range(d):
                x[k] -= sum(int(lu[k, j]) * x[j] for j in range(k)) >> bits
            for k in range(d - 1, -1, -1):
                x[k] = ((x[k] << fraction + 64) - sum(int(lu[k, j]) * x[j] for j in range(k + 1, d))) // int(lu[k, k])
            norm = isqrt(sum(y * y for y in x)) or 1
            solved.append([(y << bits) // norm for y in x])
        vectors = orthonormal(solved, bits)
    out = []
    for v in vectors:
        sign = -1 if max(v, key=abs) < 0 else 1
        out.append([sign * y / (1 << bits) for y in v])
    return out


def components(spark: SparkSession, m: np.ndarray, most: int = MAX_COMPONENTS) -> tuple[np.ndarray, list[float], list[float]]:
    """Eigenvectors (columns) of the largest positive eigenvalues of m, the eigenvalues, and their shares of the trace."""
    d, trace = len(m), int(np.trace(m)) if len(m) else 0
    if not trace:
        return np.zeros((d, 0)), [], []
    common = gcd(*[int(v) for v in m.flat])
    reduced = m // common
    roots = Roots(characteristic(spark, reduced)).largest(most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                got = null_space(reduced, *roots[k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(got)), pa.array(range(len(got))), pa.array(got, pa.list_(pa.float64()))], names=["id", "nth", "vector"])

    rows = sorted(spark.range(0, len(roots), 1, max(1, len(roots))).mapInArrow(work, "id long, nth long, vector array<double>").collect())[:most]
    exact = [(roots[r["id"]][0] * common, roots[r["id"]][1]) for r in rows]
    values = [(a << e, 1) if e > 0 else (a, 1 << -e) for a, e in exact]
    return np.array([r["vector"] for r in rows]).T, [a / b for a, b in values], [a / (b * trace) for a, b in values]


def projected(df: DataFrame, id_col: str | None, fitted: Moments, vectors: np.ndarray, values: list[float]) -> DataFrame:
    """deviation and whitened values of rows with integer vectors x."""
    d, n = vectors.shape[0], fitted.n
    sums = fitted.y_sums
    scale = vectors * (n / np.sqrt(np.array(values)))  # values are n^2 times the covariance's
    top_sum = int(max(map(abs, sums)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column("x"), d) - OFFSET
            top = n * int(max(y.max(), -int(y.min()))) + top_sum if len(y) else 0
            if top * top * d < 2**63:
                z = n * y - sums.astype(np.int64)
                deviation = pa.array((z * z).sum(axis=1))
            else:
                z = y.astype(object) * n - sums
                deviation = pa.array([int(v) if v < 2**63 else None for v in (z * z).sum(axis=1)], pa.int64())
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * scale.shape[1], pa.int32()), pa.array(((z / n).astype(np.float64) @ scale).ravel()))
            ids = [b.column(id_col)] if id_col else []
            yield pa.RecordBatch.from_arrays([*ids, deviation, w], names=[*([id_col] if id_col else []), "deviation", "w"])

    kept = f"{id_col} {df.schema[id_col].dataType.simpleString()}, " if id_col else ""
    return df.select(*([id_col] if id_col else []), "x").mapInArrow(work, f"{kept}deviation long, w array<double>")


def identity_error(fit: DataFrame, fitted: Moments, vectors: np.ndarray, values: list[float]) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    c = len(values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, outer = np.zeros(c), np.zeros((c, c))
        for b in batches:
            w = matrix(b.column("w"), c)
            sums, outer = sums + w.sum(axis=0), outer + w.T @ w
        told = np.r_[sums, outer.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(told)), pa.int64()), pa.array(told)], names=["cell", "v"])

    got = projected(fit, None, fitted, vectors, values).mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    told = np.array([r["v"] for r in got]) / fitted.n
    mean, second = told[:c], told[c:].reshape(c, c)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(c)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", most: int = MAX_COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    spark = df.sparkSession
    good = usable(df.select(id_col, vec), vec).select(F.col(id_col), integers(F.col(vec)).alias("x"))
    # the vectors' own shuffle: rows of one vector meet in parts, so a very common one is one row a task before it
    fit = written(good.select("x").distinct(), "fit")
    one = fit.first()
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if one is None:
        return spark.createDataFrame([], schema)
    fitted = Moments(fit, len(one["x"]))
    vectors, values, shares = components(spark, fitted.m, most)
    if not values:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, fitted, vectors, values)
    rows = projected(good, id_col, fitted, vectors, values).select(id_col, "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("k") + 1)
    return rows.select(id_col, (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
