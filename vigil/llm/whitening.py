"""Whitening by the exact characteristic polynomial of the integer scatter.

Vectors become integers, so that their scatter matrix is an exact integer matrix, summed over all tasks. Its
characteristic polynomial is computed modulo many primes by Hessenberg reduction, one prime a row, and joined by
Chinese remaindering. All its roots are real and not negative: the number of roots above a point is the number of
sign changes of the polynomial moved there, which isolates the wanted roots by bisection to any precision.
Components come from inverse iteration on the null space at a root, in integers, one component a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LIMB = 20  # bits of a factor: block products of factors are exact in doubles
BLOCK = 4096  # rows of such a product
DIGIT = 60  # bits of a number sent as a row
ROOT_BITS = 192  # bits to which a root is found, from the largest root's first
SOLVE_BITS = 320  # fraction bits of the solver
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def to_integers(c: np.ndarray, scale: int, shift: int) -> tuple[np.ndarray, bool]:
    """floor(scale * c), exactly, as double precision if all fit 2**53, else as Python integers; values whose sum with
    ``shift`` leaves the range of a long stay at its end."""
    y = np.floor(c * float(scale))
    if np.abs(y).max(initial=0) < 2.0**53:
        return y, True
    big = [[min(max(math.floor(Fraction(v) * scale), LEAST - min(0, shift)), MOST - max(0, shift)) for v in row] for row in c.tolist()]
    return np.array(big, object).reshape(c.shape), False


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as factors of 2**LIMB each, lowest first; only the last may be negative."""
    out = []
    while np.abs(y).max(initial=0) >= 1 << LIMB:
        low = y % (1 << LIMB)
        out.append(low.astype(np.float64))
        y = (y - low) // (1 << LIMB)
    return [*out, y.astype(np.float64)]


def scatter_sums(y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and sums of products of the columns of the integers ``y``."""
    parts, d = _limbs(y), y.shape[1]
    total, products = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(y), BLOCK):
        block = [p[at:at + BLOCK] for p in parts]
        for i, a in enumerate(block):
            total += a.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
            for j, b in enumerate(block):
                products += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total.tolist(), products.tolist()


def _digits(v: int) -> list[int]:
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << DIGIT) - 1)))
        v >>= DIGIT
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scatter(vectors: DataFrame, width: int, scale: int, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of the integers floor(scale * c) over all rows of ``vectors`` (v array<double>); a task
    sends one row a pair of dimensions, the driver gets one a pair."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for b in batches:
            if len(b):
                t, p = scatter_sums(to_integers(_vectors(b.column(0)), scale, shift)[0])
                n, total, products = n + len(b), total + np.array(t, object), products + np.array(p, object)
        if not n:
            return
        rows = [(-1, -1, 0, n)]
        rows += [(i, -1, k, x) for i in range(width) for k, x in enumerate(_digits(total[i]))]
        rows += [(i, j, k, x) for i in range(width) for j in range(i, width) for k, x in enumerate(_digits(products[i, j]))]
        for at in range(0, len(rows), 10_000):
            cols = list(zip(*rows[at:at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "x"])

    found = vectors.select("v").mapInArrow(add, "i int, j int, k int, x long").groupBy("i", "j", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    n, total, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for r in found.collect():  # a few rows a pair of dimensions
        value = int(r["x"]) << (DIGIT * r["k"])
        if r["i"] < 0:
            n += value
        elif r["j"] < 0:
            total[r["i"]] += value
        else:
            products[r["i"]][r["j"]] += value
            if r["i"] != r["j"]:
                products[r["j"]][r["i"]] += value
    return n, total, products


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(xI - matrix) modulo a prime below 2**31, by reduction to Hessenberg form."""
    h, d = (matrix % p).astype(np.int64), len(matrix)
    for m in range(1, d - 1):
        rows = np.flatnonzero(h[m:, m - 1])
        if not len(rows):
            continue
        r = m + int(rows[0])
        if r != m:
            h[[r, m]] = h[[m, r]]
            h[:, [r, m]] = h[:, [m, r]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - h[k, k] * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            new[:i + 1] = (new[:i + 1] - below * int(h[i, k]) % p * polys[i]) % p
        polys.append(new % p)
    return polys[d].tolist()


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit`` (Miller-Rabin with bases that decide all numbers below 2**32)."""
    def prime(n):
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7):
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(s - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    out, n = [], limit - 1 - limit % 2
    while len(out) < count:
        if prime(n):
            out.append(n)
        n -= 2
    return out


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first, of det(xI - matrix) for a positive semidefinite integer matrix: as many primes as
    the bound on its coefficients needs and one more as a check, dealt out as rows."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the coefficient of x**(d - k) is at most C(d, k) (trace / k)**k
    bound = max([1, *(math.comb(d, k) * (trace // k + 1) ** k for k in range(1, d + 1))])
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 2)
    shared = spark.sparkContext.broadcast(matrix)

    def reduce_mod(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.array(shared.value, object)
        for b in batches:
            p = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([charpoly_mod(a, q) for q in p], pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64)).mapInArrow(reduce_mod, "p long, c array<long>")
    found = {r["p"]: r["c"] for r in rows.collect()}  # (dimension + 1) numbers a prime
    *used, check = primes
    product = reduce(int.__mul__, used, 1)
    out = [0] * (d + 1)
    for p in used:
        rest = product // p
        weight = rest * pow(rest, -1, p)
        for i, c in enumerate(found[p]):
            out[i] += c * weight
    out = [c % product for c in out]
    out = [c - product if 2 * c > product else c for c in out]
    if [c % check for c in out] != found[check]:
        raise ArithmeticError("the characteristic polynomial fails its check prime")
    return out


def roots_above(coefficients: list[int], at: int) -> int:
    """Roots above ``at``, with multiplicity, of a polynomial whose roots are all real: the sign changes of its
    coefficients after moving ``at`` to 0."""
    c = list(coefficients)
    if at:
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(coefficients: list[int], at: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * at + c
    return value


def isolate_root(coefficients: list[int], number: int, trace: int) -> tuple[int, int, int, int]:
    """(root * 2**bits, bits, number of the first equal root, multiplicity) of the ``number``-th largest root, from 1, which
    must be above 0. Roots that agree in ROOT_BITS bits below the largest one's first count as equal."""
    d = len(coefficients) - 1
    bits = max(0, ROOT_BITS - trace.bit_length())
    c = [v << (bits * (d - i)) for i, v in enumerate(coefficients)]  # roots times 2**bits
    low, high, above_low, above_high = 0, (trace + 1) << bits, roots_above(c, 0), 0
    while high - low > 1 and above_low - above_high > 1:
        mid = (low + high) // 2
        n = roots_above(c, mid)
        if n >= number:
            low, above_low = mid, n
        else:
            high, above_high = mid, n
    sign = -1 if above_low % 2 else 1  # of the polynomial between low and the root, where it stands alone
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _value(c, mid) * sign > 0 else (low, mid)
    return high, bits, above_high + 1, above_low - above_high


def _solve(matrix: list[list[int]], right: list[list[int]]) -> list[list[int]]:
    """Solutions of matrix * x = column for every column of ``right`` (all numbers scaled by 2**SOLVE_BITS); a pivot of 0
    counts as the smallest number."""
    d, one = len(matrix), SOLVE_BITS
    rows = [list(a) + [r[i] for r in right] for i, a in enumerate(matrix)]
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        top = rows[k]
        if not top[k]:
            top[k] = 1
        for i in range(k + 1, d):
            if rows[i][k]:
                f = (rows[i][k] << one) // top[k]
                row = rows[i]
                rows[i] = row[:k] + [0] + [a - (f * b >> one) for a, b in zip(row[k + 1:], top[k + 1:])]
    out = []
    for col in range(len(right)):
        x = [0] * d
        for i in range(d - 1, -1, -1):
            s = rows[i][d + col] - sum(rows[i][j] * x[j] for j in range(i + 1, d) if x[j]) // (1 << one)
            x[i] = (s << one) // rows[i][i]
        out.append(x)
    return out


def _orthonormal(vectors: list[list[int]]) -> list[list[int]]:
    out = []
    for v in vectors:
        for _ in range(2):
            big = max(map(abs, v)).bit_length()
            v = [x << (SOLVE_BITS - big) if big <= SOLVE_BITS else x >> (big - SOLVE_BITS) for x in v]
            for u in out:
                dot = sum(a * b for a, b in zip(u, v)) >> SOLVE_BITS
                v = [a - (dot * b >> SOLVE_BITS) for a, b in zip(v, u)]
        norm = math.isqrt(sum(x * x for x in v))
        out.append([(x << SOLVE_BITS) // norm for x in v])
    return out


def null_space(matrix: list[list[int]], root: int, bits: int, multiplicity: int, trace: int) -> list[list[float]]:
    """Orthonormal basis of the null space of matrix - root / 2**bits, by inverse iteration from fixed starts. The
    vectors' largest component is positive."""
    d = len(matrix)
    scale = SOLVE_BITS - trace.bit_length()  # entries below 1
    up = lambda v, by: v << by if by >= 0 else v >> -by
    shifted = [[up((a << bits) - (root if i == j else 0), scale - bits) for j, a in enumerate(row)] for i, row in enumerate(matrix)]
    rng = np.random.default_rng(d)
    vectors = _orthonormal([[int(x * 2**52) << (SOLVE_BITS - 52) for x in rng.standard_normal(d)] for _ in range(multiplicity)])
    for _ in range(3):
        vectors = _orthonormal(_solve(shifted, vectors))
    out = []
    for v in vectors:
        top = max(v, key=abs)
        out.append([float(Fraction(x if top > 0 else -x, 1 << SOLVE_BITS)) for x in v])
    return out


def principal_components(spark, matrix: list[list[int]], components: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit eigenvector) of a positive semidefinite integer matrix, largest first, at most ``components``;
    eigenvalues 0 are left out. One component a row, solved in its own task."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return []
    poly = characteristic_polynomial(spark, matrix)
    wanted = min(components, roots_above(poly, 0))
    shared = spark.sparkContext.broadcast((matrix, poly))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = shared.value
        for b in batches:
            rows = []
            for k in b.column(0).to_pylist():
                root, bits, first, times = isolate_root(c, k, trace)
                rows.append((k, str(root), bits, null_space(a, root, bits, times, trace)[k - first]))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.list_(pa.float64()))],
                                                 names=["k", "root", "bits", "u"])

    rows = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k long").repartition(wanted).mapInArrow(solve, "k long, root string, bits long, u array<double>")
    return [(Fraction(int(r["root"]), 1 << r["bits"]), r["u"]) for r in sorted(rows.collect(), key=lambda r: r["k"])]  # components * dimension numbers


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, n, deviation decimal, whitened array<double>, explained array<double>, identity_error) a row of ``vectors``.

    Each entry c becomes the integer x = floor(scale * c) + shift; n is the number of rows used, S their sums by
    dimension. ``deviation`` is the sum over dimensions of (n x - S)**2, exact. ``whitened`` holds x - S / n projected on
    the unit eigenvectors of x's covariance (divisor n), largest eigenvalue first, over the root of the
    eigenvalue, ``explained`` the eigenvalues' shares of the trace. ``identity_error`` is the largest absolute
    entry of the whitened rows' measured covariance minus the identity.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are vectors of another length than
    the most frequent one (ties: the longest). There are fewer than ``components`` components where
    the dimension or the rank of the scatter is smaller: directions without variance cannot be whitened. Integers
    beyond the range of a long stay at its end. A ``deviation`` beyond 38 digits is null. Rows that repeat an id, and null ids, are rows
    of their own; other columns are not read; a table without usable rows gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "id {}, deviation decimal(38,0), w array<double>".format(vectors.schema[id_col].dataType.simpleString())
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = src.where(F.coalesce(fine & (F.size("v") > 0), F.lit(False)))
    widths = src.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = widths["w"] if widths else 1
    src = src.where(F.size("v") == width)
    n, total, products = scatter(src, width, scale, shift)
    matrix = [[n * products[i][j] - total[i] * total[j] for j in range(width)] for i in range(width)]  # n**2 times the covariance
    found = principal_components(spark, matrix, components)
    trace = sum(matrix[i][i] for i in range(width))
    shared = spark.sparkContext.broadcast((total, np.array([u for _, u in found]).reshape(-1, width) / np.array([[math.sqrt(e)] for e, _ in found]).reshape(-1, 1)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, u = shared.value
        small = max(map(abs, sums), default=0) < 1 << 61
        for b in batches:
            if not len(b):
                continue
            y, plain = to_integers(_vectors(b.column(1)), scale, shift)
            if plain and small and n * (np.abs(y).max(initial=0) + 1) < 2.0**61:
                off = n * y.astype(np.int64) - np.array(sums, np.int64)
            else:
                off = n * np.array(y.astype(object) if not plain else y.astype(np.int64).astype(object)) - np.array(sums, object)
            top = int(np.abs(off).max(initial=0))
            squares = (off * off if top * top * width < MOST else off.astype(object) ** 2).sum(axis=1)
            w = off.astype(np.float64) @ u.T
            dev = pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), dev, pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    out = materialize(src.mapInArrow(project, schema), "whitened")
    k = len(found)
    error = 0.0
    if k:
        means = out.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
        w = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        cov = out.agg(*[F.avg(w[i] * w[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(cells, cov))
    explained = F.array(*[F.lit(float(e / trace)) for e, _ in found]).cast("array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
                      explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
