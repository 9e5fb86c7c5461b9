"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, so count, sums and scatter ``A = n * sum(x x') - S S'`` are exact whatever the partitioning
(``A`` is ``n**2`` times the covariance). The characteristic polynomial of ``A`` is computed modulo many 31-bit primes,
each by reduction to Hessenberg form, one prime per row of a Spark job, and put together by Chinese remaindering. A
symmetric matrix has real roots only, so the sign changes of the shifted polynomial count its roots above any number
exactly; bisection on that count isolates the roots with multiplicity and refines them to ``FRACTION_BITS`` binary
places. Components are null vectors of ``A - root``: inverse iteration in fixed-point numbers of ``PRECISION`` bits,
orthogonal to the vectors of roots that are equal in all computed places.

What the driver holds depends on the number of dimensions only. Rows are read three times: sums, covariance of what was
whitened (the reported error is measured, not derived), result.

Defined results: vectors that are null or hold null or non-finite entries are dropped; a shorter vector, the empty one
too, counts as padded with zeros to the longest; entries beyond ``2**62 / 64`` count as that bound. Repeated rows count
as often as they come and null ids stay. Components of eigenvalue zero cannot be scaled to one and are left out, so a
table of equal vectors gives no rows, as an empty one does. A deviation beyond 64 bits is an error, not a wrapped number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
FRACTION_BITS = 64
PRECISION = 320
ENTRY_BOUND = 1 << 62
SOUND = "embedding IS NOT NULL AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"


def sound_rows(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter(F.coalesce(F.expr(SOUND), F.lit(False))).select("vec_id", "embedding")


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """``floor(64 * entry)`` of each vector, padded with zeros; the constant shift is left to ``SHIFT``."""
    lengths = np.asarray(column.value_lengths())
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    flat = np.clip(flat, -float(ENTRY_BOUND), float(ENTRY_BOUND)).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def products(y: np.ndarray) -> np.ndarray:
    """``y' y`` in exact integers: in doubles where every partial sum fits 53 bits, else in Python's integers."""
    if not len(y):
        return np.zeros((y.shape[1], y.shape[1]), object)
    peak = max(int(y.max()), -int(y.min()), 1)
    step = (1 << 53) // (peak * peak)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), max(1, step)):
        part = y[at : at + max(1, step)]
        if step:
            real = part.astype(np.float64)
            total += (real.T @ real).astype(np.int64).astype(object)
        else:
            total += part.T.astype(object) @ part.astype(object)
    return total


def sum_of(y: np.ndarray) -> np.ndarray:
    """Sums of the columns in exact integers."""
    small = not y.size or max(int(y.max()), -int(y.min())) * len(y) < 1 << 62
    return y.sum(axis=0).astype(object) if small else y.astype(object).sum(axis=0)


@dataclass(frozen=True)
class Moments:
    """Count, sums and scatter of the integers, all exact."""

    n: int
    sums: tuple[int, ...]
    scatter: tuple[tuple[int, ...], ...]

    @property
    def dims(self) -> int:
        return len(self.sums)


def moments(rows: DataFrame) -> Moments:
    """Exact moments of ``rows(embedding)``: one partial sum per task and pair of dimensions, added up by Spark."""
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            y = integers(batch.column(0), dims)
            n += len(y)
            sums += sum_of(y)
            square += products(y)
        upper = [(i, j) for i in range(dims) for j in range(i, dims)]
        entries = [(-1, -1, n)] + [(-1, i, int(s)) for i, s in enumerate(sums)] + [(i, j, int(square[i, j])) for i, j in upper]
        i, j, value = zip(*entries, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in value])], ["i", "j", "value"])

    parts = rows.select("embedding").mapInArrow(partial, "i int, j int, value string")
    found = {(r.i, r.j): int(r.value) for r in parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    n, sums = found.get((-1, -1), 0), [found.get((-1, i), 0) for i in range(dims)]
    scatter = [[n * found.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    return Moments(n, tuple(sums), tuple(map(tuple, scatter)))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, isqrt(n) + 1))


def primes(bits: int) -> list[int]:
    """Primes below 2**31, from the largest, whose product has more than ``bits`` bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, leading first, of ``det(x - matrix)`` modulo ``p``, by reduction to Hessenberg form."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        inverse = pow(int(h[m, m - 1]), -1, p)
        factors = h[m + 1 :, m - 1] * inverse % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    polynomials = [np.array([1], np.int64)]  # lowest power first, of the leading blocks
    for k in range(1, d + 1):
        out = np.zeros(k + 1, np.int64)
        out[1:] = polynomials[-1]
        out[:k] = (out[:k] - int(h[k - 1, k - 1]) * polynomials[-1] % p) % p
        product = 1
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % p
            factor = product * int(h[k - i - 1, k - 1]) % p
            if factor:
                shorter = polynomials[k - i - 1]
                out[: len(shorter)] = (out[: len(shorter)] - factor * shorter % p) % p
        polynomials.append(out)
    return [int(c) for c in polynomials[-1][::-1]]


def characteristic_polynomial(spark, matrix: tuple[tuple[int, ...], ...]) -> list[int]:
    """Integer coefficients, leading first, of ``det(x - matrix)``, for a symmetric positive semidefinite matrix.

    The k-th coefficient is a sum of ``comb(d, k)`` principal minors, each at most ``(trace / k)**k``, so the bound on the
    primes' product is proven.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max((comb(d, k) * (trace // k + 1) ** k for k in range(1, d + 1)), default=1)
    chosen = primes(bound.bit_length() + 2)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [polynomial_modulo(np.array([[v % p for v in row] for row in matrix], np.int64), p) for p in frame["p"].tolist()]
            yield pd.DataFrame({"p": frame["p"], "coefficients": rows})

    spread = spark.range(len(chosen)).select(F.element_at(F.lit(chosen).cast("array<long>"), (F.col("id") + 1).cast("int")).alias("p"))
    residues = spread.mapInPandas(reduce, "p long, coefficients array<long>").collect()
    product, values = 1, [0] * (d + 1)
    for row in residues:  # one prime after another: the value stays right modulo the product so far
        step = pow(product, -1, row.p)
        values = [v + product * ((c - v) * step % row.p) for v, c in zip(values, row.coefficients, strict=True)]
        product *= row.p
    return [v - product if 2 * v > product else v for v in values]


def roots_above(coefficients: list[int], t: int) -> int:
    """How many roots, with multiplicity, of a real-rooted polynomial lie above the integer ``t``: sign changes after a shift."""
    shifted = list(coefficients)
    d = len(shifted) - 1
    for stop in range(d, 0, -1):
        carry = shifted[0]
        for i in range(1, stop + 1):
            carry = carry * t + shifted[i]
            shifted[i] = carry
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(coefficients: list[int], t: int) -> int:
    value = 0
    for c in coefficients:
        value = value * t + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], count: int, bits: int = FRACTION_BITS) -> list[int]:
    """The ``count`` largest positive roots, falling and with multiplicity, as integers scaled by ``2**bits`` (rounded up)."""
    while len(coefficients) > 1 and coefficients[-1] == 0:  # roots zero, exactly
        coefficients = coefficients[:-1]
    d = len(coefficients) - 1
    if not d:
        return []
    scaled = [c << (bits * i) for i, c in enumerate(coefficients)]
    high = -scaled[1]  # the trace: no root of a semidefinite matrix lies above it
    open_, found = [(0, high, d, 0)], []  # roots in (low, high]: above low, above high
    while open_ and len(found) < count:
        low, high, above_low, above_high = open_.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1:  # isolated: one change of sign, found by values alone
            upper = sign_at(scaled, high)
            while high - low > 1 and upper:
                middle = (low + high) // 2
                sign = sign_at(scaled, middle)
                low, high, upper = (low, middle, sign) if sign == upper or not sign else (middle, high, upper)
            found.append(high)
        elif high - low == 1:
            found.extend([high] * inside)
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            open_.append((low, middle, above_low, above))
            open_.append((middle, high, above, above_high))
    return found[:count]


def null_vectors(matrix, roots: list[int], bits: int = FRACTION_BITS, precision: int = PRECISION) -> np.ndarray:
    """Unit vectors ``v`` with ``matrix v = root v``, one row per root, by inverse iteration in fixed-point numbers.

    A root is known to half a unit of ``2**-bits``, so ``matrix - root`` is nearly singular: its factors, taken once a
    root with row exchanges, magnify the wanted direction by the ratio of the gap to that error in each step. The signs
    make the largest entry positive.
    """
    d = len(matrix)
    one = 1 << precision
    exact = np.array([[v << precision for v in row] for row in matrix], object).reshape(d, d)
    size = max((abs(v) for row in matrix for v in row), default=1).bit_length()
    out: list[np.ndarray] = []
    tiny = 1 << max(1, precision - bits - 8)

    def unit(v):
        peak = max(abs(x) for x in v)
        v = v * one // peak
        return v * one // isqrt(sum(int(x) * int(x) for x in v))

    for k, root in enumerate(roots):
        a = exact.copy()
        a[np.diag_indices(d)] -= root << (precision - bits)
        order = list(range(d))
        for c in range(d - 1):
            pivot = c + max(range(d - c), key=lambda i, c=c: abs(a[c + i, c]))
            if pivot != c:
                a[[c, pivot]] = a[[pivot, c]]
                order[c], order[pivot] = order[pivot], order[c]
            if a[c, c] == 0:
                a[c, c] = tiny
            a[c + 1 :, c] = (a[c + 1 :, c] << precision) // a[c, c]
            a[c + 1 :, c + 1 :] -= (a[c + 1 :, c][:, None] * a[c, c + 1 :]) >> precision
        if a[d - 1, d - 1] == 0:
            a[d - 1, d - 1] = tiny
        earlier = [out[i] for i in range(k) if abs(roots[i] - root) <= 2]
        v = unit(np.array([one + (one * ((7 * i + 3 * len(earlier)) % 11) // 13) for i in range(d)], object))
        for _ in range(4):
            v = v[order] << size
            for i in range(1, d):
                v[i] -= int((a[i, :i] * v[:i]).sum()) >> precision
            for i in range(d - 1, -1, -1):
                rest = v[i] - (int((a[i, i + 1 :] * v[i + 1 :]).sum()) >> precision)
                v[i] = (rest << precision) // int(a[i, i])
            v = unit(v)
            for other in earlier:
                v = v - (other * (int((v * other).sum()) >> precision) >> precision)
            v = unit(v)
        out.append(v)
    real = np.array([[int(x) / one for x in v] for v in out], np.float64).reshape(len(out), d)
    signs = np.sign(real[np.arange(len(real)), np.abs(real).argmax(axis=1)]) if len(real) else np.ones(0)
    return real * signs[:, None]


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: tuple[float, ...]
    explained: tuple[float, ...]
    projection: np.ndarray

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """``n * x - S`` in exact integers."""
        n, sums = self.moments.n, np.array(self.moments.sums, object)
        peak = max((max(int(y.max()), -int(y.min())) if y.size else 0) * n, max(map(abs, self.moments.sums), default=0))
        return n * y - sums.astype(np.int64) if 2 * peak < 1 << 62 else n * y.astype(object) - sums

    def squared(self, deviations: np.ndarray) -> np.ndarray:
        peak = max((abs(int(v)) for v in (deviations.max(), deviations.min())), default=0) if deviations.size else 0
        if peak * peak * max(1, deviations.shape[1]) < 1 << 63:
            return (deviations.astype(np.int64) ** 2).sum(axis=1)
        return np.array([int(v) for v in (deviations.astype(object) ** 2).sum(axis=1)], np.int64)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.moments.n) @ self.projection


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    found = moments(rows)
    n = max(1, found.n)
    trace = sum(found.scatter[i][i] for i in range(found.dims))
    roots = largest_roots(characteristic_polynomial(rows.sparkSession, found.scatter), components) if trace else []
    vectors = null_vectors(found.scatter, roots)
    values = tuple(r / ((n * n) << FRACTION_BITS) for r in roots)
    projection = (vectors / np.sqrt(np.array(values)).reshape(-1, 1)).T
    return Whitening(found, values, tuple(r / (trace << FRACTION_BITS) for r in roots), projection)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, from sums over all rows."""
    k, n, dims = len(model.values), model.moments.n, model.moments.dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(model.deviations(integers(batch.column(0), dims)))
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        i, j = np.divmod(np.arange((k + 1) * k, dtype=np.int32), np.int32(k))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "value"])

    sums = np.zeros((k + 1, k))
    for r in rows.select("embedding").mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        sums[r[0], r[1]] = r[2]
    mean = sums[0] / n
    return float(np.abs(sums[1:] / n - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector of ``embeddings(vec_id, embedding)`` and component; columns as in ``SCHEMA``."""
    rows = sound_rows(embeddings)
    model = fit(rows, components)
    k, n, dims = len(model.values), model.moments.n, model.moments.dims
    if not k:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations = model.deviations(integers(batch.column(1), dims))
            rows_here = len(deviations)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(rows_here), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                    pa.array(np.full(rows_here * k, n)), pa.array(np.repeat(model.squared(deviations), k)),
                    pa.array(model.whitened(deviations).ravel()), pa.array(np.tile(np.array(model.explained), rows_here)),
                    pa.array(np.full(rows_here * k, error)),
                ],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
