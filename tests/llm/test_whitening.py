"""Whitening against plain numpy, the exact polynomial against known roots, and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from veriloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n, width, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in draw.standard_normal(width) * np.arange(1, width + 1) / 4], 1) for i in range(n)]


def test_whitened_rows_match_numpy(spark):
    rows = rows_of(200, 6)
    rows += [rows[3], (None, rows[5][1], None), (900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [math.nan] * 6, 1), (903, [math.inf] + [0.0] * 5, 1), (904, [], 2), (905, [0.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).repartition(5)
    got = W.whiten(df, 4).collect()
    sound = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.array([[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in [*r[1], *[0.0] * (6 - len(r[1]))]] for r in sound], object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors / np.sqrt(values)
    assert len(got) == 4 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    signs = [np.sign(by_id[0, c + 1][0].whitened * want[0, c]) for c in range(4)]
    deviations = ((n * x - sums) ** 2).sum(axis=1)
    for i, row in enumerate(sound):
        for c in range(4):
            r = by_id[row[0], c + 1][0]
            assert r.deviation == deviations[i]
            assert abs(r.whitened - signs[c] * want[i, c]) < 1e-9 and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9
    assert len(by_id[3, 1]) == 2 and len(by_id[None, 1]) == 1


def test_equal_vectors_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(5)], SCHEMA)
    assert W.whiten(df).collect() == [] and W.whiten(df.limit(0)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1) for i in range(5)], SCHEMA)
    got = W.whiten(line).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_polynomial_and_roots_are_exact(spark):
    rng = random.Random(3)
    b = np.array([[rng.randint(-50, 50) for _ in range(5)] for _ in range(7)], object)
    matrix = tuple(map(tuple, (b.T @ b).tolist()))
    found = W.characteristic_polynomial(spark, matrix)
    real = np.array(matrix, float)
    assert np.allclose([float(c) for c in found], np.poly(real), rtol=1e-9)
    # repeated roots: 7 twice, 3, 0
    same = ((7, 0, 0, 0), (0, 7, 0, 0), (0, 0, 3, 0), (0, 0, 0, 0))
    roots = W.largest_roots(W.characteristic_polynomial(spark, same), 4)
    assert [r / 2**W.FRACTION_BITS for r in roots] == [7, 7, 3]
    vectors = W.null_vectors(same, roots)
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-12) and np.allclose(np.array(same) @ vectors.T, vectors.T * [7, 7, 3])


def test_large_entries_stay_exact():
    y = np.array([[1 << 40, 3], [-(1 << 40), 5]], np.int64)
    assert W.products(y).tolist() == [[1 << 81, -2 << 40], [-2 << 40, 34]]
    assert W.sum_of(np.array([[1 << 62], [1 << 62]], np.int64)).tolist() == [1 << 63]
