from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import whitening as W


def exact(vectors):
    """n, S and n² V by rational arithmetic."""
    x = [[floor(1024 * Fraction(c)) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    m = [[Fraction(sum(v[i] * v[j] for v in y), n) for j in range(len(s))] for i in range(len(s))]
    return n, s, m, y


def collected(df):
    rows = W.whitening_report(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    return rows, by


def check(spark, vectors, tolerance=1e-8):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    n, s, m, y = exact(vectors)
    rows, by = collected(df)
    scatter = W.Scatter(df.select(F.col("embedding").alias("__v")), len(s), shift=99_000)
    assert (scatter.n, [int(v) for v in scatter.sums]) == (n, s)
    assert [[int(v) for v in row] for row in scatter.matrix] == m
    unit = max(abs(v) for row in m for v in row)
    values, vectors_ = np.linalg.eigh(np.array([[float(v / unit) for v in row] for row in m]))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(8, int((values > len(s) * 2.3e-16 * values[0]).sum()))
    trace = sum(m[i][i] for i in range(len(s)))
    for i, v in enumerate(y):
        assert sorted(by[i]) == list(range(1, k + 1))
        assert {int(r["deviation_text"]) for r in by[i].values()} == {sum(c * c for c in v)}
        for r in by[i].values():
            assert r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 2**63 else None)
    for j in range(k):
        assert by[0][j + 1]["explained"] == pytest.approx(float(Fraction(values[j]) * unit / trace), rel=1e-6)
    white = np.array([[by[i][j + 1]["whitened"] for j in range(k)] for i in range(n)])
    centred = white - white.mean(0)
    error = np.abs(centred.T @ centred / n - np.eye(k)).max()
    assert error < tolerance
    assert rows[0]["identity_error"] == pytest.approx(error, abs=1e-9)
    scale = max(abs(c) for v in y for c in v)
    plain = np.array([[float(Fraction(c, scale)) for c in v] for v in y])
    want = plain @ vectors_[:, :k] / np.sqrt(values[:k]) * float(scale / Fraction(unit) ** Fraction(1, 2)) if unit < 10**300 else None
    if want is not None and len(set(np.round(values[:k], 9))) == k:
        assert np.allclose(np.abs(want), np.abs(white), atol=1e-6)


def test_equals_rational_arithmetic(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12)) @ np.diag(np.linspace(1, 4, 12))
    check(spark, base.tolist())


def test_large_and_tiny_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    check(spark, (rng.normal(size=(20, 4)) * 1e15).tolist())
    check(spark, (rng.normal(size=(20, 3)) * 2**40 + 2.0**52).tolist())
    check(spark, np.round(rng.normal(size=(30, 5)) / 100, 3).tolist())


def test_fewer_dimensions_and_lower_rank(spark):
    rng = np.random.default_rng(7)
    thin = rng.integers(-5, 6, size=(40, 2)).astype(float)
    check(spark, np.hstack([thin, thin, np.full((40, 1), 3.0)]).tolist())
    check(spark, rng.normal(size=(15, 3)).tolist())


def test_limbs_give_the_number_back():
    values = np.array([0, 1, -1, 2**31, -(2**33), 3**90, -(5**70)], object)
    got = W.limbs(values)
    assert [sum(int(limb[i]) << (32 * k) for k, limb in enumerate(got)) for i in range(len(values))] == list(values)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 7, "a"), (2, None, 7, "b"), (3, [nan, 1.0], 7, "c"), (4, [1.0, inf], 7, None), (5, [None, 1.0], 7, "e"), (6, [], 7, "f"), (7, [1.0, 2.0, 3.0], 7, "g"), (8, [4.0, -1.0], None, "h"), (None, [0.0, 5.0], 7, "i"), (1, [1.0, 2.0], 7, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, __v string")
    got = W.whitening_report(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (8, 2)]
    assert {r["n"] for r in got} == {4}


def test_no_spread_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0])], schema)
    assert W.whitening_report(one).collect() == []
    assert W.whitening_report(one.union(one)).collect() == []
    empty = W.whitening_report(one.limit(0))
    assert empty.collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], schema)
    assert dict(empty.dtypes) == dict(W.whitening_report(two).dtypes)


def test_whole_table_meets_the_contract(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, by = collected(df)
    assert len(by) == df.count() and all(sorted(v) == list(range(1, 9)) for v in by.values())
    assert all(r["identity_error"] <= 1e-9 for r in rows)
