import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.operators import cells as C
from lumenarc.operators import graph as G
from lumenarc.operators import layout as L

SF = "/root/testdata/sf0.01"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")


def places(layout):
    return np.array([r["at"] for r in layout.rows.orderBy("id").collect()])


def trust(x, y, k=10):
    """By its definition, with cosine distances of x."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x)
    order = lambda d: np.argsort(d + np.diag([np.inf] * n), axis=1, kind="stable")
    rank = np.empty((n, n), int)
    np.put_along_axis(rank, order(1 - u @ u.T), np.arange(1, n + 1)[None].repeat(n, 0), 1)
    near = order(((y[:, None] - y[None]) ** 2).sum(2))[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0)
    return 1 - 2 * over.sum() / (n * k * (2 * n - 3 * k - 1))


def test_curve_fits_its_target():
    a, b = L.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))


def test_memberships_sum_to_the_logarithm():
    d = np.sort(np.random.default_rng(0).uniform(0.5, 2, size=(20, 15)), axis=1)
    w = L.memberships(d)
    assert np.allclose(w.sum(1), np.log2(15), atol=1e-3) and np.allclose(w[:, 0], 1)
    d[0, 10:] = np.inf
    assert L.memberships(d)[0, 10:].sum() == 0
    assert np.isfinite(L.memberships(np.zeros((3, 4)))).all()


def test_fuzzy_union_of_both_directions(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    near = C.nearest_others(C.Cells(frame(spark, x).select("id", F.col("embedding").alias("v"))), 5)
    one = {(r["id"], r["other"]): r["w"] for r in L.weighted(near).collect()}
    got = {(r["id"], r["other"]): r["w"] for r in L.fuzzy_graph(near).collect()}
    for i, j in one:
        a, b = one[i, j], one.get((j, i), 0.0)
        assert got[i, j] == pytest.approx(a + b - a * b) == pytest.approx(got[j, i])


@pytest.mark.parametrize("dims", [2, 3])
def test_groups_stay_apart_and_a_seed_fixes_the_layout(spark, dims):
    rng = np.random.RandomState(42)
    x = np.vstack([rng.randn(15, 50) + 3, rng.randn(15, 50) - 3])
    first = places(L.reduce_dimensions(frame(spark, x), "id", dims=dims, rounds=3, epochs=60))
    assert first.shape == (30, dims) and np.isfinite(first).all()
    d = np.sqrt(((first[:, None] - first[None]) ** 2).sum(2))
    assert d[:15, :15].mean() < 0.5 * d[:15, 15:].mean()
    if dims == 2:
        assert np.allclose(first, places(L.reduce_dimensions(frame(spark, x), "id", dims=dims, rounds=3, epochs=60)))


def test_small_and_odd_tables(spark):
    assert places(L.reduce_dimensions(frame(spark, np.random.RandomState(42).randn(6, 10)), "id", neighbours=5, rounds=2, epochs=20)).shape == (6, 2)
    one = L.reduce_dimensions(frame(spark, [[1.0, 2.0]]), "id")
    assert places(one).tolist() == [[0.0, 0.0]]
    assert L.reduce_dimensions(frame(spark, [[1.0, 2.0]]).limit(0), "id").rows.count() == 0
    assert places(L.reduce_dimensions(frame(spark, [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), "id", rounds=1, epochs=5)).shape == (2, 2)


def test_neighbourhoods_are_kept_better_than_by_components(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    x = np.array([r["embedding"] for r in df.orderBy("id").collect()], float)
    layout = L.reduce_dimensions(df, "id")
    flat = np.array([[r["x"], r["y"]] for r in G.project_2d(df, "id").orderBy("id").collect()])
    mine = trust(x, places(layout))
    assert mine > trust(x, flat) + 0.02
    n = len(x)
    true = C.nearest_others(C.Cells(C.unit_rows(df, "id")), n - 1)
    near = C.nearest_others(C.Cells(layout.rows.select("id", F.col("at").alias("v"))), 10)
    assert L.trustworthiness(true, near, n, 10) == pytest.approx(mine, abs=1e-3)


def test_new_rows_come_near_their_neighbours(spark):
    rng = np.random.RandomState(1)
    x = np.vstack([rng.randn(20, 8) + 4, rng.randn(20, 8) - 4])
    layout = L.reduce_dimensions(frame(spark, x), "id", rounds=2, epochs=60)
    at = places(layout)
    new = spark.createDataFrame([(0, (x[0] + 0.01).tolist()), (7, (x[30] + 0.01).tolist()), (8, [0.0] * 8)], "id long, embedding array<double>")
    got = {r["id"]: np.array(r["at"]) for r in layout.place(new, "id").collect()}
    assert sorted(got) == [0, 7]
    for i, own, other in ((0, slice(0, 20), slice(20, 40)), (7, slice(20, 40), slice(0, 20))):
        assert np.linalg.norm(got[i] - at[own].mean(0)) < np.linalg.norm(got[i] - at[other].mean(0))
    assert np.allclose(at, places(layout))
