import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.operators import search as S
from lumenarc.operators import vector_index as V
from lumenarc.sources.log import Conflict

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("year", (F.col("vec_id") % 30).cast("int"))


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return V.VectorIndex.build(rows, str(tmp_path_factory.mktemp("ix") / "a"), "vec_id", "embedding")


def query(rows, i):
    return [float(c) for c in rows.where(F.col("vec_id") == i).first()["embedding"]]


def brute(rows, q, k):
    got = S.nearest(rows.withColumnRenamed("vec_id", "chunk_id"), q, k).orderBy("rank").collect()
    return [(r["chunk_id"], round(r["distance"], 9), r["rank"]) for r in got]


def clustered(spark, n=3000, d=16, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 10
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.5
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>"), x


def test_recall_of_a_batch_against_the_full_scan(spark, rows, index):
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    wanted = S.nearest_batch(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, 10).select("query_id", F.col("chunk_id").alias("id"))
    got = index.search_batch(asked, 10)
    assert V.recall(got, wanted, ["query_id", "id"]) >= 0.95
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0


@pytest.mark.parametrize("i", [0, 7, 321])
def test_exact_search_equals_the_full_scan(rows, index, i):
    got = index.search_exact(query(rows, i), 15).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["distance"], 9), r["rank"]) for r in got] == brute(rows, query(rows, i), 15)


def test_filters_come_before_ranking(rows, index):
    q, cond = query(rows, 5), F.col("year").between(3, 6)
    exact = index.search_exact(q, 10, where=cond).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["distance"], 9), r["rank"]) for r in exact] == brute(rows.where(cond), q, 10)
    assert {r["year"] for r in index.search(q, 10, where=cond).collect()} <= {3, 4, 5, 6}
    assert index.search_exact(q, 600).count() == 500


def test_few_lists_are_read_where_vectors_lie_in_groups(spark, tmp_path):
    df, x = clustered(spark)
    index = V.VectorIndex.build(df, str(tmp_path / "c"), "id", "v", lists=40)
    q = x[11].tolist()
    plan = index.search(q, 10)._jdf.queryExecution().executedPlan().toString()
    state = index.log.state()
    assert state.meta["probes"] <= 8
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan)
    assert "struct<id:bigint,code:binary>" in index._approximate(index.log.read(), np.array(q), 10)._jdf.queryExecution().executedPlan().toString()
    of = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 0 < of(index.log.read().where(F.col("list").isin(index._probed(np.array(q), None)))) <= 0.3 * of(index.log.read())
    found = [r["id"] for r in index.search(q, 10).orderBy("rank").collect()]
    assert found == np.argsort(((x - x[11]) ** 2).sum(1), kind="stable")[:10].tolist()
    near = index.bounded(q, float(np.sort(((x - x[11]) ** 2).sum(1))[9] ** 0.5))
    assert 10 <= near.count() <= 0.2 * len(x)
    assert "gap" in near._jdf.queryExecution().executedPlan().toString()


def test_inserts_deletions_and_replacements_keep_it_right(spark, tmp_path):
    df, x = clustered(spark, n=600)
    index = V.VectorIndex.build(df.where("id < 400"), str(tmp_path / "d"), "id", "v", lists=20)
    index.insert(df.where("id >= 400"))
    index.delete(spark.createDataFrame([(3,), (401,)], "id long"))
    moved = spark.createDataFrame([(5, [0.0] * 16), (1000, [0.01] * 16)], "id long, v array<double>")
    index.upsert(moved)
    now = {i: v for i, v in enumerate(x.tolist()) if i not in (3, 401, 5)} | {5: [0.0] * 16, 1000: [0.01] * 16}
    for _ in range(2):
        assert index.rows().count() == len(now)
        for q in (x[3], x[5], np.zeros(16)):
            want = sorted(now, key=lambda i: (((np.array(now[i]) - q) ** 2).sum(), i))[:8]
            assert [r["id"] for r in index.search_exact(q.tolist(), 8).orderBy("rank").collect()] == want
        index.compact()
    again = V.VectorIndex(spark, index.root)
    assert again.search_exact([0.0] * 16, 1).first()["id"] == 5


def test_rows_that_cannot_be_indexed_and_names_that_clash(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, []), (5, [1.0]), (6, [3.0, 4.0]), (7, [None, 1.0]), (None, [5.0, 5.0])], "id long, v array<double>")
    index = V.VectorIndex.build(df, str(tmp_path / "e"), "id", "v")
    assert sorted((r["id"] or 0) for r in index.rows().collect()) == [0, 1, 6]
    assert [r["id"] for r in index.search_exact([1.0, 2.0], 5).orderBy("rank").collect()] == [1, 6, None]
    index.insert(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], "id long, v array<double>"))
    assert index.rows().count() == 3
    with pytest.raises(ValueError):
        V.VectorIndex.build(df.withColumn("list", F.lit(1)), str(tmp_path / "f"), "id", "v")
    with pytest.raises(ValueError):
        V.VectorIndex.build(df.limit(0), str(tmp_path / "g"), "id", "v")
    with pytest.raises(Conflict):
        V.VectorIndex.build(df, str(tmp_path / "e"), "id", "v")


def test_a_large_list_meets_queries_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 50)
    df, x = clustered(spark, n=500, groups=2)
    index = V.VectorIndex.build(df, str(tmp_path / "h"), "id", "v", lists=2)
    asked = df.where("id < 3").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    got = index.search_batch(asked, 5, probes=2, rerank=200).orderBy("query_id", "rank").collect()
    want = [(i, int(j)) for i in range(3) for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:5]]
    assert [(r["query_id"], r["id"]) for r in got] == want


def test_centres_and_codes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 4)) + c for c in (0, 20, 40)])
    centres = V.k_means(x, 3)
    assert sorted(round(c[0] / 20) for c in centres) == [0, 1, 2]
    codec = V.Codec.train(x, 3, block=2)
    at, gap, codes = codec.encode(x)
    assert np.allclose(gap, np.sqrt(((x - codec.centres[at]) ** 2).sum(1)))
    for number in range(3):
        here = at == number
        near = codec.rank(x[0], number, codes[here])
        exact = ((x[here] - x[0]) ** 2).sum(1)
        assert np.corrcoef(near, exact)[0, 1] > 0.9 or exact.std() < 1e-9
    again = V.Codec.load(codec.dump())
    assert (again.encode(x)[2] == codes).all()
    assert len(V.k_means(np.zeros((5, 2)), 9)) == 5
