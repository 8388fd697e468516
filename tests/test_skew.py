"""Shapes that would gather a table's rows in one task, or send each row many times."""

import numpy as np
from pyspark.sql import functions as F

from lumenarc.operators import graph as G
from lumenarc.operators.cells import Cells, nearest_others


def test_components_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB_EDGES", 20)
    chain = [(i, i + 1) for i in range(30)]
    hubs = [(1000 * h, 1000 * h + i) for h in (1, 2) for i in range(1, 200)] + [(5000 + i, 9000) for i in range(100)]
    df = spark.createDataFrame([*chain, *hubs, (2003, 1005)], "a long, b long")
    got = {r["node"]: r["component"] for r in G.components(df).collect()}
    assert len(got) == 31 + 400 + 101
    assert {got[0], got[30]} == {0} and {got[n] for n in got if 1000 <= n < 3000} == {1000} and {got[n] for n in got if n >= 5000} == {5000}


def test_no_task_joins_all_edges_of_a_hub(spark, monkeypatch):
    """The hub's edges are joined where they are, not gathered by its id."""
    monkeypatch.setattr(G, "HUB_EDGES", 50)
    edges = spark.range(1, 2000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    got, low = G.with_least(edges, edges, F.col("m"))
    assert got.count() == 1999 and {r["m"] for r in got.select("m").distinct().collect()} == {1}
    assert low.count() == 1
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000


def test_vectors_without_groups_are_sent_as_blocks(spark, monkeypatch):
    """A query that reaches all cells does not visit them one by one."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((900, 24))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    visits = []
    monkeypatch.setattr(Cells, "visited", lambda *a: visits.append(1))
    got = {(r["id"], r["rank"]): (r["other"], r["distance"]) for r in nearest_others(Cells(rows), 5).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :5]
    assert not visits and len(got) == 4500
    assert all(got[i, k + 1][0] == order[i, k] and abs(got[i, k + 1][1] - d[i, order[i, k]]) < 1e-9 for i in range(900) for k in range(5))


def test_texts_are_cut_into_words_once(spark):
    """What follows the table of words does not read the texts."""
    texts = spark.createDataFrame([("a", "on neural retrieval of citation graphs and more"), ("b", "nothing here")], "paper_id string, text string")
    titles = spark.createDataFrame([("t", "Neural retrieval of citation graphs")], "paper_id string, title string")
    edges = G.title_edges(texts, G.title_index(titles))
    assert "text#" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in edges.collect()] == [("a", "t", 0.9)]
