"""Queries on tables of several files, skewed keys and forms that must grow no faster than their input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.plans import registry


def both(spark, name, path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    shown = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    return shown(registry.queries()[name](spark, str(path)).toPandas()), shown(con.execute(registry.oracle_sql()[name]).df())


def test_the_last_line_of_an_order_is_the_first_in_the_files(spark, tmp_path):
    """Spark reads larger files first; of equal lines that of the first file stays."""
    (tmp_path / "lineitem.parquet").mkdir()
    for name, rows, base in (("a", 10, 1000), ("b", 5000, 2000)):
        duckdb.sql(f"copy (select i % 10 as l_orderkey, 7 as l_linenumber, {base} + i as l_partkey from range({rows}) t(i)) to '{tmp_path}/lineitem.parquet/{name}.parquet' (format parquet)")
    got, want = both(spark, "src_19_keep_last", tmp_path, "lineitem")
    assert got == want and len(got) == 10


def test_lines_without_an_order_share_a_last_line(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    lines = "(values (1, 1, 10), (1, 2, 11), (null, 1, 12), (null, 3, 13), (2, null, 14)) t(l_orderkey, l_linenumber, l_partkey)"
    duckdb.sql(f"copy (select * from {lines}) to '{tmp_path}/lineitem.parquet/a.parquet' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/a.parquet')")
    want = con.execute(registry.oracle_sql()["src_19_keep_last"]).fetchall()
    got = registry.queries()["src_19_keep_last"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want) == 3


def vectors(spark, n=300, copies=40, width=8):
    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((n, width)), 3)
    v[:copies] = v[0]  # ties
    v[n - 1] = 0
    return v, spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def cosines(v):
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(size == 0, 1, size)
    return np.round((u[:, None] * u[None]).sum(2), 12)


def test_blocks_find_the_nearest_of_all_pairs(spark):
    from lumenarc.operators.blocks import Blocks, nearest_in_blocks

    v, df = vectors(spark)
    s, n = cosines(v), len(v)
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    want = {(i * 3, j * 3) for i in range(n) for j in sorted((j for j in range(n) if j != i and s[i, j] > 0), key=lambda j: (-s[i, j], j))[:7]}
    assert {(r["src"], r["dst"]) for r in nearest_in_blocks(Blocks(rows, parts=4), None, 7).collect()} == want
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = {(i * 3, j * 3) for i in range(n) for j in sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:7]}
    assert {(r["src"], r["dst"]) for r in nearest_in_blocks(Blocks(rows, unit=False, parts=4), None, 7).collect()} == want


def test_blocks_give_pairs_and_links_of_a_bound(spark):
    from lumenarc.operators import graph as G
    from lumenarc.operators.blocks import Blocks, links_in_blocks, pairs_in_blocks

    v, df = vectors(spark)
    s, n = cosines(v), len(v)
    blocks = Blocks(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), parts=3)
    want = {(i * 3, j * 3) for i in range(n) for j in range(n) if i < j and s[i, j] >= 0.8}
    assert {(r["src"], r["dst"]) for r in pairs_in_blocks(blocks, 0.8, 9, once=True).collect()} == want
    links = links_in_blocks(blocks, 0.8, 9)
    pairs = spark.createDataFrame(sorted(want), "a long, b long")
    assert sorted(G.components(links).collect()) == sorted(G.components(pairs).collect())
    assert links.count() < len(want) / 2  # before, every pair was shuffled


@pytest.mark.parametrize("replayed", [0, 100_000])
def test_a_graph_made_in_tiers_equals_the_scan(spark, monkeypatch, replayed):
    from lumenarc.operators import graph as G

    monkeypatch.setattr(G, "REPLAY_EDGES", replayed)
    monkeypatch.setattr(G, "TIER_EDGES", 1)
    v, df = vectors(spark, 120, 10)
    s, used, want = np.round(cosines(v), 9), np.zeros(len(v), int), set()
    for _, i, j in sorted((-s[i, j], i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.35):
        if used[i] < 2 and used[j] < 2:
            used[i] += 1
            used[j] += 1
            want.add((i * 3, j * 3))
    assert {(r["source"], r["target"]) for r in G.capped_similarity_graph(df, "vec_id", 2, 0.35).collect()} == want


def test_one_asked_vector_is_not_compared_with_all_pairs(spark):
    from lumenarc.operators import search as S

    v, df = vectors(spark)
    one = S.neighbours(df, "vec_id", 5, asked=df.where("vec_id = 33"))
    every = S.neighbours(df, "vec_id", 5).where("src = 33")
    assert sorted(one.collect()) == sorted(every.collect()) and {r["src"] for r in one.collect()} == {33}


def test_coverage_makes_no_row_for_a_set_and_a_paper(spark):
    """Common tokens: before, each of 300 sets met each of 400 papers in a row of the plan."""
    from lumenarc.operators import corpus as C

    rng = np.random.default_rng(3)
    sets = [sorted({f"w{k}" for k in rng.integers(0, 30, rng.integers(1, 5))}) for _ in range(300)] + [[], ["unknown"]]
    papers = [sorted({f"w{k}" for k in rng.integers(0, 30, 60)}) for _ in range(400)]
    found = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(sets)], "norm string, tokens array<string>")
    index = spark.createDataFrame([(f"p{i}", t) for i, ts in enumerate(papers) for t in ts], "paper_id string, token string")
    done = C.direction_coverage(found, index)
    assert {r["norm"]: r["covered"] for r in done.collect()} == {f"n{i}": sum(bool(s) and {*s} <= {*p} for p in papers) for i, s in enumerate(sets)}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "rest" not in plan


def test_coverage_sends_sets_to_as_many_groups_as_run_at_once(spark, monkeypatch):
    """Papers as lists, one of them in two rows, in 24 groups; before, each set was sent to all of them in one shuffle."""
    from lumenarc.operators import corpus as C
    from lumenarc.sources import store

    rng = np.random.default_rng(4)
    sets = [sorted({f"w{k}" for k in rng.integers(0, 30, rng.integers(1, 5))}) for _ in range(300)]
    papers = [sorted({f"w{k}" for k in rng.integers(0, 30, 60)}) for _ in range(400)]
    found = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(sets)], "norm string, tokens array<string>")
    lists = [(f"p{i}", t) for i, t in enumerate(papers)] + [("p0", ["w0", "w29"]), ("none", [])]
    papers[0] = {*papers[0], "w0", "w29"}
    monkeypatch.setattr(C, "INDEX_ROWS", 440)
    passes, staged = [], store.staged
    monkeypatch.setattr(store, "staged", lambda spark, df, name: passes.append(name) or staged(spark, df, name))
    done = C.direction_coverage(found, spark.createDataFrame(lists, "paper_id string, tokens array<string>"))
    assert {r["norm"]: r["covered"] for r in done.collect()} == {f"n{i}": sum({*s} <= {*p} for p in papers) for i, s in enumerate(sets)}
    assert passes.count("covered") >= 3  # on four cores, and the last one in the result


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_titles_meet_in_blocks(spark, monkeypatch, threshold):
    """Few letters, so that all titles share their rarest characters; the plan holds no row for a character."""
    from lumenarc.operators import dedup as E

    monkeypatch.setattr(E, "TITLE_ROWS", 40)
    rng = np.random.default_rng(8)
    titles = ["".join(rng.choice(list("abé "), rng.integers(1, 30))) + "\t" * int(rng.integers(0, 2)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    done = E.similar_titles(df, threshold)
    plain = sorted({t.strip(" ").lower() for t in titles} - {""})
    want = {(a, b): r for a in plain for b in plain if a != b and (r := E.sequence_ratio(a, b)) >= threshold}
    assert {(r["a"], r["b"]): r["ratio"] for r in done.collect()} == pytest.approx(want) and want
    assert "Generate explode(split" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_one_key_are_dealt_to_tasks(spark):
    """A key's sections stood in one task with all its books."""
    from lumenarc.operators import graph as G

    rows = [(i, f"p{i}", f"t{i}", None, "book" if i % 8 == 0 else "bookSection", "K") for i in range(80)]
    df = spark.createDataFrame(rows, "pos int, paper_id string, title string, author_string string, item_type string, library_key string").coalesce(1)
    got = G.part_of(df).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["child"], r["parent"]) for r in got} == {(f"p{i}", f"p{j}") for i in range(80) if i % 8 for j in range(0, 80, 8)} and len(got) == 700
    assert len({r["task"] for r in got}) > 4


def test_copies_of_a_title_are_one_candidate(spark):
    """Each of 500 copies of a title met each different title that was asked."""
    from lumenarc.operators import graph as G

    papers = spark.createDataFrame([(i, f"p{i}", "graph neural citation forecasting" if i % 2 else "deep vector index search", None) for i in range(1000, 0, -1)], "pos int, paper_id string, title string, doi string")
    refs = spark.createDataFrame([("a", 0, "Graph neural citation forecasting", None), ("b", 1, "deep vector index search", None), ("p1", 2, "graph neural citation forecasting", None)], "paper_id string, ref_pos int, title string, doi string")
    done = G.reference_edges(refs, papers)
    assert {(r["source"], r["target"]) for r in done.collect()} == {("a", "p1"), ("b", "p2")}
    assert "min(hit" in done._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]
