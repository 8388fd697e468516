import random
from collections import Counter

from pyspark.sql import functions as F

from lumenarc.llm import sharding as S


def test_matrix_sums_hold():
    counts = [7, 0, 30, 13, 50]
    sizes = S.shard_sizes(100, 7)
    m = S.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in m] == counts
    assert [sum(c) for c in zip(*m, strict=True)] == sizes


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(2)
    seen = Counter(S.hypergeometric(rng, 5, 4, 10) for _ in range(20000))
    from math import comb

    for k in range(5):
        want = comb(4, k) * comb(6, 5 - k) / comb(10, 5)
        assert abs(seen[k] / 20000 - want) < 0.015


def test_large_draws_stay_in_bounds():
    rng = random.Random(3)
    got = [S.hypergeometric(rng, 10**9, 10**10, 10**11) for _ in range(20)]
    assert all(abs(g - 10**8) < 10**6 for g in got)


def test_shards_of_documents(documents):
    rows = S.shard_documents(documents).collect()
    sizes = Counter(r["shard"] for r in rows)
    n = documents.count()
    assert len(rows) == n
    assert len(sizes) == 24
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert {r["law"] for r in rows} == {"rows"}
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in S.shard_documents(documents.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_many_partitions_and_cells_agree_with_the_law(spark):
    df = spark.range(5000).withColumn("shard", F.lit("mine"))
    out = S.shuffle_into_shards(df, 5, ["id"], cell_rows=100)
    sizes = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    assert all((r["n"], r["lo"], r["hi"], r["d"]) == (1000, 0, 999, 1000) for r in sizes)
    means = [r["m"] for r in out.groupBy("shard").agg(F.avg("id").alias("m")).collect()]
    assert all(abs(m - 2500) < 200 for m in means)


def test_main_path_is_native(documents):
    plan = S.shard_documents(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_odd_rows(odd, empty):
    rows = S.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 3, 3]
    assert S.shard_documents(empty).count() == 0
