"""Vector search, ranking and merging (TOPK, WIN) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenarc.operators import search as S
from lumenarc.operators import views as V
from lumenarc.plans.inputs import CHUNKS, PAPERS, chunks, papers, table

Q0 = "SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0"
DIST = "list_sum(list_transform(list_zip(c.embedding, q.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
NEAR = f"near AS (SELECT c.*, {DIST} AS distance FROM chunks c, ({Q0}) q)"


def query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def topk_01(spark, sf_dir):
    near = S.nearest(S.chunk_filter(chunks(spark, sf_dir), year_min=1995, year_max=2015), query_vector(spark, sf_dir), 20)
    return near.select("chunk_id", "paper_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def topk_01_post(spark, sf_dir):
    near = S.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), 20, ["src1", "src2", "src3", "src0"])
    return near.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def indexed(spark, rows, key):
    import uuid

    from lumenarc.operators.vector_index import VectorIndex
    from lumenarc.sources.store import shared_folder

    return VectorIndex.build(rows, f"{shared_folder(spark)}/lumenarc/index-{uuid.uuid4().hex}", key, "embedding")


def topk_01_index(spark, sf_dir):
    """The same search as topk_01, through an index of all chunks."""
    index = indexed(spark, chunks(spark, sf_dir), "chunk_id")
    near = index.search_exact(query_vector(spark, sf_dir), 20, where=F.col("year").between(1995, 2015))
    return near.select("chunk_id", "paper_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def topk_01_batch(spark, sf_dir):
    """Every fiftieth vector asks for its ten nearest in an index of all."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = indexed(spark, vectors, "vec_id").search_batch(asked, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def topk_03(spark, sf_dir):
    hits = S.search_papers(chunks(spark, sf_dir).drop("year", "collection"), query_vector(spark, sf_dir), 10)
    found = S.enrich(hits, papers(spark, sf_dir).select("paper_id", "title", "item_type", "year"))
    return found.select(F.col("rank").cast("long").alias("rank"), "paper_id", "chunk_id", F.round("score", 4).alias("score"), "title", "item_type", "year")


def topk_05(spark, sf_dir):
    hits = S.search_papers(chunks(spark, sf_dir), query_vector(spark, sf_dir), 5, chunk_types=["dim_q03", "dim_q04"])
    return hits.select(F.col("rank").cast("long").alias("rank"), "paper_id", "chunk_type", F.round("score", 4).alias("score"))


def topk_06(spark, sf_dir):
    out = S.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", 20)
    return out.select("src", "dst", "score", F.col("rank").cast("long").alias("rank"))


def topk_07_top(spark, sf_dir):
    return V.sort_results(papers(spark, sf_dir), "year", 50).select("paper_id", "year")


def topk_08(spark, sf_dir):
    hits = S.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), 50)
    boosted = hits.withColumn("boosted", F.col("score") * (1 + S.recency_boost("year", 0.3, 2020)))
    place = F.row_number().over(Window.orderBy(F.round("boosted", 9).desc(), "rank"))
    return boosted.select("chunk_id", F.round("boosted", 6).alias("boosted"), place.cast("long").alias("place"))


def topk_10(spark, sf_dir):
    li = table(spark, sf_dir, "part")
    lists = None
    for i, c in enumerate(("p_retailprice", "p_size", "p_name")):
        one = li.orderBy(F.col(c).desc(), "p_partkey").limit(100).select(F.lit(i).alias("variant"), F.col("p_partkey").alias("paper_id"), c)
        one = one.withColumn("rank", F.row_number().over(Window.orderBy(F.col(c).desc(), "paper_id"))).drop(c)
        lists = one if lists is None else lists.unionByName(one)
    out = S.fuse_rankings(lists)
    return out.select(F.col("paper_id").alias("p_partkey"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def topk_11(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    out = S.search_fused(chunks(spark, sf_dir).select("chunk_id", "paper_id", "embedding"), queries, 10)
    return out.select("paper_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "chunk_id")


def topk_12(spark, sf_dir):
    held = chunks(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    asked = iter([[[float(x) for x in r["embedding"]] for r in vectors.where("vec_id in (1, 2)").orderBy("vec_id").collect()], []])
    search = lambda q, k: S.search_papers(held, q, k).select("paper_id", "chunk_id", "score")
    out = S.search_in_rounds(search, query_vector(spark, sf_dir), lambda found: next(asked), 10, rounds=2)
    return out.select("paper_id", "chunk_id", F.round("score", 6).alias("score"), "round")


def merged(how):
    def run(spark, sf_dir):
        p = table(spark, sf_dir, "part")
        mine = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("paper_id"), (F.col("p_retailprice") / 10000).alias("score"), F.lit(1.0).alias("weight"), F.lit("primary").alias("source"))
        theirs = p.where("p_partkey % 3 = 1").select(F.concat(F.lit("p"), "p_partkey").alias("paper_id"), (F.col("p_size") / 50).alias("score"), F.lit(0.8).alias("weight"), F.lit("other").alias("source"))
        mine, theirs = mine.orderBy(F.col("score").desc(), "paper_id").limit(50), theirs.orderBy(F.col("score").desc(), "paper_id").limit(50)
        out = S.merge_results(mine, theirs, 30, how)
        return out.select(F.col("rank").cast("long").alias("rank"), "paper_id", "source", F.round("merged", 6).alias("merged"))

    return run


MERGE = """mine AS (SELECT 'p' || p_partkey AS paper_id, p_retailprice / 10000 AS score, CAST(1.0 AS DOUBLE) AS weight, 'primary' AS source, 0 AS second FROM part WHERE p_partkey % 3 = 0 ORDER BY score DESC, paper_id LIMIT 50),
theirs AS (SELECT 'p' || p_partkey AS paper_id, p_size / 50 AS score, CAST(0.8 AS DOUBLE) AS weight, 'other' AS source, 1 AS second FROM part WHERE p_partkey % 3 = 1 ORDER BY score DESC, paper_id LIMIT 50),
both_ AS (SELECT * FROM mine UNION ALL SELECT * FROM theirs)"""


def topk_13(spark, sf_dir):
    return V.richest_papers(papers(spark, sf_dir), 25)


def topk_15(spark, sf_dir):
    return V.newest(papers(spark, sf_dir).where(F.col("pos") % 2 == 0), "year", "paper_id", 10).select("paper_id", "year")


def topk_17(spark, sf_dir):
    return V.plan_groups(papers(spark, sf_dir), "collection", "pos", "paper_id")


def win_01(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    ranked = V.rank_within(li, "l_orderkey", [F.col("l_extendedprice").desc(), "l_linenumber"])
    return S.first_per_key(ranked, "l_orderkey").drop("rank")


def win_02(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return V.rank_within(o, "o_orderpriority", [F.col("o_totalprice").desc(), "o_orderkey"], 25).select("o_orderpriority", "o_orderkey", "rank")


def win_05(spark, sf_dir):
    o = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("style"))
    return o.select("event_id", F.round(V.rarity("event_type", "style"), 9).alias("diversity"))


def win_07(spark, sf_dir):
    return V.context_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", 1, 2).select("conv_id", "turn", "context_chars", "rows_seen")


def win_08(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return V.rank_within(e, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 5, "back").select("user_id", "event_id", "back")


QUERIES = {
    "topk_01_vector_search": (topk_01, f"WITH {CHUNKS}, {NEAR} SELECT chunk_id, paper_id, round(1 / (1 + distance), 6) AS score, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near WHERE year BETWEEN 1995 AND 2015 ORDER BY distance, chunk_id LIMIT 20"),
    "topk_01_index_exact": (topk_01_index, f"WITH {CHUNKS}, {NEAR} SELECT chunk_id, paper_id, round(1 / (1 + distance), 6) AS score, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near WHERE year BETWEEN 1995 AND 2015 ORDER BY distance, chunk_id LIMIT 20"),
    "topk_01_index_batch": (topk_01_batch, None),
    "topk_01_flt_03_collections_after_topk": (topk_01_post, f"WITH {CHUNKS}, {NEAR}, top AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near ORDER BY distance, chunk_id LIMIT 20) SELECT chunk_id, round(1 / (1 + distance), 6) AS score, rank FROM top WHERE collection IN ('src0', 'src1', 'src2', 'src3')"),
    "topk_03_search_enriched": (topk_03, f"WITH {CHUNKS}, {PAPERS}, {NEAR}, top AS (SELECT * FROM near ORDER BY distance, chunk_id LIMIT 30), best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY distance, chunk_id) = 1 ORDER BY distance, chunk_id LIMIT 10) SELECT row_number() OVER (ORDER BY distance, chunk_id) AS rank, best.paper_id, chunk_id, round(1 / (1 + distance), 4) AS score, p.title, p.item_type, p.year FROM best LEFT JOIN papers p USING (paper_id)"),
    "topk_05_search_dimension_group": (topk_05, f"WITH {CHUNKS}, {NEAR}, top AS (SELECT * FROM near WHERE chunk_type IN ('dim_q03', 'dim_q04') ORDER BY distance, chunk_id LIMIT 15), best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY distance, chunk_id) = 1 ORDER BY distance, chunk_id LIMIT 5) SELECT row_number() OVER (ORDER BY distance, chunk_id) AS rank, paper_id, chunk_type, round(1 / (1 + distance), 4) AS score FROM best"),
    "topk_06_similarity_pairs": (topk_06, "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 12) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s WHERE score > 0) SELECT src, dst, round(score, 4) AS score, rank FROM r WHERE rank <= 20"),
    "topk_07_sort_results": (topk_07_top, f"WITH {PAPERS} SELECT paper_id, year FROM papers ORDER BY year DESC NULLS LAST, lower(title), pos LIMIT 50"),
    "topk_08_recency_boost": (topk_08, f"WITH {CHUNKS}, {NEAR}, top AS (SELECT *, 1 / (1 + distance) AS score, row_number() OVER (ORDER BY distance, chunk_id) AS rank, 2020 - year AS age FROM near ORDER BY distance, chunk_id LIMIT 50), b AS (SELECT *, score * (1 + CASE WHEN year IS NULL THEN 0 WHEN age <= 0 THEN 0.3 WHEN age <= 5 THEN 0.3 * (1 - age / 10) WHEN age <= 10 THEN 0.3 * (0.5 - (age - 5) / 20) ELSE 0 END) AS boosted FROM top) SELECT chunk_id, round(boosted, 6) AS boosted, row_number() OVER (ORDER BY round(boosted, 9) DESC, rank) AS place FROM b"),
    "topk_10_rrf_score": (topk_10, "WITH l AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS variant, p_partkey, row_number() OVER (ORDER BY {c} DESC, p_partkey) AS rank FROM part) WHERE rank <= 100" for i, c in enumerate(("p_retailprice", "p_size", "p_name"))) + "), f AS (SELECT p_partkey, sum(1 / (60 + rank)) AS s FROM l GROUP BY 1) SELECT p_partkey, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, p_partkey) AS rank FROM f"),
    "topk_11_search_rrf": (topk_11, f"WITH {CHUNKS}, qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 4), n AS (SELECT query_id, chunk_id, paper_id, {DIST} AS d FROM chunks c, qs q), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) <= 30), o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY d, chunk_id) = 1), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM o), f AS (SELECT paper_id, sum(1 / (60 + rank)) AS s, arg_min(chunk_id, query_id * 1000 + rank) AS chunk_id FROM l GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, paper_id) AS rank FROM f) SELECT paper_id, round(s, 6) AS score, rank, chunk_id FROM r WHERE rank <= 10"),
    "topk_12_search_rounds": (topk_12, None),
    "topk_13_sample_suggestions": (topk_13, f"WITH {PAPERS} SELECT paper_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(length(text) AS INTEGER) AS chars, coalesce(year, 0) AS y FROM papers WHERE text IS NOT NULL ORDER BY lines DESC, chars DESC, y DESC, paper_id DESC LIMIT 25"),
    "topk_15_digest_selection": (topk_15, f"WITH {PAPERS} SELECT paper_id, year FROM papers WHERE pos % 2 = 0 ORDER BY coalesce(year, 0) DESC, paper_id LIMIT 10"),
    "topk_16_merge_interleave": (merged("interleave"), f"WITH {MERGE} SELECT row_number() OVER (ORDER BY score * weight DESC, source, paper_id) AS rank, paper_id, source, round(score * weight, 6) AS merged FROM both_ ORDER BY score * weight DESC, source, paper_id LIMIT 30"),
    "topk_16_merge_concat": (merged("concat"), f"WITH {MERGE} SELECT row_number() OVER (ORDER BY second, score * weight DESC, source, paper_id) AS rank, paper_id, source, round(score * weight, 6) AS merged FROM both_ ORDER BY second, score * weight DESC, source, paper_id LIMIT 30"),
    "topk_16_merge_rerank": (merged("rerank"), f"WITH {MERGE}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM both_), m AS (SELECT *, (score - lo) / (hi - lo) * weight AS x FROM both_, e) SELECT row_number() OVER (ORDER BY x DESC, source, paper_id) AS rank, paper_id, source, round(x, 6) AS merged FROM m ORDER BY x DESC, source, paper_id LIMIT 30"),
    "topk_17_plan_groups": (topk_17, f"WITH {PAPERS}, r AS (SELECT collection, paper_id, row_number() OVER (PARTITION BY collection ORDER BY pos) AS n, count(*) OVER (PARTITION BY collection) AS size FROM papers) SELECT collection, paper_id, n, size, greatest(size - 5, 0) AS more FROM r WHERE n <= 5"),
    "win_01_first_per_key": (win_01, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1"),
    "win_02_rank_per_list": (win_02, "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 25"),
    "win_05_rarity": (win_05, "SELECT event_id, round((1 / count(*) OVER (PARTITION BY event_type) + 1 / count(*) OVER (PARTITION BY user_id % 7)) / 2, 9) AS diversity FROM events"),
    "win_07_context_window": (win_07, "SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS context_chars, count(*) OVER w AS rows_seen FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)"),
    "win_08_bounded_history": (win_08, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 5"),
}
