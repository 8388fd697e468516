"""Vector search, ranking and merging of ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import col
from lumenarc.operators.blocks import Blocks, nearest_in_blocks, pairs_in_blocks


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def vector(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])


def chunk_filter(chunks: DataFrame, chunk_types=None, year_min=None, year_max=None, item_types=None, quality_min=None) -> DataFrame:
    """Conjunctive filter on scalar columns; rows without a year fail its bounds. All of it reaches the scan."""
    for condition in (
        F.col("chunk_type").isin(list(chunk_types)) if chunk_types else None,
        F.col("year") >= year_min if year_min is not None else None,
        F.col("year") <= year_max if year_max is not None else None,
        F.col("item_type").isin(list(item_types)) if item_types else None,
        F.col("quality_rating") >= quality_min if quality_min is not None else None,
    ):
        if condition is not None:
            chunks = chunks.where(condition)
    return chunks


def nearest(chunks: DataFrame, query: list[float], k: int, collections: list[str] | None = None) -> DataFrame:
    """The k nearest chunks: rank, score 1 / (1 + squared distance). Collections filter what was found, so fewer than k may come."""
    scored = chunks.withColumn("distance", squared_distance("embedding", vector(query))).drop("embedding")
    top = scored.orderBy("distance", "chunk_id").limit(k)
    ranked = top.withColumn("score", 1 / (1 + F.col("distance"))).withColumn("rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))
    return ranked.where(F.col("collection").isin(collections)) if collections else ranked


def nearest_batch(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries (query_id, query): the k nearest chunks of each, in one plan; queries are a bounded set and are carried to the chunks."""
    scored = chunks.join(F.broadcast(queries)).withColumn("distance", squared_distance("embedding", "query")).drop("embedding", "query")
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", 1 / (1 + F.col("distance")))


def first_per_key(ranked: DataFrame, key: str, order: str = "rank", within: list[str] | None = None) -> DataFrame:
    """The first row of each key in rank order."""
    w = Window.partitionBy(*(within or []), key).orderBy(order)
    return ranked.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def search_papers(chunks: DataFrame, query: list[float], k: int, overfetch: int = 3, **filters) -> DataFrame:
    """The best chunk of each of at most k papers among the overfetch x k nearest chunks."""
    collections = filters.pop("collections", None)
    hits = nearest(chunk_filter(chunks, **filters), query, overfetch * k, collections)
    best = first_per_key(hits, "paper_id").orderBy("rank").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def enrich(hits: DataFrame, papers: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """hits with their paper's columns; hits of unknown papers stay."""
    out = hits.join(papers, "paper_id", "left")
    return out.join(extractions, "paper_id", "left") if extractions is not None else out


def fuse_rankings(rankings: DataFrame, k: int = 60, key: str = "paper_id", limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (variant, rank, key): score, rank; ties by key. With a limit only the best are ranked."""
    fused = rankings.groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))
    if limit is not None:
        fused = fused.orderBy(F.col("score").desc(), key).limit(limit)
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def search_fused(chunks: DataFrame, queries: DataFrame, k: int, rrf_k: int = 60, overfetch: int = 3) -> DataFrame:
    """Each query's nearest chunks, one per paper, fused; the k best papers with the chunk first seen (lowest query, then rank)."""
    hits = first_per_key(nearest_batch(chunks, queries, overfetch * k), "paper_id", within=["query_id"])
    lists = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    fused = fuse_rankings(lists, rrf_k, limit=k)
    seen = lists.groupBy("paper_id").agg(F.min_by("chunk_id", F.struct("query_id", "rank")).alias("chunk_id"))
    return fused.join(seen, "paper_id")


def search_in_rounds(search: Callable[[list[float], int], DataFrame], first: list[float], follow_ups: Callable[[DataFrame], list[list[float]]], k: int, rounds: int = 2) -> DataFrame:
    """Round after round: new papers join with the hit that found them first; ends without follow-ups or news. At most three follow-ups a round."""
    found = search(first, max(k, 10)).withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        asked = follow_ups(found)[:3]
        if not asked:
            break
        news = None
        for q in asked:
            fresh = search(q, max(k, 10)).join(found.select("paper_id"), "paper_id", "left_anti").withColumn("round", F.lit(r))
            if news is not None:
                fresh = fresh.join(news.select("paper_id"), "paper_id", "left_anti")
            news = fresh if news is None else news.unionByName(fresh)
        if news.isEmpty():
            break
        found = found.unionByName(news)
    return found.orderBy(F.col("score").desc(), "paper_id").limit(k)


def recency_boost(year: Column | str, boost: float, now: int) -> Column:
    """The share by which a score grows: falls over ten years, none for unknown years."""
    age = F.lit(now) - col(year)
    return (
        F.when(col(year).isNull(), 0.0)
        .when(age <= 0, boost)
        .when(age <= 5, boost * (1 - age / 10))
        .when(age <= 10, boost * (0.5 - (age - 5) / 20))
        .otherwise(0.0)
    )


def merge_results(primary: DataFrame, others: DataFrame, k: int, how: str = "interleave") -> DataFrame:
    """Both: paper_id, score, weight, source. interleave: by weighted score; concat: primary first; rerank: by min-max score of all, weighted."""
    both = primary.withColumn("__second", F.lit(0)).unionByName(others.withColumn("__second", F.lit(1)))
    weighted = F.col("score") * F.col("weight")
    if how == "rerank":
        ends = both.agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
        both = both.join(F.broadcast(ends))  # one row
        flat = F.col("__hi") == F.col("__lo")
        both = both.withColumn("merged", F.when(flat, 1.0).otherwise((F.col("score") - F.col("__lo")) / F.when(flat, 1.0).otherwise(F.col("__hi") - F.col("__lo"))) * F.col("weight")).drop("__lo", "__hi")
    else:
        both = both.withColumn("merged", weighted)
    keys = (["__second"] if how == "concat" else []) + [F.col("merged").desc(), "source", "paper_id"]
    top = both.orderBy(*keys).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).drop("__second")


def neighbours(vectors: DataFrame, key: str, n: int | None = 20, parts: int | None = None, digits: int = 4, least: float = 0.0, asked: DataFrame | None = None, once: bool = False) -> DataFrame:
    """src, dst, score, rank: the n most similar others of each vector, only positive scores; ties by key. With `asked` (rows of the same columns)
    only of these, in one pass over the vectors. With n None all others whose rounded score is at least `least`, without rank; `once` gives each pair
    in one order, src < dst.

    Blocks of rows meet in pairs as matrices, each side's n best per block go on, and the per-source choice ends in a window that takes n rows
    from each block. Exact, and so quadratic in the rows unless few are asked; the result is meant to be kept as a table.
    """
    rows = lambda df: df.select(F.col(key).alias("id"), F.col("embedding").alias("v"))
    blocks = Blocks(rows(vectors), parts=parts)
    if n is None:
        return pairs_in_blocks(blocks, least, digits, once)
    found = nearest_in_blocks(blocks, Blocks(rows(asked)) if asked is not None else None, n)
    return found.withColumn("score", F.round("score", digits)).select("src", "dst", "score", "rank")
