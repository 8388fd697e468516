"""Reader-facing entry points: validated arguments in, DataFrames out, errors by code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.dims import ALIASES, DIMENSIONS
from lumenarc.operators import corpus, graph, search

#: Limits of arguments.
MAX_QUERY, MAX_TOP_K, YEARS, QUALITY = 1000, 50, (1800, 2100), (1, 5)


class ToolError(ValueError):
    """code: VALIDATION_ERROR, INDEX_NOT_FOUND or SEARCH_FAILED."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def check_query(query: str) -> str:
    query = (query or "").strip()
    if not 1 <= len(query) <= MAX_QUERY:
        raise ToolError("VALIDATION_ERROR", f"a query has 1 to {MAX_QUERY} characters")
    return query


def check_id(paper_id: str) -> str:
    import re

    if not re.fullmatch(r"[A-Za-z0-9_.:-]{1,200}", paper_id or ""):
        raise ToolError("VALIDATION_ERROR", f"no paper id: {paper_id!r}")
    return paper_id


def clamp(value: float, lo: float, hi: float):
    return max(lo, min(hi, value))


def check_year(year: int | None) -> int | None:
    if year is not None and not YEARS[0] <= year <= YEARS[1]:
        raise ToolError("VALIDATION_ERROR", f"years lie in {YEARS[0]} to {YEARS[1]}")
    return year


def check_chunk_types(types: list[str] | None, available: list[str]) -> list[str] | None:
    """None and all types mean no filter; unknown ones are an error."""
    if not types:
        return None
    if unknown := sorted(set(types) - set(available)):
        raise ToolError("VALIDATION_ERROR", f"unknown chunk types: {', '.join(unknown)}")
    return None if set(types) == set(available) else list(types)


class Library:
    """Papers, chunks and extractions with an embedding function for queries."""

    def __init__(self, spark: SparkSession, papers: DataFrame, chunks: DataFrame, embed: Callable[[str], list[float]], extractions: DataFrame | None = None, texts: DataFrame | None = None):
        self.spark, self.papers, self.chunks, self.embed, self.extractions, self.texts = spark, papers, chunks, embed, extractions, texts

    def search(self, query: str, top_k: int = 10, year_min: int | None = None, year_max: int | None = None, recency_boost: float = 0.0, now: int | None = None, **filters) -> DataFrame:
        k = int(clamp(top_k, 1, MAX_TOP_K))
        hits = search.search_papers(self.chunks, self.embed(check_query(query)), k, year_min=check_year(year_min), year_max=check_year(year_max), **filters)
        own = [c for c in self.papers.columns if c == "paper_id" or c not in hits.columns]
        out = search.enrich(hits, self.papers.select(own), self.extractions)
        if recency_boost and now:
            out = out.withColumn("score", F.col("score") * (1 + search.recency_boost("year", clamp(recency_boost, 0.0, 1.0), now))).orderBy(F.col("score").desc(), "rank")
        return out

    def search_rrf(self, phrasings: list[str], top_k: int = 10) -> DataFrame:
        rows = [(i, self.embed(check_query(q))) for i, q in enumerate(phrasings[:10])]
        queries = self.spark.createDataFrame(rows, "query_id int, query array<double>")
        return search.search_fused(self.chunks, queries, int(clamp(top_k, 1, MAX_TOP_K)))

    def search_agentic(self, query: str, follow_ups: Callable[[DataFrame], list[str]], top_k: int = 10, rounds: int = 2) -> DataFrame:
        find = lambda v, k: search.search_papers(self.chunks, v, k).select("paper_id", "chunk_id", "score")
        return search.search_in_rounds(find, self.embed(check_query(query)), lambda found: [self.embed(q) for q in follow_ups(found)], int(clamp(top_k, 1, MAX_TOP_K)), int(clamp(rounds, 1, 5)))

    def deep_review(self, query: str, follow_ups, synthesize: Callable[[list[dict]], str], top_k: int = 10) -> tuple[DataFrame, str]:
        """The readings and a synthesis of them by the given function; at most MAX_TOP_K readings reach the driver."""
        found = search.enrich(self.search_agentic(query, follow_ups, top_k), self.papers, self.extractions)
        return found, synthesize([r.asDict(recursive=True) for r in found.collect()])

    def search_dimension(self, query: str, dimension: str, top_k: int = 10) -> DataFrame:
        name = ALIASES.get(dimension, dimension)
        order = [d for d, _ in DIMENSIONS]
        if name not in order:
            raise ToolError("VALIDATION_ERROR", f"unknown dimension {dimension!r}")
        return search.search_papers(self.chunks, self.embed(check_query(query)), int(clamp(top_k, 1, MAX_TOP_K)), chunk_types=[f"dim_q{order.index(name) + 1:02d}"])

    def search_group(self, query: str, section: str, top_k: int = 10) -> DataFrame:
        types = [f"dim_q{i:02d}" for i, (_, s) in enumerate(DIMENSIONS, 1) if s == section]
        if not types:
            raise ToolError("VALIDATION_ERROR", f"unknown section {section!r}")
        return search.search_papers(self.chunks, self.embed(check_query(query)), int(clamp(top_k, 1, MAX_TOP_K)), chunk_types=types)

    def get_paper(self, paper_id: str) -> DataFrame:
        one = self.papers.where(F.col("paper_id") == check_id(paper_id))
        return one.join(self.extractions, "paper_id", "left") if self.extractions is not None else one

    def full_text(self, paper_id: str) -> DataFrame:
        if self.texts is None:
            raise ToolError("INDEX_NOT_FOUND", "no full texts")
        return self.texts.where(F.col("paper_id") == check_id(paper_id))

    def similar(self, paper_id: str, pairs: DataFrame, top_k: int = 10) -> DataFrame:
        hit = pairs.where((F.col("src") == check_id(paper_id)) & (F.col("rank") <= int(clamp(top_k, 1, MAX_TOP_K))))
        return hit.join(self.papers.withColumnRenamed("paper_id", "dst"), "dst")

    def clusters(self, pairs: DataFrame, min_score: float = 0.5, min_size: int = 5) -> DataFrame:
        edges = pairs.where(F.col("score") >= min_score).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return graph.density_clusters(edges, self.papers.select(F.col("paper_id").alias("node")), min_size)

    def summary(self) -> DataFrame:
        return corpus.count_by(self.papers, "item_type").withColumn("section", F.lit("type"))

    def collections(self, top: int = 20) -> DataFrame:
        return corpus.count_by(self.papers.select(F.explode("collections").alias("c")), "c", top=top)

    def save_query(self, results: DataFrame, path: str) -> None:
        results.write.mode("overwrite").json(path)
