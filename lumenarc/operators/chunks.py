"""Chunks of papers for embedding, and template summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions.dims import dimension_value
from lumenarc.functions.text import truncate_at_word, words


def make_chunks(papers: DataFrame) -> DataFrame:
    """papers (paper_id, abstract, dimensions map, optionally overview and core texts, other columns): one row a chunk.

    The abstract, each answered dimension and the summaries become chunks; other columns are repeated.
    """
    names = papers.columns
    kinds = [(n, c) for n, c in (("abstract", "abstract"), ("raptor_overview", "overview"), ("raptor_core", "core")) if c in names]
    rest = [c for c in names if c not in ("abstract", "dimensions", "overview", "core")]
    fixed = F.array(*[F.struct(F.lit(k).alias("chunk_type"), F.col(c).alias("text")) for k, c in kinds])
    dims = F.transform(F.map_entries(F.coalesce("dimensions", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("dim_"), e["key"]).alias("chunk_type"), e["value"].alias("text")))
    each = papers.select(*rest, F.explode(F.concat(fixed, dims)).alias("c")).where("c.text is not null and trim(c.text) <> ''")
    return each.select(F.concat_ws("_", "paper_id", "c.chunk_type").alias("chunk_id"), *rest, F.col("c.chunk_type"), truncate_at_word("c.text").alias("text"))


def closed(text: Column) -> Column:
    return F.concat(F.regexp_replace(F.trim(text), r"\.+$", ""), F.lit("."))


def sentences(text: Column, n: int) -> Column:
    return closed(F.array_join(F.slice(F.split(text, r"\. "), 1, n), ". "))


def shortened(text: Column, limit: int, keep: int) -> Column:
    w = words(text)
    return F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, keep), " "), F.lit("..."))).otherwise(text)


def overview(dims: Column | str) -> Column:
    """A few sentences from question or thesis, methods, contribution, implications and field."""
    v = lambda n: F.nullif(dimension_value(dims, n), F.lit(""))
    field = v("field")
    parts = F.concat_ws(" ", closed(F.coalesce(v("research_question"), v("thesis"))), sentences(v("methods"), 2), sentences(v("contribution"), 2), sentences(v("implications"), 1), F.concat(F.lit("Field: "), F.trim(field), F.lit(".")))
    return shortened(parts, 180, 170)


def core_sentence(dims: Column | str) -> Column:
    v = lambda n: F.nullif(dimension_value(dims, n), F.lit(""))
    first = shortened(sentences(F.coalesce(v("contribution"), v("thesis")), 1), 45, 40)
    return F.coalesce(first, F.concat(F.lit("Study in "), F.coalesce(v("field"), F.lit("unspecified field")), F.lit(".")))


def highlight_summary(dims: Column | str, abstract: Column | str) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    abstract = F.col(abstract) if isinstance(abstract, str) else abstract
    return F.substring(F.coalesce(blank(dimension_value(dims, "thesis")), blank(dimension_value(dims, "contribution")), blank(abstract), F.lit("No summary available")), 1, 500)
