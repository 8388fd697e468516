"""Stand-ins for the engine's tables on the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers from documents: the first line is the title, the source the collection; some years and DOIs are missing."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("p"), "doc_id").alias("paper_id"),
        "text",
        F.trim(F.split("text", "\n")[0]).alias("title"),
        F.col("lang").alias("item_type"),
        F.col("source").alias("collection"),
        F.array("source", F.concat(F.lit("lang/"), "lang")).alias("collections"),
        F.when(F.col("doc_id") % 17 != 0, F.lit(1990) + F.col("doc_id") % 35).cast("int").alias("year"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("https://doi.org/10.1000/X"), F.col("doc_id") % 300)).alias("doi"),
    )


PAPERS = """papers AS (SELECT doc_id AS pos, 'p' || doc_id AS paper_id, text, trim(string_split(text, chr(10))[1]) AS title,
 lang AS item_type, source AS collection, [source, 'lang/' || lang] AS collections,
 CASE WHEN doc_id % 17 <> 0 THEN CAST(1990 + doc_id % 35 AS INTEGER) END AS year,
 CASE WHEN doc_id % 4 <> 0 THEN 'https://doi.org/10.1000/X' || (doc_id % 300) END AS doi FROM documents)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension answers from conversations: a turn answers a dimension; every seventh is empty."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("p"), "conv_id").alias("paper_id"),
        F.concat(F.lit("q"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0")).alias("dimension"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.col("text")).alias("value"),
        F.col("role").alias("provider"),
        "turn",
        "conv_id",
    )


ANSWERS = """answers AS (SELECT 'p' || conv_id AS paper_id, 'q' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') AS dimension,
 CASE WHEN (conv_id + turn) % 7 <> 0 THEN text END AS value, role AS provider, turn, conv_id FROM conversations)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks from embeddings: ten papers' worth of vectors, typed by number."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("p"), F.col("vec_id") % 97).alias("paper_id"),
        F.concat(F.lit("dim_q"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("chunk_type"),
        F.when(F.col("vec_id") % 13 != 0, F.lit(1990) + F.col("vec_id") % 30).cast("int").alias("year"),
        F.concat(F.lit("src"), F.col("vec_id") % 20).alias("collection"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


CHUNKS = """chunks AS (SELECT vec_id AS chunk_id, 'p' || (vec_id % 97) AS paper_id, 'dim_q' || lpad(CAST(label AS VARCHAR), 2, '0') AS chunk_type,
 CASE WHEN vec_id % 13 <> 0 THEN CAST(1990 + vec_id % 30 AS INTEGER) END AS year, 'src' || (vec_id % 20) AS collection,
 CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""

WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def sql_words(expr: str) -> str:
    return WORDS.format(expr)


def sql_topic_tokens(expr: str) -> str:
    from lumenarc.functions.text import TOPIC_STOPWORDS

    stop = ", ".join(f"'{w}'" for w in TOPIC_STOPWORDS)
    return f"list_filter(list_transform(regexp_extract_all({expr}, '[A-Za-z0-9]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN ({stop}))"


def sql_normal_title(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({expr})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def sql_title_tokens(expr: str) -> str:
    from lumenarc.functions.text import TITLE_STOPWORDS

    stop = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)
    return f"list_distinct(list_filter(string_split({sql_normal_title(expr)}, ' '), lambda w: length(w) > 2 AND w NOT IN ({stop})))"
