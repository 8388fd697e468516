"""Papers from the names of files in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.text import col

#: Name patterns in order of precedence, and the groups of authors, year and title.
NAME_PATTERNS = [
    (r"(?i)^([^-]+)\s*-\s*(\d{4})\s*-\s*(.+)\.pdf$", (1, 2, 3)),
    (r"(?i)^([^_]+)_(\d{4})_(.+)\.pdf$", (1, 2, 3)),
    (r"(?i)^(\d{4})_([^_]+)_(.+)\.pdf$", (2, 1, 3)),
    (r"(?i)^(\d{4})\s*-\s*([^-]+)\s*-\s*(.+)\.pdf$", (2, 1, 3)),
    (r"(?i)^(.+)\.pdf$", (None, None, 1)),
]


def parse_filename(name: Column | str) -> Column:
    """authors, year, title by the first pattern that fits; all null if none does."""
    n = col(name)
    group = lambda p, g: F.trim(F.regexp_extract(n, p, g)) if g else F.lit(None).cast("string")
    out = None
    for pattern, (a, y, t) in NAME_PATTERNS:
        made = F.struct(group(pattern, a).alias("authors"), group(pattern, y).alias("year"), group(pattern, t).alias("title"))
        out = F.when(n.rlike(pattern), made) if out is None else out.when(n.rlike(pattern), made)
    return out


def split_authors(authors: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(authors), r"(?i)\s*(?:;|&|,|\band\b)\s*"), lambda x: F.trim(x)), lambda a: a != "")


def read_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """paper_id, pdf_path, authors, year, title of every PDF; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{pdf,PDF}").load(path).select("path")
    name = F.regexp_extract(F.url_decode("path"), r"([^/]+)$", 1)
    parsed = files.withColumn("f", parse_filename(name))
    return parsed.select(F.concat(F.lit("pdf_"), F.substring(F.sha2("path", 256), 1, 16)).alias("paper_id"), F.col("path").alias("pdf_path"), split_authors("f.authors").alias("authors"), F.col("f.year").cast("int").alias("year"), "f.title")
