"""Bibliography files: BibTeX and its dialect, EndNote XML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.ids import int_id
from lumenarc.functions.text import col

#: How entries and fields are written, and which entries hold no record.
ENTRY = r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.+?)\n\s*\}"
FIELD = r"(\w+)\s*=\s*(?:\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}|\"([^\"]*)\"|(\d+))"
NO_RECORD = ("comment", "string", "preamble")
ENTRY_TYPES = {"article": "journalArticle", "book": "book", "inbook": "bookSection", "incollection": "bookSection", "inproceedings": "conferencePaper", "conference": "conferencePaper", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report"}
LATEX_SIGNS = ("&", "%", "$", "_", "#", "~", "^")


def clean_latex(text: Column | str) -> Column:
    """Commands give their argument, escaped signs stand for themselves, blanks collapse."""
    t = F.regexp_replace(col(text), r"\\\w+\{([^}]*)\}", "$1")
    t = reduce(lambda x, c: F.replace(x, F.lit("\\" + c), F.lit(c)), LATEX_SIGNS, t)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\\([a-zA-Z])", "$1"), r"\s+", " "))


def parse_authors(names: Column | str) -> Column:
    """Array of (first_name, last_name, order, role) from "Last, First and First Last"."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(names), F.lit("")), r"(?i)\s+and\s+"), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column, i: Column) -> Column:
        comma = F.contains(p, F.lit(","))
        w = F.split(p, r"\s+")
        last = F.when(comma, F.trim(F.regexp_extract(p, "^([^,]*)", 1))).otherwise(F.element_at(w, -1))
        first = F.when(comma, F.trim(F.regexp_extract(p, "(?s)^[^,]*,(.*)$", 1))).otherwise(F.array_join(F.slice(w, 1, F.size(w) - 1), " "))
        return F.struct(first.alias("first_name"), last.alias("last_name"), (i + 1).alias("order"), F.lit("author").alias("role"))

    return F.transform(parts, one)


def split_keywords(*texts: Column) -> Column:
    each = F.split(F.concat_ws(",", *texts), "[,;]")
    return F.array_distinct(F.filter(F.transform(each, lambda k: F.trim(k)), lambda k: k != ""))


def parse_bibtex(files: DataFrame, text: str = "value", dialect: str = "bibtex") -> DataFrame:
    """A paper a row from whole files. dialect "paperpile": labels from two fields, folders from three."""
    entries = files.select(F.explode(F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(ENTRY), F.lit(0))).alias("e"))
    e = entries.select(F.lower(F.regexp_extract("e", ENTRY, 1)).alias("type"), F.trim(F.regexp_extract("e", ENTRY, 2)).alias("key"), F.regexp_extract("e", ENTRY, 3).alias("body")).where(~F.col("type").isin(*NO_RECORD))
    raw = F.regexp_extract_all("body", F.lit(FIELD), F.lit(0))
    value = lambda f: F.concat(*[F.regexp_extract(f, FIELD, g) for g in (2, 3, 4)])
    pairs = F.transform(raw, lambda f: F.struct(F.lower(F.regexp_extract(f, FIELD, 1)).alias("key"), clean_latex(F.trim(value(f))).alias("value")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    rows = e.withColumn("f", last)
    get = lambda n: F.nullif(F.try_element_at("f", F.lit(n)), F.lit(""))
    kinds = F.create_map(*[F.lit(x) for p in ENTRY_TYPES.items() for x in p])
    tags = split_keywords(get("keywords"), get("mendeley-tags")) if dialect == "paperpile" else split_keywords(get("keywords"))
    folders = F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(",", get("groups"), get("folder"), get("folders")), "[,;/]"), lambda k: F.trim(k)), lambda k: k != "")) if dialect == "paperpile" else F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("bibtex_"), "key").alias("paper_id"),
        int_id("key").alias("item_id"),
        F.coalesce(get("title"), F.lit("Untitled")).alias("title"),
        parse_authors(get("author")).alias("authors"),
        F.nullif(F.regexp_extract(F.coalesce(get("year"), get("date"), F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int").alias("publication_year"),
        F.coalesce(get("journal"), get("booktitle")).alias("journal"),
        get("doi").alias("doi"),
        get("abstract").alias("abstract"),
        tags.alias("tags"),
        folders.alias("collections"),
        F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("document")).alias("item_type"),
    )


def read_bibtex(spark: SparkSession, path: str, dialect: str = "bibtex") -> DataFrame:
    return parse_bibtex(spark.read.text(path, wholetext=True), dialect=dialect)


ENDNOTE = "`rec-number` string, `ref-type` struct<_name: string>, titles struct<title: string, `secondary-title`: string>, contributors struct<authors: struct<author: array<string>>, `secondary-authors`: struct<author: array<string>>>, dates struct<year: string, `pub-dates`: struct<date: string>>, keywords struct<keyword: array<string>>, `electronic-resource-num` string, abstract string"


def endnote_papers(records: DataFrame) -> DataFrame:
    """Papers from parsed EndNote records."""
    year = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4})", 1), F.lit(""))
    people = lambda path, role: F.transform(F.coalesce(F.col(path), F.array().cast("array<string>")), lambda a: F.struct(F.trim(F.regexp_extract(a, "^[^,]*,(.*)$", 1)).alias("first_name"), F.trim(F.regexp_extract(a, "^([^,]*)", 1)).alias("last_name"), F.lit(role).alias("role")))
    return records.select(
        F.concat(F.lit("endnote_"), F.trim("`rec-number`")).alias("paper_id"),
        F.trim("titles.title").alias("title"),
        F.concat(people("contributors.authors.author", "author"), people("contributors.`secondary-authors`.author", "editor")).alias("authors"),
        F.coalesce(year(F.col("dates.year")), year(F.col("dates.`pub-dates`.date"))).cast("int").alias("publication_year"),
        F.trim("titles.`secondary-title`").alias("journal"),
        F.trim("`electronic-resource-num`").alias("doi"),
        F.coalesce("keywords.keyword", F.array().cast("array<string>")).alias("tags"),
        F.col("`ref-type`._name").alias("item_type"),
    )


def read_endnote(spark: SparkSession, path: str) -> DataFrame:
    return endnote_papers(spark.read.format("xml").option("rowTag", "record").schema(ENDNOTE).load(path))


def parse_endnote(rows: DataFrame, text: str = "value") -> DataFrame:
    """From a column of `<record>` elements."""
    return endnote_papers(rows.select(F.from_xml(text, ENDNOTE).alias("r")).select("r.*"))
