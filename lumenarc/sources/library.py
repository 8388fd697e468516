"""Library databases as tables: items with attachments, attributes, creators, folders and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.functions.ids import epoch_time
from lumenarc.functions.text import col

#: Item kinds that are no records of their own.
NO_ITEMS = ("attachment", "note", "annotation")


def items_with_attachments(items: DataFrame, types: DataFrame, attachments: DataFrame, deleted: DataFrame, content_types: list[str]) -> DataFrame:
    """items (item_id, type_id, key), types (type_id, type_name), attachments (attachment_id, parent_id, content_type, path): records with attachments of these kinds, none deleted."""
    kept = attachments.where(F.col("content_type").isin(content_types)).withColumnRenamed("parent_id", "item_id")
    rows = items.join(F.broadcast(types.where(~F.col("type_name").isin(*NO_ITEMS))), "type_id").join(kept, "item_id")
    gone = deleted.select("item_id")
    return rows.join(gone, "item_id", "left_anti").join(gone.withColumnRenamed("item_id", "attachment_id"), "attachment_id", "left_anti")


def first_attachment(rows: DataFrame) -> DataFrame:
    """The first row of each (item_id, path); `skipped` counts the others."""
    w = Window.partitionBy("item_id", "path")
    out = rows.withColumn("__n", F.row_number().over(w.orderBy("attachment_id"))).withColumn("skipped", F.count("*").over(w) - 1)
    return out.where("__n = 1").drop("__n")


def all_source_items(pdf: DataFrame, html: DataFrame) -> DataFrame:
    return pdf.unionByName(html.join(pdf.select("item_id"), "item_id", "left_anti"))


def pivot_attributes(values: DataFrame, fields: list[str], key: str = "item_id") -> DataFrame:
    """(key, field, value) rows to a column for each field."""
    return values.groupBy(key).pivot("field", fields).agg(F.first("value", ignorenulls=True))


def ordered_authors(creators: DataFrame) -> DataFrame:
    """item_id, authors: in order; single-field names have no first name."""
    first = F.when(F.col("field_mode") == 1, F.lit("")).otherwise(F.col("first_name"))
    one = F.struct((F.col("order_index") + 1).alias("order"), first.alias("first_name"), "last_name", "role")
    return creators.groupBy("item_id").agg(F.sort_array(F.collect_list(one)).alias("authors"))


def item_lists(bridge: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """item_id and the sorted names that a bridge table ties to it."""
    return bridge.join(F.broadcast(names), key).groupBy("item_id").agg(F.array_sort(F.collect_list("name")).alias(out))


def attachment_path(key: Column | str, path: Column | str, root: str) -> Column:
    """Stored files under the item's folder; links as they are; none for web links, parents and absolute names inside the store."""
    p = col(path)
    name = F.regexp_replace(p, "^storage:", "")
    unsafe = F.contains(name, F.lit("..")) | name.startswith("/") | name.rlike(r"^[A-Za-z]:")
    return F.when(p.isNull() | p.rlike("^https?://"), None).when(p.startswith("storage:"), F.when(~unsafe, F.concat_ws("/", F.lit(root.rstrip("/")), col(key), name))).otherwise(p)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that the table has; null if none."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None)


def mendeley_papers(documents: DataFrame, authors: DataFrame, tags: DataFrame, folders: DataFrame) -> DataFrame:
    """documents with names that differ by version; authors (document_id, order_index, first_name, last_name), tags (document_id, tag), folders (document_id, path)."""
    d = documents.select(
        first_present(documents, ["id", "documentId", "document_id"]).alias("document_id"),
        first_present(documents, ["title", "Title"]).cast("string").alias("title"),
        first_present(documents, ["year", "publication_year"]).cast("int").alias("publication_year"),
        first_present(documents, ["doi", "DOI"]).cast("string").alias("doi"),
        epoch_time(first_present(documents, ["added", "dateAdded", "created"])).alias("date_added"),
    )
    who = authors.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "first_name", "last_name"))), lambda a: F.struct(a["first_name"].alias("first_name"), a["last_name"].alias("last_name"))).alias("authors"))
    marks = tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    places = folders.groupBy("document_id").agg(F.array_sort(F.collect_set("path")).alias("collections"))
    out = d.join(who, "document_id", "left").join(marks, "document_id", "left").join(places, "document_id", "left")
    return out.withColumn("paper_id", F.concat(F.lit("mendeley_"), "document_id"))


#: Readers added by the caller: name -> function of (spark, path, options) that returns papers.
PLUGINS: dict = {}


def register_source(name: str, reader) -> None:
    """Adds a provider for read_source."""
    PLUGINS[name] = reader


def read_source(spark: SparkSession, provider: str, path: str, **options) -> DataFrame:
    """Papers of one provider: bibtex, paperpile, endnote, folder, or a table written by this library (parquet, json)."""
    from lumenarc.sources import bibliography, folder, store

    readers = {
        "bibtex": lambda: bibliography.read_bibtex(spark, path),
        "paperpile": lambda: bibliography.read_bibtex(spark, path, "paperpile"),
        "endnote": lambda: bibliography.read_endnote(spark, path),
        "folder": lambda: folder.read_folder(spark, path, **options),
        "parquet": lambda: spark.read.parquet(path),
        "json": lambda: store.read_papers(spark, path),
    }
    readers |= {name: (lambda r=reader: r(spark, path, options)) for name, reader in PLUGINS.items()}
    if provider not in readers:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(sorted(readers))}")
    out = readers[provider]()
    return out.orderBy("paper_id").limit(options["limit"]) if options.get("limit") else out
