"""The store of papers, extractions, texts and chunks: reading, writing, replacing, exports."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.text import BIBTEX_ESCAPES, col, csv_guard, escape, word_count
from lumenarc.operators.corpus import keep_last, upsert

PAPER = "paper_id string, title string, author_string string, publication_year int, collections array<string>, tags array<string>, item_type string, doi string, abstract string"


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON in any of three shapes: {papers: [...]}, a list, or one record a line; later rows of an id win, rows without one go."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    wrapped = F.from_json("v", f"struct<papers: array<struct<{PAPER}>>>")["papers"]
    listed = F.from_json("v", f"array<struct<{PAPER}>>")
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{PAPER}>"))
    rows = raw.select(F.posexplode(F.when(F.col("v").startswith("["), listed).when(wrapped.isNotNull(), wrapped).otherwise(lines)).alias("pos", "p")).select("pos", "p.*")
    return keep_last(rows, "paper_id", "pos").drop("pos")


def text_manifest(texts: DataFrame) -> DataFrame:
    """paper_id, char_count, word_count, sha256 of full texts."""
    return texts.select("paper_id", F.length("text").cast("long").alias("char_count"), word_count("text").cast("long").alias("word_count"), F.sha2("text", 256).alias("sha256"))


def add_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by chunk_id; chunks without a vector are left out."""
    return upsert(old, new.where(F.size("embedding") > 0), "chunk_id")


def delete_papers(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("paper_id"), "paper_id", "left_anti")


def replace_papers(old: DataFrame, new: DataFrame, scope: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of the scope and of deleted papers give way to the new rows of the scope."""
    ids = scope.select("paper_id").union(deleted.select("paper_id")).distinct()
    return delete_papers(old, ids).unionByName(new.join(scope.select("paper_id").distinct(), "paper_id", "left_semi"))


class Versions:
    """A table as versioned folders and a pointer: a version is written aside and goes live in one small write; the previous one can come back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str | None:
        path, fs, _ = hadoop(self.spark, f"{self.root}/{name}")
        return self.spark.read.text(f"{self.root}/{name}").first()["value"] if fs.exists(path) else None

    def _point(self, name: str, path: str) -> None:
        replace_file(self.spark, f"{self.root}/{name}", path.encode())

    def exists(self) -> bool:
        return self._pointer("current") is not None

    def commit(self, df: DataFrame) -> str:
        path = f"{self.root}/v{time.time_ns()}"
        df.write.parquet(path)
        if (held := self._pointer("current")) is not None:
            self._point("previous", held)
        self._point("current", path)
        return path

    def rollback(self) -> None:
        if (held := self._pointer("previous")) is not None:
            self._point("current", held)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self._pointer("current"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="lumenarc-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The path as Hadoop names it, its file system and the settings."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf), conf


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_folder(spark)}/lumenarc/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file under another name and renames it, so that readers see the old file or the new one whole."""
    jvm = spark.sparkContext._jvm
    target, fs, conf = hadoop(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".write_{uuid.uuid4().hex}.tmp")
    try:
        out = fs.create(aside, True)
        out.write(bytearray(data))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, target, how)
    except Py4JJavaError:
        fs.delete(aside, False)
        raise


def write_json(spark: SparkSession, path: str, data, indent: int = 2) -> bool:
    """Replaces a file by data as JSON; False if it can't be written."""
    try:
        replace_file(spark, path, json.dumps(data, indent=indent, ensure_ascii=False, default=str).encode())
        return True
    except Py4JJavaError:
        return False


class Snapshot:
    """Copies of several artifacts (folders or files under one root), to bring them back after a failed update."""

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root.rstrip("/"), list(names)
        self.backup = f"{self.root}/snapshot-{uuid.uuid4().hex}"
        for name in self.names:
            self._copy(f"{self.root}/{name}", f"{self.backup}/{name}")

    def _copy(self, source: str, target: str) -> None:
        a, fs, conf = hadoop(self.spark, source)
        b, _, _ = hadoop(self.spark, target)
        if fs.exists(a):
            fs.mkdirs(b.getParent())
            self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs, b, False, True, conf)

    def restore(self) -> None:
        """Every artifact as it was; those that did not exist go."""
        for name in self.names:
            target, fs, _ = hadoop(self.spark, f"{self.root}/{name}")
            fs.delete(target, True)
            self._copy(f"{self.backup}/{name}", f"{self.root}/{name}")

    def drop(self) -> None:
        path, fs, _ = hadoop(self.spark, self.backup)
        fs.delete(path, True)


def export_csv(results: DataFrame) -> DataFrame:
    """Results as guarded text columns, scores to four places, lists joined."""
    out = []
    for name, kind in results.dtypes:
        c = F.array_join(name, "; ") if kind.startswith("array") else F.format_number(name, "0.####") if kind in ("double", "float") else F.col(name).cast("string")
        out.append(csv_guard(F.coalesce(c, F.lit(""))).alias(name))
    return results.select(*out)


def bibtex_entry(kind: Column | str, key: Column | str, **fields: Column) -> Column:
    """One entry; fields that are null or empty are left out."""
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), escape(c, BIBTEX_ESCAPES[1:]), F.lit("}"))) for n, c in fields.items()]
    return F.concat(F.lit("@"), col(kind), F.lit("{"), col(key), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def markdown_result(rank: Column, title: Column, year: Column, score: Column, text: Column, cut: int = 500) -> Column:
    body = F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("### "), rank.cast("string"), F.lit(". "), title, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")\n\nScore: "), F.format_number(score * 100, 1), F.lit("%\n\n> "), body)


#: How errors of skipped rows begin.
SKIPPED = ("No PDF", "Insufficient text", "Not extractable")


def skipped_report(results: DataFrame, papers: DataFrame) -> DataFrame:
    """Failed rows that were skipped, with their paper."""
    cond = ~F.col("success") & F.col("error").rlike("^(" + "|".join(SKIPPED) + ")")
    return results.where(cond).join(papers, "paper_id", "left")


def first_sufficient_text(candidates: list[tuple[str, Column]], min_words: int = 100) -> Column:
    """The first candidate text with enough words and its tier; else each tier's word count as a diagnosis."""
    out = None
    for tier, text in candidates:
        hit = F.struct(F.lit(tier).alias("tier"), text.alias("text"))
        ok = word_count(text) >= min_words
        out = F.when(ok, hit) if out is None else out.when(ok, hit)
    failed = F.concat_ws("; ", *[F.concat(F.lit(f"{t}: "), word_count(c).cast("string"), F.lit(" words")) for t, c in candidates])
    return out.otherwise(F.struct(F.lit("failed").alias("tier"), failed.alias("text")))


def session_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """User and assistant messages of a JSON-lines log; text parts joined; bad lines go."""
    schema = "type string, message struct<content: array<struct<type: string, text: string>>>"
    m = lines.select(F.from_json(value, schema).alias("m")).where(F.col("m.type").isin("user", "assistant"))
    text = F.array_join(F.transform(F.filter("m.message.content", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return m.select(F.col("m.type").alias("role"), text.alias("text"))
