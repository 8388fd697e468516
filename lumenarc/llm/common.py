"""Pieces the corpus operators share: shared-folder tables, Arrow row functions, Bloom prefilters."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Only where it is unset and Spark runs in one process, a temporary folder is set."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lumenarc-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to few rows and bytes, so that long texts don't pile up in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


_caches: dict[str, Callable[[], None]] = {}
#: Gives freed memory back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def worker_cache(name: str, clear: Callable[[], None]) -> None:
    """Names what a worker process keeps between tasks and how it is dropped."""
    _caches[name] = clear


def drop_caches(but: str = "") -> None:
    """Called as a task of another operator begins: workers live on, and their memory is shared by all stages."""
    for name, clear in _caches.items():
        if name != but:
            clear()
    if _trim is not None:
        _trim(0)


def trim_workers(spark: SparkSession) -> None:
    """Lets the executors' idle Python workers give back what earlier stages left in them: workers are handed out in turn, so some small tasks reach all."""

    def trim(batches):
        drop_caches()
        yield from ()

    tasks = 8 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInArrow(trim, "id long").count()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenarc/{name}-{uuid.uuid4().hex}"


#: Tells Spark to delete a query's shuffle files as it ends; else they stay until the driver collects garbage, which may be never.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What is written or counted in here leaves no shuffle files behind."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def write_table(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    return write_table(spark, df, new_path(spark, name))


class Scratch:
    """Staged tables that one job needs only until its own result is staged; `drop` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        return write_table(self.spark, df, path)

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of the keys; of a large table only about as many rows reach the sort."""
    total = df.count()
    if total > 4 * n:
        share = -(-2 * n * (1 << 30) // total)
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < share)
    return df.orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)), *keys).limit(n)


def bounded_sample(df: DataFrame, n: int, most_bytes: int, text_col: str, *keys: str) -> DataFrame:
    """At most n rows and about most_bytes bytes of text, by the keys' hashes; a text is taken whole or not at all."""
    from pyspark.sql import Window

    size = F.octet_length(text_col)
    some = hash_sample(df.where(size <= most_bytes), n, *keys)
    order = Window.orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)), *keys).rowsBetween(Window.unboundedPreceding, 0)  # n rows
    return some.withColumn("__sum", F.sum(size).over(order)).where(F.col("__sum") <= most_bytes).drop("__sum")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text (null as empty): rows with the same text share a key."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(7), t)]


def roomy(keys: DataFrame) -> int:
    """Bits of a Bloom filter of these keys (a staged table), so that it lets few others pass: 8 a key or more, 2 MB at least and 32 MB at most."""
    with freed_shuffles(keys.sparkSession):
        return min(1 << 28, max(1 << 24, 1 << (8 * keys.count()).bit_length()))


class Bloom:
    """Membership filter of bits / 8 bytes, whatever the data. It only spares shuffling rows that cannot match; a full filter lets all pass.

    hashed: the keys are 64-bit hashes already and name their bits themselves, so that `holds` can test them inside a Python task.
    """

    def __init__(self, keys: DataFrame, key: Column, bits: int = 1 << 24, hashed: bool = False):
        self.bits = bits
        self.place = (lambda k: F.pmod(k, F.lit(bits))) if hashed else (lambda k: F.pmod(F.xxhash64(F.lit(11), k), F.lit(bits)))
        h = self.place(key)
        with freed_shuffles(keys.sparkSession):
            words = (
                keys.select(h.alias("h"))
                .groupBy(F.shiftright("h", 6).cast("int").alias("w"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
                .toArrow()
            )
        filled = np.zeros(bits >> 6, np.int64)
        filled[words.column("w").to_numpy()] = words.column("b").to_numpy()
        sc = keys.sparkSession.sparkContext
        self.cast = sc.broadcast(filled.tobytes())

    @staticmethod
    def holds(filled: bytes, keys: np.ndarray) -> np.ndarray:
        """For a filter of hashed keys: which of these int64 keys may be in it. filled: the value of `cast`."""
        held = np.frombuffer(filled, np.int64)
        h = keys & np.int64(len(held) * 64 - 1)
        return (held[h >> 6] >> (h & 63)) & 1 == 1

    def may_contain(self, key: Column) -> Column:
        cast = self.cast

        @F.arrow_udf("boolean")
        def hit(h):
            import pyarrow as pa

            held = np.frombuffer(cast.value, np.int64)
            h = h.to_numpy(zero_copy_only=False)
            return pa.array((held[h >> 6] >> (h & 63)) & 1 == 1)

        return hit(self.place(key))
