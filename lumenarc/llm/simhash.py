"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Fingerprints: majority bits of the XXH64 of 3-word shingles. Distinct fingerprints are cut into tiles
by the population counts of their four 16-bit quarters. Two fingerprints differ in at least as many
bits as their quarters' counts differ in sum, so tile pairs whose counts lie further apart than the
radius are skipped; all others are compared whole, by exclusive-or and bit counts on arrays. A tile
holds about TILE fingerprints; larger count classes are split and all their tiles compared. Of a
block's links only a spanning forest goes on, which keeps components and is never more than its nodes.

Null and empty texts, and those of white space, have fingerprint zero and link like any other.
Repeated rows share a fingerprint and component. doc_id may be null: a component's id is its smallest
doc_id that is not, else null.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import Bloom, bounded_batches, drop_caches, staged
from lumenarc.llm.components import connected_components, forest

RADIUS = 2
TILE = 2048
SEED = 42
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_lower).split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        part = words[lo : lo + BLOCK + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def simhash(texts):
        import pyarrow as pa

        drop_caches()
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return simhash(text)


def near_shifts(radius: int) -> list[tuple[int, ...]]:
    """Changes of four counts that sum to the radius at most."""
    out = [()]
    for _ in range(4):
        out = [(*s, d) for s in out for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return out


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """prints: fp (distinct) -> a, b: links that connect all fingerprints within `radius` bits, directly or in steps."""
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    code = lambda cs: sum((c * 17**k for k, c in enumerate(cs)), F.lit(0))
    signed = prints.select("fp", *[quarter(k).alias(f"q{k}") for k in range(4)]).withColumn("sig", code([F.col(f"q{k}") for k in range(4)]).cast("int"))
    sizes = signed.groupBy("sig").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # 17 ** 4 rows at most
    cut = signed.join(F.broadcast(sizes), "sig").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = staged(prints.sparkSession, cut.groupBy("sig", "sub").agg(F.collect_list("fp").alias("fps"), *[F.first(f"q{k}").alias(f"q{k}") for k in range(4)]), "tiles")
    # Shifts of the four counts, each as one number with a digit (plus radius) for a count.
    base = 2 * radius + 1
    shifts = F.lit([sum((d + radius) * base**k for k, d in enumerate(s)) for s in near_shifts(radius)])
    digit = lambda c, k: F.floor(c / base**k).cast("int") % base - radius
    inside = lambda c: reduce(lambda x, y: x & y, [(F.col(f"q{k}") + digit(c, k)).between(0, 16) for k in range(4)])
    near = F.transform(F.filter(shifts, inside), lambda c: F.col("sig") + sum((digit(c, k) * 17**k for k in range(4)), F.lit(0)))
    other = (
        tiles.select(F.col("sub").alias("their"), "fps", "sig", F.explode(F.filter(near, lambda c: c <= F.col("sig"))).alias("at"))
        .join(F.broadcast(sizes.withColumnRenamed("sig", "at")), "at")
        .select("at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("own"), "their", "fps")
        .groupBy("at", "own", "their")
        .agg(F.flatten(F.collect_list("fps")).alias("others"))
    )
    blocks = tiles.select(F.col("sig").alias("at"), F.col("sub").alias("own"), "fps").join(other, ["at", "own"]).select("fps", "others")

    def compare(rows):
        import pyarrow as pa

        for batch in rows:
            out_a, out_b = [], []
            for x, y in zip(batch.column("fps"), batch.column("others"), strict=True):
                a, b = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                hits_i, hits_j = [], []
                step = max(1, (1 << 20) // max(1, len(b)))
                for lo in range(0, len(a), step):
                    diff = a[lo : lo + step, None] ^ b[None, :]
                    i, j = np.nonzero((np.bitwise_count(diff) <= radius) & (diff != 0))
                    hits_i.append(i + lo)
                    hits_j.append(j)
                i, j = np.concatenate(hits_i), np.concatenate(hits_j)
                if len(i):
                    nodes, back = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
                    root = forest(len(nodes), back[: len(i)], back[len(i) :])
                    moved = root != np.arange(len(nodes))
                    out_a.append(nodes[moved].view(np.int64))
                    out_b.append(nodes[root[moved]].view(np.int64))
            if out_a:
                yield pa.record_batch([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return blocks.mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp, component (smallest key reachable over links), one row per input row."""
    spark = bounded_batches(docs.sparkSession)
    printed = staged(spark, docs.select(key, fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    classes = staged(spark, printed.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    comps = connected_components(fingerprint_links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(comps, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = staged(spark, rooted.join(lowest, "root").select("fp", "component"), "named")
    return printed.join(named, "fp")


def simhash_report(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that name a row by its doc_id and text."""
    return [F.xxhash64(doc_id, F.coalesce(text, F.lit("")), text.isNull()), F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")), doc_id)]


def without_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs less its marked rows. marked: k1, k2, drop (true: all rows of that key go; false: one stays).

    Rows that a filter of bounded size clears pass by; only the others are joined.
    """
    names = docs.columns
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn("__k1", k1)
    maybe = Bloom(marked, F.col("k1")).may_contain(F.col("__k1"))
    flagged = keyed.withColumn("__maybe", maybe)
    from pyspark.sql import Window

    one = Window.partitionBy("__k1", "__k2").orderBy(F.lit(1))
    suspects = flagged.where("__maybe").withColumn("__k2", k2)
    found = suspects.join(marked.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "drop"), ["__k1", "__k2"], "left")
    single = found.where("drop is null")
    repeated = found.where("not drop").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return flagged.where("not __maybe").select(names).unionByName(single.select(names)).unionByName(repeated.select(names))


def keep_one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each near-duplicate component: that of the smallest doc_id (nulls last), ties by text hash."""
    spark = bounded_batches(docs.sparkSession)
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    rows = staged(spark, docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), fingerprint_column(F.col("text")).alias("fp")), "prints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    classes = staged(spark, rows.groupBy("fp").agg(F.min(own).alias("first")), "classes")
    comps = connected_components(fingerprint_links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(comps, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    named = staged(spark, rooted.join(lowest, "root").select("fp", F.col("keep.k1").alias("keep1"), F.col("keep.k2").alias("keep2")), "named")
    marked = (
        rows.join(named, "fp")
        .groupBy("k1", "k2")
        .agg(F.first((F.col("k1") != F.col("keep1")) | (F.col("k2") != F.col("keep2"))).alias("drop"), F.count("*").alias("n"))
        .where("drop or n > 1")
        .drop("n")
    )
    return without_rows(docs, staged(spark, marked, "marked"))
