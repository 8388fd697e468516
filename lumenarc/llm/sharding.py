"""Operator 2 [native]: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows whose identity occurs more than once get a number each, and all rows are written once to the shared
folder, so that every count and every draw sees the same numbers and a lost task draws the same again.
They lie in source partitions by a hash of identity and number. The numbers of rows that each partition
sends to each shard are drawn from the law they have under a uniform permutation of all rows
(multivariate hypergeometric, row by row of the matrix), so shard sizes are exact: `rows` law, counts
at most one apart. Each partition permutes its rows locally and cuts them by its matrix row; after the
exchange the shard permutes again, which gives the slots.

A shard's permutation is a distributed sort by a random key: rows are ranked in cells (shard, high
bits of the key), and a cell's first slot is the count of rows in the shard's earlier cells. No task
holds a shard. Random keys are hashes of seed, identity and number: the copies of a row that is a third of
the table fall into as many cells as any other rows.

Nulls count as values, texts are whole. Repeated rows are placed one by one. An empty table gives an empty
result. All columns are kept; `shard` and `slot` replace columns of these names. Beyond MOST_PARTITIONS or
MOST_CELLS partitions and cells hold more rows each, which their sorts spill to disk.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import staged

#: Rows that a source partition or a cell holds on average.
CELL_ROWS = 20_000
#: Most source partitions, and most cells of a shard: the matrix and the offsets stay small on the driver.
MOST_PARTITIONS, MOST_CELLS = 4096, 4096


def hypergeometric(rng: random.Random, drawn: int, good: int, total: int) -> int:
    """How many of `drawn` rows taken from `total` are among `good`: inversion outward from the mode, for any size."""
    from math import exp, lgamma

    lo, hi = max(0, drawn - (total - good)), min(drawn, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (total + 2)))
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    p = exp(choose(good, mode) + choose(total - good, drawn - mode) - choose(total, drawn))
    u, up, down, p_up, p_down = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (total - good - drawn + up + 1))
            up += 1
            if (u := u - p_up) <= 0:
                return up
        if down > lo:
            p_down *= down * (total - good - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            if (u := u - p_down) <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row p: how many of partition p's rows go to each shard. Row sums are `counts`, column sums `sizes`."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, total = [], sum(left)
        for room in left:
            k = hypergeometric(rng, n, room, total) if n else 0
            row.append(k)
            n, total = n - k, total - room
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, identity: list[str], seed: int = 20240229, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with `shard` (0 to shards - 1, sizes at most one apart) and `slot` (gapless from 0 in each shard).

    identity: columns that tell rows apart; the place of a row without copies depends on them, the seed and the table's identities alone.
    """
    spark = df.sparkSession
    key = lambda salt: F.xxhash64(F.lit(seed + salt), "__row", *[F.struct(F.col(c).isNull(), F.col(c)) for c in identity])
    marked = df.drop("shard", "slot").withColumn("__id", F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in identity]))
    again = staged(spark, marked.groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1"), "copies")
    number = F.when(F.col("__n").isNotNull(), F.monotonically_increasing_id()).otherwise(0)
    rows = staged(spark, marked.join(again, "__id", "left").withColumn("__row", number).drop("__id", "__n"), "rows")
    total = rows.count()
    if not total:
        return rows.drop("__row").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    parts = max(1, min(MOST_PARTITIONS, -(-total // cell_rows)))
    cells = max(1, min(MOST_CELLS, -(-total // (shards * cell_rows))))
    rows = rows.withColumn("__p", F.pmod(key(1), F.lit(parts)).cast("int"))
    counts = {r["__p"]: r["n"] for r in rows.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTITIONS rows
    by_part = [counts.get(p, 0) for p in range(parts)]
    matrix = communication_matrix(by_part, shard_sizes(total, shards), seed)
    ends = []
    for row in matrix:
        run, end = 0, []
        for k in row:
            run += k
            end.append(run)
        ends.append(end)
    cuts = spark.createDataFrame([(p, e) for p, e in enumerate(ends)], "__p int, __ends array<long>")
    local = Window.partitionBy("__p").orderBy(key(2), "__row")
    sent = (
        rows.withColumn("__i", F.row_number().over(local))
        .join(F.broadcast(cuts), "__p")  # MOST_PARTITIONS rows of `shards` numbers at most
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__i"))))
        .drop("__ends", "__i", "__p")
        .withColumn("__key", key(3))
        .withColumn("__cell", F.pmod(F.shiftrightunsigned("__key", 20), F.lit(cells)).cast("int"))
    )
    found = sent.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__cell").orderBy("__key", "__row")
    return (
        sent.withColumn("__r", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "__cell"])  # shards x MOST_CELLS rows of three numbers at most
        .withColumn("slot", (F.col("__start") + F.col("__r") - 1).cast("long"))
        .drop("__cell", "__key", "__r", "__row", "__start")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's columns for `documents`, by the `rows` law."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shuffle_into_shards(rows, shards, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
