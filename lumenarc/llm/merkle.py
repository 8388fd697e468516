"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

H is sha256 in lowercase hex over concatenated hex digests. A row's leaf is H of its fields, each `-` if
null, else its UTF-8 length, `:` and its value. Leaves of a group ascend by key (nulls first; equal keys by
leaf, then in any order, as such rows are the same); every FANOUT consecutive nodes become their H until one is
left, a lone leaf itself. The groups' roots, ordered by group (null first, then by bytes), form the tree
of the whole table in the same way.

Spark sorts leaves (not texts) by range, so that a group of any size spans many tasks, and counts turn places within
sorted runs into places within groups. Aligned blocks of FANOUT^height leaves are packed into rows of
contiguous digests. A task lays a block's leaves out as a numpy matrix of 64-byte rows, reshapes it by
fanout and hashes row by row, level by level; siblings follow from index arithmetic. The blocks' roots are the
leaves of the next round, until every group has one root, and the groups' roots go through the same rounds.
Then paths come down: each block gets its siblings from its own root to the top, and adds those below.

An empty table has no root and gives no rows. Null fields, null groups, empty and long texts, repeated
rows and extra columns (which are not hashed) need no special care; only the named columns are read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import Scratch, bounded_batches, drop_caches, staged

FANOUT = 3
#: Levels of a block: FANOUT^7 = 2187 leaves of 64 bytes.
HEIGHT = 7
WIDTH = 64
FIELDS = "doc_id", "source", "lang", "n_chars", "text"


def leaf(*fields: Column) -> Column:
    """H of one row's fields."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[text(c) for c in fields]), 256)


def matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, WIDTH)


def hashed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """H of each row's first `size` bytes."""
    flat, width = rows.tobytes(), rows.shape[1]
    starts = range(0, len(rows) * width, width)
    return matrix("".join([sha256(flat[s : s + n]).hexdigest() for s, n in zip(starts, sizes.tolist(), strict=True)]).encode())


def runs(level: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive nodes side by side, a run a row, and each run's bytes."""
    n = -(-len(level) // fanout)
    held = np.zeros((n * fanout, WIDTH), np.uint8)
    held[: len(level)] = level
    sizes = np.full(n, fanout * WIDTH)
    sizes[-1] -= (n * fanout - len(level)) * WIDTH
    return held.reshape(n, fanout * WIDTH), sizes


def levels(leaves: np.ndarray, whole: bool, height: int, fanout: int) -> list[np.ndarray]:
    """A block's levels from its leaves up. whole: the block is all of its tree, which ends when one node is left; others go up `height` levels."""
    out = [leaves]
    while len(out[-1]) > 1 or (not whole and len(out) <= height):
        out.append(hashed(*runs(out[-1], fanout)))
    return out


def blocks(nodes: DataFrame, group: str, height: int, fanout: int) -> DataFrame:
    """nodes: group, n (nodes of the group), place, digest and others. A row a block: group, n, block, rows (structs by place)."""
    others = [c for c in nodes.columns if c not in (group, "n")]
    packed = nodes.withColumn("block", F.floor(F.col("place") / fanout**height))
    return packed.groupBy(group, "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(*others))).alias("rows"))  # fanout^height rows


def block_roots(packed: DataFrame, height: int, fanout: int) -> Column:
    """The root of each block."""

    @F.arrow_udf("string")
    def root(n, digests):
        import pyarrow as pa

        drop_caches()
        return pa.array([levels(matrix("".join(d).encode()), k <= fanout**height, height, fanout)[-1].tobytes().decode() for k, d in zip(n.to_pylist(), digests.to_pylist(), strict=True)], pa.string())

    return root("n", F.transform("rows", lambda r: r["digest"]))


def path_schema(group_type: str) -> str:
    return f"grp {group_type}, place long, subroot string, root string, path array<struct<at int, nodes binary>>"


def siblings_up(level_list: list[np.ndarray], fanout: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top and each leaf: the run it lies in, its place in the run, and the run's bytes."""
    place, out = np.arange(len(level_list[0])), []
    for level in level_list[:-1]:
        held, sizes = runs(level, fanout)
        run = place // fanout
        out.append((held[run], place % fanout, sizes[run]))
        place = run
    return out


def join_paths(own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], i: int, above: list[tuple[int, bytes]]) -> list[dict]:
    return [{"at": int(at[i]), "nodes": held[i, : sizes[i]].tobytes()} for held, at, sizes in own] + above


def node_paths(packed: DataFrame, group_type: str, height: int, fanout: int) -> DataFrame:
    """packed: blocks with subroot, root and `above`, the path of the block's root (a step: place in the run, the run). grp, place, subroot, root, path of every node of the blocks."""

    def run(batches):
        import pyarrow as pa

        drop_caches()
        kind = pa.list_(pa.struct([("at", pa.int32()), ("nodes", pa.binary())]))
        for batch in batches:
            for i in range(batch.num_rows):
                b = {c: batch.column(c)[i].as_py() for c in ("n", "block", "digests", "subroot", "root", "above")}
                all_levels = levels(matrix("".join(b["digests"]).encode()), b["n"] <= fanout**height, height, fanout)
                own, m = siblings_up(all_levels, fanout), len(b["digests"])
                first = b["block"] * fanout**height
                group = pa.array([batch.column("grp")[i].as_py()] * m, batch.schema.field("grp").type)
                yield pa.record_batch([group, pa.array(range(first, first + m), pa.int64()), *[pa.array([b[c]] * m, pa.string()) for c in ("subroot", "root")], pa.array([join_paths(own, k, b["above"]) for k in range(m)], kind)], names=["grp", "place", "subroot", "root", "path"])

    ready = packed.select("grp", "n", "block", F.transform("rows", lambda r: r["digest"]).alias("digests"), "subroot", "root", "above")
    return ready.mapInArrow(run, path_schema(group_type))


def placed(leaves: DataFrame, keys: list[Column], scratch: Scratch) -> DataFrame:
    """leaves (grp, digest, others) with n and place, by the order of keys in each group. A range sort, then counts of each sorted run and group.

    Rows are numbered as they are read, and the number is the last key: so equal rows, however many, spread over ranges too.
    """
    order = ["grp", *keys, "digest", "__s"]
    ranged = leaves.withColumn("__s", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.put(ranged.drop("__s").withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "sorted")
    found = rows.groupBy("grp", "__p").agg(F.count("*").alias("c"), F.min("__i").alias("__first"))
    before = Window.partitionBy("grp").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    starts = found.select("grp", "__p", "__first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"), F.sum("c").over(Window.partitionBy("grp")).alias("n"))
    starts = starts.withColumnsRenamed({"grp": "g2", "__p": "p2"})
    return rows.join(starts, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("__p") == F.col("p2"))).withColumn("place", F.col("__i") - F.col("__first") + F.col("__before")).drop("g2", "p2", "__p", "__i", "__first", "__before")


def stack(nodes: DataFrame, height: int, fanout: int, scratch: Scratch) -> list[DataFrame]:
    """Blocks of every round, from the nodes (grp, n, place, digest, ...) up to blocks that hold the whole of a tree."""
    out = [scratch.put(blocks(nodes, "grp", height, fanout), "blocks")]
    while True:
        wide = out[-1].where(F.col("n") > fanout**height)
        up = wide.select("grp", F.ceil(F.col("n") / fanout**height).alias("n"), F.col("block").alias("place"), block_roots(wide, height, fanout).alias("digest"))
        nxt = scratch.put(blocks(up, "grp", height, fanout), "blocks")
        if nxt.isEmpty():
            return out
        out.append(nxt)


def group_roots(rounds: list[DataFrame], height: int, fanout: int) -> DataFrame:
    """grp, digest: the root of every tree."""
    tops = [b.where(F.col("n") <= fanout**height) for b in rounds]
    every = tops[0].select("grp", block_roots(tops[0], height, fanout).alias("digest"))
    for t in tops[1:]:
        every = every.unionByName(t.select("grp", block_roots(t, height, fanout).alias("digest")))
    return every


def with_above(rounds: list[DataFrame], top: DataFrame, group_type: str, height: int, fanout: int) -> DataFrame:
    """The lowest round's blocks with subroot, root and `above`. top: grp, subroot, root, path of every tree's root within what stands above it."""
    tops = top.select(F.col("grp").alias("g2"), "subroot", "root", F.col("path").alias("above"))
    known = None
    for b in reversed(rounds):
        at_top = b.where(F.col("n") <= fanout**height).join(tops, F.col("grp").eqNullSafe(F.col("g2"))).drop("g2")
        if known is not None:
            below = known.select(F.col("grp").alias("g2"), F.col("place").alias("b2"), "subroot", "root", F.col("path").alias("above"))
            inner = b.where(F.col("n") > fanout**height).join(below, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("block") == F.col("b2"))).drop("g2", "b2")
            at_top = at_top.unionByName(inner)
        known = node_paths(at_top, group_type, height, fanout) if b is not rounds[0] else at_top
    return known


def fold(own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], above: list[dict], digests: np.ndarray, fanout: int) -> np.ndarray:
    """What each row's root is, if its leaf is `digests` and its siblings are as they are."""
    slots = np.arange(WIDTH)[None, :]
    for held, at, sizes in own:
        changed = held.copy()
        np.put_along_axis(changed, at[:, None] * WIDTH + slots, digests, 1)
        digests = hashed(changed, sizes)
    for step in above:
        changed = np.repeat(matrix(step["nodes"]).reshape(1, -1), len(digests), 0)
        changed[:, step["at"] * WIDTH : (step["at"] + 1) * WIDTH] = digests
        digests = hashed(changed, np.full(len(digests), changed.shape[1]))
    return digests


def proofs(own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], above: list[dict], n: int) -> list[str]:
    """H of each row's siblings, level by level, left to right."""
    parts = []
    for held, at, sizes in own:
        width, raw = held.shape[1], held.tobytes()
        parts.append([raw[k * width : k * width + a * WIDTH] + raw[k * width + (a + 1) * WIDTH : k * width + s] for k, (a, s) in enumerate(zip(at.tolist(), sizes.tolist(), strict=True))])
    tail = b"".join(s["nodes"][: s["at"] * WIDTH] + s["nodes"][(s["at"] + 1) * WIDTH :] for s in above)
    if not parts:
        return [sha256(tail).hexdigest()] * n
    return [sha256(b"".join(p) + tail).hexdigest() for p in zip(*parts, strict=True)]


def build_manifest(df: DataFrame, digest: Column, group: Column, keys: dict[str, Column], other_leaf: Column | None = None, height: int = HEIGHT, fanout: int = FANOUT) -> DataFrame:
    """A proof of every row: the columns of `keys` (one or more, in this order), leaf, subroot, root, proof_sha256, folded_root, verified.

    other_leaf: the leaf to verify in the row's place (null or the digest itself: as it is).
    """
    spark = bounded_batches(df.sparkSession)
    scratch = Scratch(spark)
    rows = df.select(group.alias("grp"), digest.alias("digest"), F.coalesce(digest if other_leaf is None else other_leaf, digest).alias("other"), *[c.alias(f"k_{n}") for n, c in keys.items()])
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    names = [f"k_{n}" for n in keys]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    group_type = kinds["grp"].simpleString()
    nodes = placed(rows, [F.col(n) for n in names], scratch).select("grp", "n", "place", "digest", "other", *names)
    rounds = stack(nodes, height, fanout, scratch)
    roots = scratch.put(group_roots(rounds, height, fanout).withColumn("name", F.col("grp")).select(F.lit(0).alias("grp"), "digest", "name"), "roots")
    upper = placed(roots, [F.col("name").cast("string").cast("binary")], scratch).select("grp", "n", "place", "digest", "name")
    upper_rounds = stack(upper, height, fanout, scratch)
    the_root = group_roots(upper_rounds, height, fanout)
    start = the_root.select("grp", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<struct<at int, nodes binary>>").alias("path"))
    upper_blocks = with_above(upper_rounds, start, "int", height, fanout)
    upper_paths = node_paths(upper_blocks, "int", height, fanout).select("place", "root", "path")
    tops = scratch.put(upper.select("place", F.col("name").alias("grp"), F.col("digest").alias("subroot")).join(upper_paths, "place").drop("place"), "tops")
    ready = with_above(rounds, tops, group_type, height, fanout)
    out_names = [*keys, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key_types = ", ".join(f"`{n}` {kinds[f'k_{n}'].simpleString()}" for n in keys)

    def run(batches):
        import pyarrow as pa

        drop_caches()
        for batch in batches:
            for i in range(batch.num_rows):
                b = {c: batch.column(c)[i].as_py() for c in ("n", "root", "above", "subroot")}
                own_rows = batch.column("rows")[i].values
                digests = own_rows.field("digest").to_pylist()
                lowest = matrix("".join(digests).encode())
                own = siblings_up(levels(lowest, b["n"] <= fanout**height, height, fanout), fanout)
                other = [o or d for o, d in zip(own_rows.field("other").to_pylist(), digests, strict=True)]
                folded = [f.tobytes().decode() for f in fold(own, b["above"], matrix("".join(other).encode()), fanout)]
                m, root = len(digests), b["root"]
                yield pa.record_batch(
                    [*[own_rows.field(n) for n in names], pa.array(digests), pa.array([b["subroot"]] * m), pa.array([root] * m), pa.array(proofs(own, b["above"], m)), pa.array(folded), pa.array([f == root for f in folded])],
                    names=out_names,
                )

    out = staged(spark, ready.mapInArrow(run, f"{key_types}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), "proofs")
    scratch.drop()
    return out


def manifest_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`: newlines are deleted where 2 divides crc32(doc_id)."""
    at = {c: F.col(c) for c in FIELDS}
    digest = leaf(*at.values())
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = leaf(*(at | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    return build_manifest(docs, digest, F.col("source"), {"doc_id": F.col("doc_id")}, F.when(even & F.contains("text", F.lit("\n")), changed))
