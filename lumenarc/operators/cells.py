"""Exact neighbour searches among vectors that leave out what bounds exclude.

Rows are dealt to the cells of pivots (k-means centres of a bounded sample). A query at distance d from a pivot cannot
come nearer than d - radius to any row of its cell, so it only visits cells that its reach allows; what it visits is
decided in the query's task from the pivots alone. Queries and rows meet cell by cell, in parts of
bounded size on both sides, so that a cell that holds any share of the rows spans tasks. Nothing is lost: a
query whose reach is unknown visits every cell.

Where a sample of the queries reaches so many cells that sending packed blocks (`blocks`) to meet block by block is less
to send, all pairs are compared in that form instead; both are exact.

`nearest_others` finds k nearest rows (a first visit to the own cell gives the reach), `similar_pairs` joins by cosine
similarity. How much is left out depends on how far the data lie in groups; `visited_share` tells.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.operators.blocks import Blocks, nearest_in_blocks
from lumenarc.operators.vector_index import k_means, matrix_of, nearest_centre
from lumenarc.sources.store import staged

SAMPLE_ROWS = 65_536
#: Rows of a part of a cell, and queries that meet it at once.
PART_ROWS, PART_QUERIES = 2048, 2048
#: Queries of the sample that tells how many cells are reached.
PROBES = 2048


def slack(x):
    """What rounding may take from a bound."""
    return x * (1 + 1e-9) + 1e-9


class Cells:
    """rows: id, v (doubles of one length, no nulls). Ids are distinct. The dealt rows are a table in the shared folder."""

    def __init__(self, rows: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS):
        self.spark, self._blocks = rows.sparkSession, None
        self.kind = dict(rows.dtypes)["id"]
        key = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        n = rows.count()
        some = rows.where(key < -(-2 * sample_rows * (1 << 30) // n)) if n > 4 * sample_rows else rows
        sample = some.select(F.col("v").alias("v"), key.alias("k"), "id").orderBy("k", "id").limit(sample_rows).select("v").toArrow()
        self.n = n
        if not n:
            self.pivots, self.radii, self.parts = np.zeros((0, 0)), np.zeros(0), {}
            self.rows = rows.select("id", "v", F.lit(0).alias("cell"), F.lit(0).alias("part"))
            return
        x = np.array(sample.column("v").to_pylist(), float)
        self.pivots = pivots = k_means(x, max(1, min(cells or math.ceil(math.sqrt(n)), -(-len(x) // 8))), rounds=6)
        width = pivots.shape[1]

        @F.arrow_udf("struct<cell int, gap double>")
        def deal(v):
            import pyarrow as pa

            x = matrix_of(v, width)
            at = nearest_centre(x, pivots)
            return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(np.sqrt(((x - pivots[at]) ** 2).sum(1)))], names=["cell", "gap"])

        dealt = staged(self.spark, rows.select("id", "v", deal("v").alias("d")).select("id", "v", "d.cell", "d.gap"), "cells")
        found = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()  # a row a pivot
        self.radii = np.full(len(pivots), -np.inf)
        for r in found:
            self.radii[r["cell"]] = slack(r["gap"])
        self.parts = {r["cell"]: -(-r["n"] // PART_ROWS) for r in found}
        wide = {c: p for c, p in self.parts.items() if p > 1}
        self.part_count = F.coalesce(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])[F.col("cell")], F.lit(1)) if wide else F.lit(1)
        self.rows = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), self.part_count).cast("int"))

    def blocks(self) -> Blocks:
        """The rows packed for comparison of all pairs, made once."""
        if self._blocks is None:
            self._blocks = Blocks(self.rows.select("id", "v"), unit=False)
        return self._blocks

    def visits(self, q: Column, reach: Column) -> Column:
        """The cells that a query can reach (null: all)."""
        pivots, radii = self.pivots, self.radii
        width = pivots.shape[1]

        @F.arrow_udf("array<int>")
        def cells(v, far):
            import pyarrow as pa

            x = matrix_of(v, width)
            limit = slack(np.array([np.inf if f is None else f for f in far.to_pylist()]))
            out = []
            for k in range(0, len(x), 256):
                off = np.sqrt(np.maximum(((x[k : k + 256, None] - pivots[None]) ** 2).sum(2), 0))
                out += [np.flatnonzero(o - radii <= f).tolist() for o, f in zip(off, limit[k : k + 256], strict=True)]
            return pa.array(out, pa.list_(pa.int32()))

        return cells(q, reach)

    def visited(self, asked: DataFrame) -> DataFrame:
        """asked (id, v, reach, ...) with `cell`, a row for each cell to visit."""
        return asked.withColumn("cell", F.explode(self.visits(F.col("v"), F.col("reach"))))

    def visited_share(self, asked: DataFrame) -> float:
        """Share of the pairs of a query and a cell that meet."""
        n, met = asked.agg(F.count("*"), F.sum(F.size(self.visits(F.col("v"), F.col("reach"))))).first()
        return met / (n * len(self.parts)) if n else 0.0

    def blocks_are_cheaper(self, asked: DataFrame, n: int, blocks: Blocks, own: int) -> bool:
        """Whether n queries, of which `asked` (v, reach) are a sample, and all rows send fewer rows as blocks (queries: `own` blocks) than to the cells they reach."""
        seen = asked.agg(F.avg(F.size(self.visits(F.col("v"), F.col("reach"))))).first()[0] or 0.0
        met = seen * n
        return n * blocks.count + self.n * own < met + self.n * max(1.0, met / (len(self.parts) * PART_QUERIES))

    def meet(self, visiting: DataFrame, work, schema: str, rows: DataFrame | None = None) -> DataFrame:
        """work(queries, rows) of Arrow tables for each part of each cell; rows default to all rows of the cells."""
        rows = self.rows if rows is None else rows
        counts = {r["cell"]: -(-r["n"] // PART_QUERIES) for r in visiting.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        wide = {c: n for c, n in counts.items() if n > 1}
        groups = F.coalesce(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])[F.col("cell")], F.lit(1)) if wide else F.lit(1)
        left = visiting.withColumn("part", F.explode(F.sequence(F.lit(0), self.part_count - 1))).withColumn("__g", F.pmod(F.xxhash64(F.lit(5), "id"), groups).cast("int"))
        right = rows.withColumn("__g", F.explode(F.sequence(F.lit(0), groups - 1)))

        left = left.select([F.col(c).alias(f"q_{c}") for c in left.columns])  # both sides may be read from one table, whose columns must not be mixed up

        def both(a, b):
            return work(a.rename_columns([c[2:] for c in a.column_names]), b) if len(a) and len(b) else empty

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
        return left.groupBy("q_cell", "q_part", "q___g").cogroup(right.groupBy("cell", "part", "__g")).applyInArrow(both, schema)


def table_matrix(table, name: str, width: int) -> np.ndarray:
    return matrix_of(table.column(name).combine_chunks(), width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b, by differences where the shortcut would lose digits."""
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)
    scale = (a**2).sum(1)[:, None] + (b**2).sum(1)[None]
    near = np.argwhere(square < 1e-6 * scale)
    if len(near):
        square[near[:, 0], near[:, 1]] = ((a[near[:, 0]] - b[near[:, 1]]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0))


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """About PROBES of n rows, by their ids' hashes."""
    return rows.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < -(-PROBES * (1 << 30) // max(n, 1))) if n > PROBES else rows


def nearest_others(cells: Cells, k: int, asked: DataFrame | None = None, themselves: bool = False) -> DataFrame:
    """id, other, distance, rank: the k nearest rows of each query; ties by id. asked (id, v): the rows themselves unless given. A row of the query's id counts only with `themselves`."""
    width, kind = cells.pivots.shape[1], cells.kind

    def best(a, b):
        import pyarrow as pa

        d = distances(table_matrix(a, "v", width), table_matrix(b, "v", width))
        theirs, mine = b.column("id"), a.column("id")
        order = np.argsort(np.array(theirs.to_pylist(), object), kind="stable")
        d, theirs = d[:, order], theirs.take(order)
        place = {} if themselves else {i: n for n, i in enumerate(theirs.to_pylist())}
        for i, own in enumerate(mine.to_pylist()):
            if own in place:
                d[i, place[own]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, top, 1)
        keep = np.isfinite(near)
        i, _ = np.nonzero(keep)
        return pa.table({"id": mine.take(i), "other": theirs.take(top[keep]), "distance": near[keep]})

    queries = (cells.rows if asked is None else asked).select("id", "v")
    schema = f"id {kind}, other {kind}, distance double"
    if not cells.n:
        return cells.spark.createDataFrame([], schema + ", rank int")
    pivots = cells.pivots

    @F.arrow_udf("int")
    def home(v):
        import pyarrow as pa

        return pa.array(nearest_centre(matrix_of(v, width), pivots), pa.int32())

    def reaching(queries, homed):
        """The queries with the distance that the k-th nearest row of the own cell is off."""
        own = cells.meet(homed.select("id", "v", "cell"), best, schema)
        kth = own.groupBy("id").agg(F.sort_array(F.collect_list("distance")).alias("d")).select("id", F.get("d", F.lit(k - 1)).alias("reach"))  # k numbers a part of the own cell
        return queries.join(kth, "id", "left")

    homed = cells.rows if asked is None else queries.withColumn("cell", home("v"))
    blocks = cells.blocks()
    theirs = blocks if asked is None else Blocks(queries, unit=False)
    some = staged(cells.spark, sampled(homed.select("id", "v", "cell"), theirs.n), "probes")
    if cells.blocks_are_cheaper(reaching(some.select("id", "v"), some), theirs.n, blocks, theirs.count):
        found = nearest_in_blocks(blocks, theirs, k, themselves)
        return found.select(F.col("src").alias("id"), F.col("dst").alias("other"), (-F.col("score")).alias("distance"), "rank")
    visiting = staged(cells.spark, cells.visited(reaching(queries, homed)).drop("reach"), "visits")
    found = cells.meet(visiting, best, schema)
    w = Window.partitionBy("id").orderBy("distance", "other")  # k rows a visited part
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_rows(vectors: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """id, v: vectors of length 1; those without a direction go."""
    v = F.col(vector_col).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(F.col(key).alias("id"), v.alias("v"), size.alias("__n")).where("__n > 0 and __n < double('infinity')").select("id", F.transform("v", lambda x: x / F.col("__n")).alias("v"))


def similar_pairs(cells: Cells, least: float, digits: int = 4) -> DataFrame:
    """src, dst, score: all ordered pairs of different rows whose cosine similarity, rounded, is at least `least` and positive. cells: of unit vectors."""
    width, kind = cells.pivots.shape[1], cells.kind
    floor = max(least - 10.0**-digits, 0.0)

    def close(a, b):
        import pyarrow as pa

        sims = np.round(table_matrix(a, "v", width) @ table_matrix(b, "v", width).T, 12)
        i, j = np.nonzero((sims >= floor) & (sims > 0))
        out = pa.table({"src": a.column("id").take(i), "dst": b.column("id").take(j), "score": sims[i, j]})
        import pyarrow.compute as pc

        return out.filter(pc.not_equal(out.column("src"), out.column("dst")))

    schema = f"src {kind}, dst {kind}, score double"
    if not cells.n:
        return cells.spark.createDataFrame([], schema)
    visiting = staged(cells.spark, cells.visited(within(cells, floor)).drop("reach"), "visits")
    return cells.meet(visiting, close, schema).withColumn("score", F.round("score", digits)).where(F.col("score") >= least)


def within(cells: Cells, least: float) -> DataFrame:
    """The cells' rows (unit vectors) as queries that reach as far as this similarity."""
    return cells.rows.select("id", "v").withColumn("reach", F.lit(math.sqrt(max(0.0, 2 - 2 * least))))
