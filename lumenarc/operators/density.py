"""Density clusters (HDBSCAN) over a distributed minimum spanning tree.

1. Core distances: the distance to the `min_samples`-th other row. The mutual reachability of two rows is the largest of
   their distance and both core distances.
2. Spanning tree by Boruvka's rounds over neighbour lists. A row's list leaves out only rows beyond its last
   neighbour, so a component's lightest listed edge is final once it is no heavier than the least such bound
   of its rows; for other components the rows below that search exactly for rows of other components.
   Each round at least halves the components.
3. Condensed hierarchy. From both ends of every tree edge lighter edges are followed for fewer than
   `min_cluster_size` rows, which tells whether either side is a cluster when the edge joins them. Edges that join two
   clusters are splits; without them the tree falls into its smallest clusters. Only the splits (below n /
   min_cluster_size edges of three numbers) go to the driver, which gets the hierarchy of clusters.
4. Stability: where each row leaves its cluster is a join and a sum. Clusters more stable than what they contain
   are chosen; rows that left before a chosen cluster arose are noise, -1.

Equal weights are ordered by the ids of their ends. Rows are distinct by id; rows at distance zero leave at
density 1 / TINY.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.operators.blocks import TILE_COLUMNS, TILE_ROWS, Blocks
from lumenarc.operators.cells import Cells, distances, nearest_others, sampled, table_matrix
from lumenarc.operators.graph import components
from lumenarc.sources.store import shared_folder, staged

TINY = 1e-12
#: Neighbours listed for the spanning tree's rounds, at least.
LISTED = 8


def core_distances(near: DataFrame, min_samples: int) -> DataFrame:
    """id, core from nearest_others (fewer rows than min_samples: the farthest there is)."""
    return near.where(F.col("rank") <= min_samples).groupBy("id").agg(F.max("distance").alias("core"))


def edge(w: Column | str, a: Column | str, b: Column | str) -> Column:
    """An edge that is compared by weight, then by its ends."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(w).alias("w"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def nearest_outside(cells: Cells, asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked (id, v, core, comp, reach), members: the cells' rows with core and comp. id, other, w: the lightest edge of each row that leaves its component."""
    width, kind = cells.pivots.shape[1], cells.kind

    def best(a, b):
        import pyarrow as pa

        core = lambda t: t.column("core").to_numpy()
        w = np.maximum(np.maximum(distances(table_matrix(a, "v", width), table_matrix(b, "v", width)), core(a)[:, None]), core(b)[None])
        order = np.argsort(np.array(b.column("id").to_pylist(), object), kind="stable")
        number: dict = {}
        comp = lambda t: np.array([number.setdefault(c, len(number)) for c in t.column("comp").to_pylist()])
        w = np.where(comp(a)[:, None] == comp(b)[None], np.inf, w)[:, order]
        top = w.argmin(1)
        least = w[np.arange(len(w)), top]
        keep = np.isfinite(least)
        return pa.table({"id": a.column("id").filter(pa.array(keep)), "other": b.column("id").take(order[top[keep]]), "w": least[keep]})

    n = asked.count()
    if not n:
        return cells.spark.createDataFrame([], f"id {kind}, other {kind}, w double")
    blocks = cells.blocks()
    if cells.blocks_are_cheaper(sampled(asked, n), n, blocks, max(1, -(-n * blocks.count // cells.n))):
        found = outside_in_blocks(Blocks(members.select("id", "v", "core", "comp"), unit=False, extra=("core", "comp")), Blocks(asked.select("id", "v", "core", "comp"), unit=False, extra=("core", "comp")))
        return found.groupBy("id").agg(F.min(F.struct("w", "other")).alias("e")).select("id", "e.other", "e.w")
    found = cells.meet(cells.visited(asked), best, f"id {kind}, other {kind}, w double", members)
    return found.groupBy("id").agg(F.min(F.struct("w", "other")).alias("e")).select("id", "e.other", "e.w")


def outside_in_blocks(rows: Blocks, asked: Blocks) -> DataFrame:
    """id, other, w: for each asked row the lightest edge to another component in each block. Both hold core and comp."""

    def best(a, x, b, y, same):
        import pyarrow as pa

        order = np.argsort(np.array(b.column("id").to_pylist(), object), kind="stable")
        b, y = b.take(pa.array(order)), y[order]
        number: dict = {}
        comp, comps = (np.array([number.setdefault(c, len(number)) for c in t.column("comp").to_pylist()]) for t in (a, b))
        core, cores = a.column("core").to_numpy(), b.column("core").to_numpy()
        least, place = np.full(len(x), np.inf), np.zeros(len(x), int)
        for at in range(0, len(x), TILE_ROWS):
            mine = slice(at, at + TILE_ROWS)
            for to in range(0, len(y), TILE_COLUMNS):
                their = slice(to, to + TILE_COLUMNS)
                w = np.maximum(np.maximum(distances(x[mine], y[their]), core[mine, None]), cores[None, their])
                w[comp[mine, None] == comps[None, their]] = np.inf
                top = w.argmin(1)
                low = w[np.arange(len(w)), top]
                less = low < least[mine]
                least[mine][less] = low[less]
                place[mine][less] = top[less] + to
        keep = np.isfinite(least)
        return pa.table({"id": a.column("id").filter(pa.array(keep)), "other": b.column("id").take(pa.array(place[keep])), "w": least[keep]})

    return rows.meet(best, f"id {rows.kind}, other {rows.kind}, w double", asked)


def spanning_tree(cells: Cells, near: DataFrame, core: DataFrame) -> DataFrame:
    """a, b, w: a minimum spanning tree by mutual reachability. near: nearest_others with at least min_samples neighbours."""
    spark, n = cells.spark, cells.n
    own, other = core.select(F.col("id"), F.col("core").alias("__c1")), core.select(F.col("id").alias("other"), F.col("core").alias("__c2"))
    weighed = near.join(own, "id").join(other, "other").select("id", "other", "distance", F.greatest("distance", "__c1", "__c2").alias("w"))
    edges = staged(spark, weighed.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w").distinct(), "edges")
    last = near.groupBy("id").agg(F.max("distance").alias("far"), F.count("*").alias("k"))
    rows = cells.rows.select("id", "v", "cell", "part").join(core, "id", "left").join(last, "id", "left")
    limit = F.when(F.coalesce("k", F.lit(0)) >= n - 1, F.lit(float("inf"))).otherwise(F.coalesce(F.greatest("far", "core"), F.lit(0.0)))
    rows = staged(spark, rows.select("id", "v", "cell", "part", F.coalesce("core", F.lit(0.0)).alias("core"), limit.alias("limit")), "members")
    comp = staged(spark, rows.select("id", F.col("id").alias("comp")), "comp")
    tree = None
    while True:
        c1, c2 = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        edges = staged(spark, edges.join(c1, "a").join(c2, "b").where("ca <> cb").select("a", "b", "w", "ca", "cb"), "edges")
        ends = edges.select(F.explode(F.array("ca", "cb")).alias("comp"), edge("w", "a", "b").alias("e"))
        best = ends.groupBy("comp").agg(F.min("e").alias("e"))
        known = rows.join(comp, "id")
        least = known.groupBy("comp").agg(F.min("limit").alias("least"))
        open_ = staged(spark, least.join(best, "comp", "left").where("e is null or e.w > least").select("comp", F.col("e.w").alias("w")), "open")
        if not open_.isEmpty():
            if comp.select("comp").distinct().limit(2).count() < 2:
                break
            found = search_open(cells, staged(spark, known, "known"), open_)
            edges = staged(spark, edges.select("a", "b", "w", "ca", "cb").unionByName(found.join(c1, "a").join(c2, "b").select("a", "b", "w", "ca", "cb")).distinct(), "edges")
            ends = edges.select(F.explode(F.array("ca", "cb")).alias("comp"), edge("w", "a", "b").alias("e"))
            best = ends.groupBy("comp").agg(F.min("e").alias("e"))
        picked = staged(spark, best.select("e.a", "e.b", "e.w").distinct(), "picked")
        if picked.isEmpty():
            break
        tree = picked if tree is None else tree.unionByName(picked)
        joined = components(picked.join(c1, "a").join(c2, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = joined.select(F.col("node").alias("comp"), F.col("component").alias("now"))
        comp = staged(spark, comp.join(moved, "comp", "left").select("id", F.coalesce("now", "comp").alias("comp")), "comp")
        edges = edges.select("a", "b", "w")
    if tree is None:
        return spark.createDataFrame([], f"a {cells.kind}, b {cells.kind}, w double")
    return staged(spark, tree.distinct(), "tree")


def search_open(cells: Cells, known: DataFrame, open_: DataFrame) -> DataFrame:
    """a, b, w: edges among which is the lightest one that leaves each open component. First one row a component without a listed edge
    searches, then all rows that may have a lighter edge, as far as that reaches."""
    members = known.select("id", "v", "cell", "part", "core", "comp")
    asked = known.join(open_, "comp").where("w is null or limit < w")
    blind = asked.where("w is null")
    first = blind.groupBy("comp").agg(F.min_by(F.struct("id", "v", "core"), F.struct("limit", "id")).alias("r")).select("r.*", "comp", F.lit(None).cast("double").alias("reach"))
    scouts = staged(cells.spark, nearest_outside(cells, first, members), "scouts") if not blind.isEmpty() else None
    if scouts is not None:
        bound = scouts.join(known.select("id", "comp"), "id").groupBy("comp").agg(F.min("w").alias("__u"))
        asked = asked.join(bound, "comp", "left").withColumn("w", F.coalesce("w", "__u")).drop("__u").where("w is null or limit <= w")
    found = nearest_outside(cells, asked.select("id", "v", "core", "comp", F.col("w").alias("reach")), members)
    found = found if scouts is None else found.unionByName(scouts)
    return staged(cells.spark, found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w").distinct(), "found")


def small_sides(tree: DataFrame, size: int) -> DataFrame:
    """For each end of each tree edge: e (w, a, b), node, side (the rows on this side that lighter edges join, where they are fewer than size; else null).

    Lighter edges are followed for size - 1 steps at most; of a row only its size - 1 lightest matter.
    """
    spark = tree.sparkSession
    both = tree.select(F.col("a").alias("u"), F.col("b").alias("v"), edge("w", "a", "b").alias("e")).unionByName(tree.select(F.col("b").alias("u"), F.col("a").alias("v"), edge("w", "a", "b").alias("e")))
    w = Window.partitionBy("u").orderBy("e")
    light = staged(spark, both.withColumn("__n", F.row_number().over(w)).where(F.col("__n") < size + 1).select(F.col("u").alias("__u"), F.col("v").alias("__v"), F.col("e").alias("__e")), "light")
    state = both.select("e", F.col("u").alias("node"), F.array("u").alias("side"), F.array("u").alias("fresh"))
    for _ in range(size - 1):
        grown = state.withColumn("__f", F.explode_outer("fresh")).join(light, (F.col("__f") == F.col("__u")) & (F.col("__e") < F.col("e")), "left")
        grown = grown.groupBy("e", "node").agg(F.first("side").alias("side"), F.array_distinct(F.collect_list("__v")).alias("more"))
        # A side of `size` rows needs no more steps.
        grown = grown.withColumn("fresh", F.when(F.size("side") < size, F.array_except("more", "side")).otherwise(F.slice("side", 1, 0)))
        state = staged(spark, grown.select("e", "node", F.slice(F.concat("side", "fresh"), 1, size).alias("side"), "fresh"), "sides")
    return state.select("e", "node", F.when(F.size("side") < size, F.col("side")).alias("side"))


class Hierarchy:
    """Clusters by number: the leaves (in order of their ids), then one for each split. parent (-1: none), born: density at which it arose from its parent."""

    def __init__(self, leaves: list, splits: list[tuple]):
        """splits: ((w, a, b), leaf, leaf), in the edges' order."""
        self.leaves = {leaf: i for i, leaf in enumerate(leaves)}
        top = list(range(len(leaves)))
        self.parent, self.born = [-1] * len(leaves), [0.0] * len(leaves)
        self.edge = [None] * len(leaves)  # where the cluster comes together

        def root(i):
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for e, a, b in splits:
            i, j, new = root(self.leaves[a]), root(self.leaves[b]), len(self.parent)
            self.parent += [-1]
            self.born += [0.0]
            self.edge += [e]
            top.append(new)
            for k in (i, j):
                self.parent[k], self.born[k], top[k] = new, 1 / max(e[0], TINY), new

    def finder(self):
        """find(leaf numbers, edges): of each leaf the cluster it lies in as the edge comes, by steps of powers of two towards the root."""
        first, ups = len(self.leaves), [np.array(self.parent)]
        while (ups[-1] >= 0).any():
            ups.append(np.where(ups[-1] >= 0, ups[-1][ups[-1]], -1))
        splits = self.edge[first:]
        weights = np.array([e[0] for e in splits])

        def find(leaf: np.ndarray, edges: list[tuple]) -> np.ndarray:
            w = np.array([e[0] for e in edges])
            lo, hi = np.searchsorted(weights, w, "left"), np.searchsorted(weights, w, "right")
            before = np.array([bisect_left(splits, e, i, j) if i < j else i for e, i, j in zip(edges, lo.tolist(), hi.tolist(), strict=True)], np.int64)
            for up in reversed(ups):
                nxt = up[leaf]
                leaf = np.where((nxt >= 0) & (nxt - first < before), nxt, leaf)
            return leaf

        return find

    def stabilities(self, left: dict[int, tuple[float, int]]) -> list[float]:
        """left: cluster -> (sum of the densities at which rows left it, their number)."""
        n, sums = [0] * len(self.parent), [0.0] * len(self.parent)
        for c, (total, count) in left.items():
            sums[c] += total
            n[c] += count
        for c in range(len(self.parent)):  # children come before parents
            if (p := self.parent[c]) >= 0:
                sums[p] += n[c] * self.born[c]
                n[p] += n[c]
        return [s - k * b for s, k, b in zip(sums, n, self.born, strict=True)]

    def chosen(self, left: dict[int, tuple[float, int]]) -> list[int]:
        """Of each cluster the chosen one that it lies in, or -1. Roots are not chosen."""
        own = self.stabilities(left)
        below, pick = defaultdict(float), [False] * len(self.parent)
        for c, p in enumerate(self.parent):
            if p >= 0:
                pick[c] = c not in below or own[c] >= below[c]
                below[p] += max(own[c], below.get(c, 0.0))
        out = [-1] * len(self.parent)
        for c in reversed(range(len(self.parent))):
            p = self.parent[c]
            out[c] = out[p] if p >= 0 and out[p] >= 0 else c if pick[c] else -1
        return out


def hierarchy_labels(tree: DataFrame, rows: DataFrame, min_cluster_size: int) -> DataFrame:
    """rows (id): id, label. The label is the smallest id among the smallest cluster's rows; -1 for noise where ids are numbers, else null."""
    spark = tree.sparkSession
    shared_folder(spark)  # components checkpoints
    sides = small_sides(tree, min_cluster_size).groupBy("e").agg(F.collect_list(F.struct("node", "side")).alias("s"))
    sides = staged(spark, sides.select("e", F.col("s")[0].alias("p"), F.col("s")[1].alias("q")), "sides")
    is_split = F.col("p.side").isNull() & F.col("q.side").isNull()
    within = sides.where(~is_split).select("e.a", "e.b")
    leaf = components(within).select(F.col("node").alias("id"), F.col("component").alias("leaf"))
    leaf = staged(spark, rows.select("id").join(leaf, "id", "left").withColumn("leaf", F.coalesce("leaf", "id")), "leaves")
    # Where a row's component becomes a cluster: the first edge that joins its side to a cluster, or makes one.
    n = lambda c: F.size(F.col(c))
    p, q = F.col("p.side"), F.col("q.side")
    joins = F.when(p.isNull(), q).when(q.isNull(), p).when(n("p.side") + n("q.side") >= min_cluster_size, F.concat(p, q))
    left = sides.where(~is_split).select("e", F.explode(joins).alias("id"))
    ends = lambda c, name: leaf.select(F.col("id").alias(c), F.col("leaf").alias(name))
    splits = sides.where(is_split).select("e.*").join(ends("a", "la"), "a").join(ends("b", "lb"), "b")
    taken = [((r["w"], r["a"], r["b"]), r["la"], r["lb"]) for r in splits.orderBy("w", "a", "b").collect()]  # below n / min_cluster_size
    if not taken:
        return rows.select("id", F.lit(-1).alias("label"))
    tree_of = Hierarchy(sorted({x for _, a, b in taken for x in (a, b)}), taken)
    number = spark.createDataFrame(list(tree_of.leaves.items()), f"leaf {dict(rows.dtypes)['id']}, number int")
    cast = spark.sparkContext.broadcast((tree_of.parent, tree_of.edge, len(tree_of.leaves)))  # below 2 n / min_cluster_size

    @F.arrow_udf("int")
    def cluster_at(leaf, e):
        import pyarrow as pa

        held = Hierarchy.__new__(Hierarchy)
        held.parent, held.edge, held.leaves = *cast.value[:2], range(cast.value[2])
        return pa.array(held.finder()(leaf.to_numpy(), list(zip(*[e.field(c).to_pylist() for c in ("w", "a", "b")], strict=True))), pa.int32())

    gone = staged(spark, left.join(leaf, "id").join(number, "leaf").select("id", F.greatest("e.w", F.lit(TINY)).alias("w"), cluster_at("number", "e").alias("cluster")), "left")
    sums = {r["cluster"]: (r["d"], r["n"]) for r in gone.groupBy("cluster").agg(F.sum(1 / F.col("w")).alias("d"), F.count("*").alias("n")).collect()}
    chosen = spark.createDataFrame(list(enumerate(tree_of.chosen(sums))), "cluster int, pick int")
    named = gone.join(chosen, "cluster").where("pick >= 0")
    label = named.groupBy("pick").agg(F.min("id").alias("label"))
    got = named.join(label, "pick").select("id", "label")
    return rows.select("id").join(got, "id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def hdbscan(points: DataFrame, key: str, vector_col: str = "embedding", min_cluster_size: int = 5, min_samples: int = 3) -> DataFrame:
    """key, label: the smallest key of the row's cluster, or -1 (noise). Keys are whole numbers of 0 or more; vectors have one length.

    Fewer rows than two clusters need are all noise, as is a table that falls into no two clusters.
    """
    spark = points.sparkSession
    rows = points.select(F.col(key).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    cells = Cells(rows)
    if cells.n < max(2, min_cluster_size):
        return rows.select(F.col("id").alias(key), F.lit(-1).cast(cells.kind).alias("label"))
    samples = min(min_samples, min_cluster_size)
    near = staged(spark, nearest_others(cells, max(samples, LISTED)), "near")
    tree = spanning_tree(cells, near, core_distances(near, samples))
    done = hierarchy_labels(tree, cells.rows.select("id"), min_cluster_size)
    return done.select(F.col("id").alias(key), F.col("label").cast(cells.kind).alias("label"))
