"""Layout of vectors in few dimensions from a fuzzy neighbour graph (UMAP).

1. The nearest neighbours of each row by cosine or Euclidean distance, exact (`cells`).
2. Membership weights: a row's distances are measured from its nearest neighbour and scaled so that its weights sum to
   log2 of their number; the two directions of an edge are joined by fuzzy union, a + b - ab.
3. A start from principal components, then ROUNDS rounds of gradient descent. In a round each block of rows (some
   cells, or parts of large ones) is moved by one task through its share of the epochs: edges pull,
   NEGATIVES rows for each edge push, drawn from the block and from a bounded sample of all rows. Rows of other blocks stand
   where the round found them, and come anew in the next round, which is one join along the edges.
4. `place` puts new rows among placed ones: a weighted mean of their neighbours, then the same steps.

All draws depend on the seed, the round and the block, so a layout is the same each time. Rows are distinct by
id. Neighbours beyond the number of other rows do not exist; of one row the place is the origin.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.operators.cells import Cells, nearest_others, unit_rows
from lumenarc.operators.graph import principal_components
from lumenarc.operators.vector_index import matrix_of
from lumenarc.sources.store import staged

NEIGHBOURS, MIN_DISTANCE, SPREAD = 15, 0.1, 1.0
ROUNDS, EPOCHS, NEGATIVES = 10, 200, 5
#: Rows of the sample that pushes all blocks, the longest pull or push of a coordinate, and the share of a step that is taken:
#: all edges of a row pull at once and rows of other blocks stand still, so that whole steps would go too far.
PUSHERS, LONGEST, DAMPING = 2000, 4.0, 0.2
#: Rows of a block, about.
BLOCK_ROWS = 4096


def curve(min_distance: float = MIN_DISTANCE, spread: float = SPREAD) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^2b), the smooth form of membership by distance in the layout, by Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_distance, 1.0, np.exp(-(x - min_distance) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        power = x ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        j = np.stack([-power * f**2, -2 * p[0] * power * np.log(x) * f**2], 1)
        step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f), rcond=None)[0]
        p = np.maximum(p + step, 1e-3)
        if np.abs(step).max() < 1e-10:
            break
    return float(p[0]), float(p[1])


def memberships(d: np.ndarray) -> np.ndarray:
    """Weights of each row's sorted neighbour distances (inf: none): exp(-(d - nearest) / scale), scale by bisection so that they sum to log2(k)."""
    k = np.isfinite(d).sum(1)
    rho = np.where(k > 0, np.where((d > 0) & np.isfinite(d), d, np.inf).min(1), 0.0)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    over = np.maximum(np.where(np.isfinite(d), d, np.inf) - rho[:, None], 0)
    target = np.log2(np.maximum(k, 2))
    lo, hi = np.zeros(len(d)), np.full(len(d), np.inf)
    scale = np.ones(len(d))
    for _ in range(64):
        got = np.exp(-over / scale[:, None]).sum(1)
        hi, lo = np.where(got > target, scale, hi), np.where(got > target, lo, scale)
        scale = np.where(np.isfinite(hi), (lo + hi) / 2, 2 * scale)
    mean = np.where(np.isfinite(d), d, 0).sum(1) / np.maximum(k, 1)
    scale = np.maximum(scale, 1e-3 * np.maximum(mean, 1e-12))
    return np.where(np.isfinite(d), np.exp(-over / scale[:, None]), 0.0)


def weighted(near: DataFrame) -> DataFrame:
    """nearest_others as id, other, w: memberships in one direction."""
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "other"))).alias("n"))  # k entries

    @F.arrow_udf("array<double>")
    def weights(d):
        import pyarrow as pa

        rows = d.to_pylist()
        wide = np.full((len(rows), max(map(len, rows), default=0)), np.inf)
        for i, r in enumerate(rows):
            wide[i, : len(r)] = r
        return pa.array([list(w[: len(r)]) for w, r in zip(memberships(wide), rows, strict=True)], pa.list_(pa.float64()))

    w = lists.withColumn("w", weights(F.transform("n", lambda x: x["distance"])))
    return w.select("id", F.explode(F.arrays_zip(F.transform("n", lambda x: x["other"]).alias("other"), F.col("w").alias("w"))).alias("e")).select("id", "e.other", "e.w")


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """id, other, w in both directions: the fuzzy union of either row's memberships."""
    one = weighted(near)
    both = one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "w"))
    joined = both.groupBy("id", "other").agg((1 - F.product(1 - F.col("w"))).alias("w"))
    return joined.where("w > 0")


def descend(own: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, around: np.ndarray, pushers: np.ndarray, a: float, b: float, epochs: range, total: int, seed: int) -> np.ndarray:
    """Moves `own` through some of `total` epochs. Edges head -> tail; tails from len(own) on are rows of `around`, which stand still."""
    rng = np.random.default_rng(seed)
    own, n = own.copy(), len(own)
    share = w / max(w.max(), 1e-12) if len(w) else w
    fixed = np.concatenate([around, pushers])
    for epoch in epochs:
        rate = 1 - epoch / total
        used = rng.random(len(w)) < share  # an edge is followed as often as its weight asks
        h, t = head[used], tail[used]
        places = np.concatenate([own, fixed])
        step = np.zeros_like(own)
        d = own[h] - places[t]
        r = (d**2).sum(1)
        pull = np.where(r > 0, -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * r**b), 0)
        np.add.at(step, h, np.clip(pull[:, None] * d, -LONGEST, LONGEST))
        h = np.repeat(h, NEGATIVES)
        choice = np.concatenate([np.arange(n), n + len(around) + np.arange(len(pushers))])
        t = choice[rng.integers(0, len(choice), len(h))]
        d = own[h] - places[t]
        r = (d**2).sum(1)
        push = np.where(t == h, 0, 2 * b / ((0.001 + r) * (1 + a * r**b)))
        np.add.at(step, h, np.clip(push[:, None] * d, -LONGEST, LONGEST))
        own += DAMPING * rate * step
    return own


def one_round(places: DataFrame, edges: DataFrame, dims: int, a: float, b: float, epochs: range, total: int, seed: int, kind: str) -> DataFrame:
    """places: id, block, at. edges: id, other, w."""
    spark = places.sparkSession
    pushers = places.select("at", F.xxhash64(F.lit(seed), F.lit(epochs.start), "id").alias("h"), "id").orderBy("h", "id").limit(PUSHERS).select("at").toArrow()
    push = spark.sparkContext.broadcast(matrix_of(pushers.column("at").combine_chunks(), dims))  # PUSHERS rows
    there = places.select(F.col("id").alias("other"), F.col("at").alias("__at"))
    lists = edges.join(there, "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "w", F.col("__at").alias("at")))).alias("n"))
    ready = places.join(lists, "id", "left")

    def run(table):
        import pyarrow as pa

        table = table.take(np.argsort(np.array(table.column("id").to_pylist(), object), kind="stable"))
        ids = table.column("id").to_pylist()
        place = {i: k for k, i in enumerate(ids)}
        head, tail, w, around = [], [], [], []
        for k, near in enumerate(table.column("n").to_pylist()):
            for e in near or ():
                head.append(k)
                w.append(e["w"])
                if e["other"] in place:
                    tail.append(place[e["other"]])
                else:
                    tail.append(len(ids) + len(around))
                    around.append(e["at"])
        own = matrix_of(table.column("at").combine_chunks(), dims)
        block = str(table.column("block")[0].as_py())
        draw = zlib.crc32(f"{seed}/{epochs.start}/{block}".encode())
        moved = descend(own, np.array(head, np.int64), np.array(tail, np.int64), np.array(w, float), np.array(around, float).reshape(len(around), dims), push.value, a, b, epochs, total, draw)
        return pa.table({"id": table.column("id"), "block": table.column("block"), "at": pa.array(moved.tolist(), pa.list_(pa.float64()))})

    return ready.select("id", "block", "at", "n").groupBy("block").applyInArrow(run, f"id {kind}, block string, at array<double>")


def as_rows(vectors: DataFrame, key: str, vector_col: str, metric: str) -> DataFrame:
    if metric == "cosine":
        return unit_rows(vectors, key, vector_col)
    return vectors.select(F.col(key).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")


class Layout:
    """A layout that has been made: rows (id, at), and what `place` needs to put others among them."""

    def __init__(self, rows: DataFrame, cells: Cells, neighbours: int, metric: str, dims: int, a: float, b: float, seed: int):
        self.rows, self.cells, self.neighbours, self.metric, self.dims, self.a, self.b, self.seed = rows, cells, neighbours, metric, dims, a, b, seed

    def place(self, vectors: DataFrame, key: str, vector_col: str = "embedding", epochs: int = 30) -> DataFrame:
        """key, at of new rows; the placed ones stay."""
        asked = as_rows(vectors, key, vector_col, self.metric)
        near = nearest_others(self.cells, self.neighbours, asked, themselves=True)
        edges = weighted(near).join(self.rows.select(F.col("id").alias("other"), "at"), "other")
        lists = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "w", "at"))).alias("n"))
        a, b, dims, seed = self.a, self.b, self.dims, self.seed

        @F.arrow_udf("array<double>")
        def put(n):
            import pyarrow as pa

            out = []
            for near in n.to_pylist():
                w, at = np.array([e["w"] for e in near]), np.array([e["at"] for e in near])
                start = (w[:, None] * at).sum(0, keepdims=True) / w.sum()
                out.append(descend(start, np.zeros(len(w), np.int64), 1 + np.arange(len(w)), w, at, np.zeros((0, dims)), a, b, range(epochs), epochs, seed)[0].tolist())
            return pa.array(out, pa.list_(pa.float64()))

        return lists.select(F.col("id").alias(key), put("n").alias("at"))


def reduce_dimensions(vectors: DataFrame, key: str, vector_col: str = "embedding", dims: int = 2, neighbours: int = NEIGHBOURS, min_distance: float = MIN_DISTANCE, metric: str = "cosine", seed: int = 42, epochs: int = EPOCHS, rounds: int = ROUNDS) -> Layout:
    """Rows without a vector (cosine: without a direction) are left out."""
    spark = vectors.sparkSession
    cells = Cells(as_rows(vectors, key, vector_col, metric))
    a, b = curve(min_distance)
    if cells.n < 2:
        rows = cells.rows.select("id", F.array_repeat(F.lit(0.0), dims).alias("at"))
        return Layout(rows, cells, 0, metric, dims, a, b, seed)
    k = min(neighbours, cells.n - 1)
    edges = staged(spark, fuzzy_graph(staged(spark, nearest_others(cells, k), "near")), "edges")
    start = principal_components(cells.rows.select("id", "v"), "id", "v", min(dims, cells.pivots.shape[1]))
    widest = start.agg(F.max(F.array_max(F.transform("p", lambda c: F.abs(c))))).first()[0] or 1.0
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 20)) / (1 << 20) - 0.5) * 0.001
    at = F.array(*[F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) * (10.0 / widest) + noise(i) for i in range(dims)])
    block = F.concat_ws("/", F.floor(F.col("cell") / -(-len(cells.pivots) // -(-cells.n // BLOCK_ROWS))), "part")
    places = staged(spark, cells.rows.select("id", block.alias("block")).join(start.select("id", at.alias("at")), "id"), "places")
    for r in range(rounds):
        places = staged(spark, one_round(places, edges, dims, a, b, range(epochs * r // rounds, epochs * (r + 1) // rounds), epochs, seed, cells.kind), "places")
    return Layout(places.select("id", "at"), cells, k, metric, dims, a, b, seed)


def trustworthiness(near: DataFrame, placed: DataFrame, n: int, k: int) -> float:
    """How far the k nearest rows of a layout are near in truth: 1 less the ranks beyond k. near: true ranks of all others (id, other, rank); placed: the layout's."""
    wrong = placed.where(F.col("rank") <= k).join(near.select("id", "other", F.col("rank").alias("true")), ["id", "other"]).where(F.col("true") > k)
    total = wrong.agg(F.coalesce(F.sum(F.col("true") - k), F.lit(0))).first()[0]
    return 1 - 2 * total / (n * k * (2 * n - 3 * k - 1))
