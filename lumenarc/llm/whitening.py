"""Operator 11: whitening of embeddings from an exact integer scatter matrix.

An entry c becomes the integer x = floor(1024 c) + 100000. Tasks subtract a whole-number shift from x,
multiply in 64-bit integers where no sum can overflow, else in Python integers, and send their sums
and cross-products as limbs of 32 bits. Spark adds limbs; the driver puts them together to integers of
any size and forms M = n XᵀX - SSᵀ, which no shift changes. Only then M becomes floating point (scaled
by a power of four, should it be too large) and eigh decomposes it. As M = n² V, a row's place on component u is
(n x - S)·u / sqrt(eigenvalue of M), with n x - S again in integers.

The driver holds d (d + 1) / 2 numbers for d dimensions, whatever the rows. Whitened rows are staged once
(8 numbers each), and the mean and covariance of what was staged give identity_error.

Dropped are null vectors, those with null or non-finite entries, and those whose length is not the most
frequent one (of equally frequent lengths the smaller; empty vectors never count). Components whose eigenvalue is
zero to double precision do not exist: equal vectors, a single vector or an empty table give no rows, and of d
dimensions at most d components come. An exact deviation beyond a long is null in `deviation`;
`deviation_text` always holds it. Repeated rows and null ids are rows like others. Only the id and the
vector are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import bounded_batches, drop_caches, staged

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Below this magnitude a product of two entries fits 62 bits.
SMALL = 1 << 31
LIMB = 32


def usable(vector: Column) -> Column:
    """Not null, and all entries there and finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(c: np.ndarray, shift: int = 0) -> np.ndarray:
    """floor(1024 c) + 100000 - shift of doubles: int64 where entries are below SMALL, else Python integers."""
    big = np.abs(c) >= (SMALL - OFFSET - abs(shift)) / SCALE
    if not big.any():
        return np.floor(SCALE * c).astype(np.int64) + (OFFSET - shift)
    exact = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v))
    return np.array([[exact(v) + OFFSET - shift for v in row] for row in c.tolist()], object).reshape(c.shape)


def blocks(batches: Iterator, d: int, names: list[str]) -> Iterator[tuple[list, np.ndarray]]:
    """Other columns and the matrix of the vectors of each Arrow batch."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            flat = pc.list_flatten(batch.column("__v")).to_numpy(zero_copy_only=False)
            yield [batch.column(n) for n in names], flat.reshape(batch.num_rows, d)


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Signed numbers as limbs of LIMB bits with the number's sign, the lowest first."""
    out, left, sign = [], np.abs(values.astype(object)), np.where(values < 0, -1, 1).astype(object)
    while not out or left.any():
        out.append(((left & ((1 << LIMB) - 1)) * sign).astype(np.int64))
        left = left >> LIMB
    return out


def partial_scatter(d: int, shift: int):
    """One task's sums (j = -1) and cross-products (i <= j) of the shifted vectors, by limbs."""
    upper = np.triu_indices(d)

    def run(batches):
        import pyarrow as pa

        drop_caches()
        sums, cross, n = np.zeros(d, object), np.zeros(len(upper[0]), object), 0
        for _, c in blocks(batches, d, []):
            y = whole(c, shift)
            n += len(y)
            if y.dtype == object:
                sums, cross = sums + y.sum(axis=0), cross + (y.T @ y)[upper]
                continue
            step = max(1, (1 << 62) // max(1, int(np.abs(y).max()) ** 2))
            for k in range(0, len(y), step):
                part = y[k : k + step]
                sums, cross = sums + part.sum(axis=0), cross + (part.T @ part)[upper]
        if not n:
            return
        rows = np.concatenate([[-1], np.arange(d), upper[0]]), np.concatenate([[-1], np.full(d, -1), upper[1]])
        for k, limb in enumerate(limbs(np.concatenate([np.array([n], object), sums, cross]))):
            some = limb != 0
            yield pa.record_batch([pa.array(rows[0][some], pa.int32()), pa.array(rows[1][some], pa.int32()), pa.array(np.full(int(some.sum()), k), pa.int32()), pa.array(limb[some], pa.int64())], names=["i", "j", "k", "v"])

    return run


class Scatter:
    """n, S and M = n XᵀX - SSᵀ of all vectors as Python integers."""

    def __init__(self, vectors: DataFrame, d: int, shift: int = OFFSET):
        """vectors: __v, array<double> of length d without nulls."""
        parts = vectors.select("__v").mapInArrow(partial_scatter(d, shift), "i int, j int, k int, v long")
        self.n, t, y = 0, np.zeros(d, object), np.zeros((d, d), object)
        for r in parts.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():  # of the order of d² rows
            v = int(r["v"]) << (LIMB * r["k"])
            if r["i"] < 0:
                self.n += v
            elif r["j"] < 0:
                t[r["i"]] += v
            else:
                y[r["i"], r["j"]] += v
        y = y + np.triu(y, 1).T
        self.sums = t + shift * self.n
        self.matrix = self.n * y - np.outer(t, t)


class Whitener:
    """Components of a scatter matrix: rows of `axes` give whitened values of n x - S; `explained` are shares of the trace."""

    def __init__(self, scatter: Scatter, components: int = COMPONENTS):
        m, d = scatter.matrix, len(scatter.sums)
        bits = max((int(abs(v)).bit_length() for v in m.flat), default=0)
        self.halves = max(0, bits - 900 + 1) // 2  # M is divided by 4^halves, n x - S by 2^halves
        unit = 1 << (2 * self.halves)
        scaled = np.array([[int(v) / unit for v in row] for row in m], float).reshape(d, d)
        values, vectors = np.linalg.eigh(scaled)
        values, vectors = values[::-1], vectors[:, ::-1]
        real = values > max(d, 1) * np.finfo(float).eps * max(values[0], 0) if d else values
        k = min(components, int(real.sum()))
        trace = sum(int(m[i, i]) for i in range(d))
        self.n, self.sums = scatter.n, [int(s) for s in scatter.sums]
        self.axes = (vectors[:, :k] / np.sqrt(values[:k])).T
        self.explained = [float(v) * unit / trace if self.halves == 0 else float(v) / (trace / unit) for v in values[:k]]
        self.eigenvalues = [float(v) / self.n**2 * unit if self.halves == 0 else float(v) for v in values[:k]]

    def apply(self, c: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened values [row, component] and exact deviations of vectors of doubles."""
        x = whole(c)
        sums = np.array(self.sums, object)
        most = max(int(np.abs(x).max()), 1) * self.n + max(map(abs, self.sums))
        if x.dtype != object and most < 1 << 62:
            y = x * np.int64(self.n) - sums.astype(np.int64)
            width = max(1, int(np.abs(y).max()))
            exact = y if width**2 * y.shape[1] < 1 << 62 else y.astype(object)
        else:
            exact = y = x.astype(object) * self.n - sums
        deviations = [int(v) for v in (exact * exact).sum(axis=1)]
        near = y.astype(float) if y.dtype != object else np.array([[int(v) / (1 << self.halves) for v in row] for row in y], float)
        return near @ self.axes.T, deviations


def fit_list(df: DataFrame, vector_col: str, *keep: Column) -> tuple[DataFrame, int]:
    """The rows that count, as __v (doubles) and `keep`; and their dimension."""
    rows = df.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0))
    sizes = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size(vector_col) == d).select(*keep, F.col(vector_col).cast("array<double>").alias("__v")), d


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """None where no vector can be used or all are equal."""
    bounded_batches(df.sparkSession)
    rows, d = fit_list(df, vector_col)
    if not d:
        return None
    model = Whitener(Scatter(rows, d), components)
    return model if len(model.axes) else None


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitener | None]:
    """id, whitened (array, a number a component), deviation_text, n of every vector that counts; and what was fitted."""
    spark = bounded_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, whitened array<double>, deviation_text string, n long"
    rows, d = fit_list(df, vector_col, F.col(id_col))
    model = Whitener(Scatter(rows, d), components) if d else None
    if model is None or not len(model.axes):
        return spark.createDataFrame([], schema), None

    def run(batches):
        import pyarrow as pa

        drop_caches()
        for (ids,), c in blocks(batches, d, [id_col]):
            got, deviations = model.apply(c)
            offsets = pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32())
            yield pa.record_batch([ids, pa.ListArray.from_arrays(offsets, pa.array(got.ravel())), pa.array([str(v) for v in deviations]), pa.array(np.full(len(got), model.n, np.int64))], names=[id_col, "whitened", "deviation_text", "n"])

    return rows.mapInArrow(run, schema), model


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of `whitened` (k numbers) less the identity; centred first, divisor n."""
    w = [F.col("whitened")[i] for i in range(k)]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    at = [c - F.lit(means[i]) for i, c in enumerate(w)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = rows.agg(*[F.avg(at[i] * at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, got, strict=True))


def whitening_report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns, a row for each vector and component."""
    spark = embeddings.sparkSession
    names = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"
    done, model = whiten(embeddings)
    if model is None:
        return done.select("vec_id", F.lit(0).alias("component"), "n", F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"), "deviation_text")
    rows = staged(spark, done, "whitened")
    error = identity_error(rows, len(model.axes))
    shares = F.array(*[F.lit(v) for v in model.explained])
    each = rows.select("vec_id", "n", F.expr("try_cast(deviation_text as long)").alias("deviation"), "deviation_text", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("*", (F.col("i") + 1).alias("component"), F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")).select(*names)
