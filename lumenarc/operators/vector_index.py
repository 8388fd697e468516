"""A persisted inverted-file index over vectors: coarse lists, residual product codes, exact re-ranking.

Training takes a bounded sample (SAMPLE_ROWS rows, those with the smallest hashes of the id) to the driver: k-means
gives the lists' centres, and k-means of the residuals in each block of dimensions gives codebooks of
CODES entries. Every row is then indexed by Spark tasks: its nearest centre (`list`), the distance to it (`gap`)
and a byte a block (`code`). Rows live in a transaction log, partitioned by list, so that a search reads
the folders of the lists it probes and nothing else, and inserts, deletions and replacements are commits.

- `search`: the nearest lists are probed, as many as training measured for the wished recall; codes rank their rows (no vector is read), the best `rerank` x k are
  fetched and ranked by exact distance.
- `search_exact`: an approximate search bounds the k-th distance; by the triangle inequality only rows whose gap
  differs from the query's distance to their centre by no more than this can be nearer. Gaps are filtered at
  the scan, lists beyond the bound are not read. Equal to a full scan, ties by id.
- `search_batch`: queries meet the lists they probe list by list, in parts of PART_ROWS rows at most, so a list of
  any size spans tasks.

Rows with null vectors, vectors of another length or non-finite entries are not indexed (`insert` leaves them out). Columns other
than id and vector are kept and can be filtered before ranking.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.operators.search import squared_distance, vector
from lumenarc.sources.log import TableLog, put_new, read_bytes

SAMPLE_ROWS = 65_536
CODES, BLOCK = 256, 4
ROUNDS = 12
#: Rows of a list that meet queries in one task of a batch search.
PART_ROWS = 65_536
#: Recall of the PROBE_K nearest that the number of probed lists is set for, on PROBE_QUERIES rows of the sample.
TARGET, PROBE_K, PROBE_QUERIES = 0.97, 10, 256
#: Columns that the index adds to rows; users' columns must be named otherwise.
OWN = ("list", "gap", "code")


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, the first of equals; in slices of bounded size."""
    own, out = (centres**2).sum(1), np.empty(len(x), np.int64)
    step = max(1, (1 << 22) // max(1, len(centres)))
    for k in range(0, len(x), step):
        out[k : k + step] = (own - 2 * (x[k : k + step] @ centres.T)).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds; empty ones restart at rows far from their centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].astype(float)
    for _ in range(rounds):
        at = nearest_centre(x, centres)
        counts = np.bincount(at, minlength=k)
        full, order = counts > 0, np.argsort(at, kind="stable")
        centres[full] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[full], axis=0) / counts[full, None]
        if not full.all():
            far = np.argsort(((x - centres[at]) ** 2).sum(1), kind="stable")[::-1]
            centres[~full] = x[far[: int((~full).sum())]]
    return centres


class Codec:
    """Centres of the lists and codebooks of the residuals' blocks."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        edges = np.cumsum([0, *[b.shape[1] for b in books]])
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    @classmethod
    def train(cls, x: np.ndarray, lists: int, block: int = BLOCK) -> Codec:
        centres = k_means(x, lists)
        rest = x - centres[nearest_centre(x, centres)]
        return cls(centres, [k_means(rest[:, a : a + block], CODES) for a in range(0, x.shape[1], block)])

    def probes_for(self, x: np.ndarray, target: float = TARGET) -> int:
        """How many lists hold so large a share of the nearest rows of a query, by the sample's rows among each other.

        Neighbours within a sample are farther than within the whole table, so the whole needs fewer lists, not more.
        """
        queries = x[:: max(1, len(x) // PROBE_QUERIES)][:PROBE_QUERIES]
        at, places = nearest_centre(x, self.centres), []
        for q in queries:
            near = np.argsort(((x - q) ** 2).sum(1), kind="stable")[1 : PROBE_K + 1]
            place = np.empty(len(self.centres), np.int64)
            place[np.argsort(self.to_centres(q), kind="stable")] = np.arange(len(place))
            places += place[at[near]].tolist()
        return int(np.quantile(places, target, method="higher")) + 1 if places else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """list, gap, code [row, block] of vectors."""
        at = nearest_centre(x, self.centres)
        rest = x - self.centres[at]
        codes = np.stack([nearest_centre(rest[:, s], b) for s, b in zip(self.blocks, self.books, strict=True)], 1).astype(np.uint8)
        return at, np.sqrt((rest**2).sum(1)), codes

    def to_centres(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.centres - q) ** 2).sum(1))

    def tables(self, q: np.ndarray, number: int) -> np.ndarray:
        """Squared distances of the query's residual in a list to every code, [block, code]."""
        rest = q - self.centres[number]
        out = np.full((len(self.books), CODES), np.inf)
        for i, (s, b) in enumerate(zip(self.blocks, self.books, strict=True)):
            out[i, : len(b)] = ((b - rest[s]) ** 2).sum(1)
        return out

    def rank(self, q: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of rows of one list."""
        return self.tables(q, number)[np.arange(len(self.books)), codes].sum(1)

    def dump(self) -> bytes:
        return json.dumps({"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books]}).encode()

    @classmethod
    def load(cls, data: bytes) -> Codec:
        held = json.loads(data)
        return cls(np.array(held["centres"], float), [np.array(b, float) for b in held["books"]])


def matrix_of(column, width: int) -> np.ndarray:
    """The vectors of an Arrow list column."""
    import pyarrow.compute as pc

    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def codes_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def merged_notes(notes: list[dict]) -> dict:
    """Rows and widest gap of every list over several folders."""
    out = {"rows": {}, "gap": {}}
    for note in notes:
        for number, n in note["rows"].items():
            out["rows"][number] = out["rows"].get(number, 0) + n
            out["gap"][number] = max(out["gap"].get(number, 0.0), note["gap"][number])
    return out


class VectorIndex:
    """Made by `build`, opened by its folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), TableLog(spark, root)
        self._codec, self._held = None, None

    @property
    def codec(self) -> Codec:
        meta = self.log.state().meta
        if self._held != meta["codec"]:
            self._codec, self._held = Codec.load(read_bytes(self.spark, f"{self.root}/{meta['codec']}")), meta["codec"]
        return self._codec

    @classmethod
    def build(cls, df: DataFrame, root: str, id_col: str, vector_col: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK, target: float = TARGET) -> VectorIndex:
        """lists: about twice the root of the number of rows, as far as the sample has 16 rows for each. target: the recall that searches probe for."""
        spark = df.sparkSession
        clash = sorted({*OWN, "seg"} & set(df.columns))
        if clash:
            raise ValueError(f"columns of these names belong to the index: {', '.join(clash)}")
        index = cls(spark, root)
        v = F.col(vector_col).cast("array<double>")
        fine = df.where(F.size(vector_col) > 0).where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        sizes = fine.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
        if sizes is None:
            raise ValueError("no vector to index")
        d, n = sizes["d"], sizes["n"]
        rows = fine.where(F.size(vector_col) == d)
        key = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
        some = rows.where(key < -(-2 * sample_rows * (1 << 30) // n)) if n > 4 * sample_rows else rows
        sample = some.select(v.alias("v"), key.alias("k"), id_col).orderBy("k", id_col).limit(sample_rows).select("v").toArrow()
        x = matrix_of(sample.column("v").combine_chunks(), d)
        codec = Codec.train(x, max(1, min(lists or math.ceil(2 * math.sqrt(n)), -(-len(x) // 16))), block)
        name = f"codec-{uuid.uuid4().hex}.json"
        put_new(spark, f"{index.root}/{name}", codec.dump())
        index.log.create(index._encoded(rows, codec, vector_col), ["list"], {"codec": name, "id": id_col, "vector": vector_col, "probes": codec.probes_for(x, target)})
        index.insert(rows)
        return index

    def _encoded(self, df: DataFrame, codec: Codec, vector_col: str) -> DataFrame:
        width = codec.centres.shape[1]
        cast = self.spark.sparkContext.broadcast((codec.centres, codec.books))  # bounded by the sample

        @F.arrow_udf("struct<list int, gap double, code binary>")
        def encode(v):
            import pyarrow as pa

            at, gap, codes = Codec(*cast.value).encode(matrix_of(v, width))
            return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(gap), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "gap", "code"])

        return df.withColumn("__e", encode(F.col(vector_col).cast("array<double>"))).select(*df.columns, F.col("__e.list").alias("list"), F.col("__e.gap").alias("gap"), F.col("__e.code").alias("code"))

    def _dealt(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """Encoded rows in files by list: a list's rows meet in one task, larger lists in several. And what the commit notes of them."""
        meta, codec = self.log.state().meta, self.codec
        v, width = F.col(meta["vector"]).cast("array<double>"), codec.centres.shape[1]
        fine = df.where(F.size(meta["vector"]) == width).where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        rows = self._encoded(fine, codec, meta["vector"])
        found = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()  # a row a list
        parts = {r["list"]: -(-r["n"] // PART_ROWS) for r in found}
        notes = {"rows": {str(r["list"]): r["n"] for r in found}, "gap": {str(r["list"]): r["gap"] for r in found}}
        wide = {k: p for k, p in parts.items() if p > 1}
        salt = F.pmod(F.xxhash64(meta["id"]), F.coalesce(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])[F.col("list")], F.lit(1))) if wide else F.lit(0)
        tasks = max(1, min(sum(parts.values()), -(-sum(notes["rows"].values()) // PART_ROWS)))
        return rows.repartition(tasks, "list", salt), notes

    def insert(self, df: DataFrame) -> int:
        rows, notes = self._dealt(df)
        return self.log.append(rows, notes)

    def upsert(self, df: DataFrame, column: str | None = None) -> int:
        """df's rows take the place of those with the same id (or the same values of another column, as a paper's), in one commit."""
        column = column or self.log.state().meta["id"]
        rows, notes = self._dealt(df)
        return self.log.replace(rows, df, column, notes=notes)

    def delete(self, ids: DataFrame, column: str | None = None) -> int:
        return self.log.delete(ids, column or self.log.state().meta["id"])

    def compact(self) -> int:
        return self.log.compact(merged_notes)

    def rows(self) -> DataFrame:
        """What is indexed, as it was given."""
        return self.log.read().drop(*OWN)

    def _probed(self, q: np.ndarray, probes: int | None) -> list[int]:
        probes = probes or self.log.state().meta["probes"]
        return np.argsort(self.codec.to_centres(q), kind="stable")[:probes].tolist()

    def _approximate(self, rows: DataFrame, q: np.ndarray, n: int) -> DataFrame:
        """The n rows whose codes are nearest: id, list. rows: those of the probed lists; only id, list and code are read."""
        meta, codec = self.log.state().meta, self.codec
        own = meta["id"]
        kind = rows.schema[own].dataType.simpleString()
        cast = self.spark.sparkContext.broadcast((codec.centres, codec.books))

        def best(batches):
            import pyarrow as pa

            codec, held = Codec(*cast.value), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, codes = batch.column("list").to_numpy(), codes_of(batch.column("code"))
                near = np.empty(len(at))
                for number in np.unique(at):
                    here = at == number
                    near[here] = codec.rank(q, int(number), codes[here])
                table = pa.table({"id": batch.column("id"), "list": batch.column("list"), "near": near})
                held = table if held is None else pa.concat_tables([held, table])
                if len(held) > n:
                    held = held.take(np.argsort(held.column("near").to_numpy(), kind="stable")[:n])
            if held is not None:
                yield from held.combine_chunks().to_batches()

        found = rows.select(F.col(own).alias("id"), "list", "code").mapInArrow(best, f"id {kind}, list int, near double")
        return found.orderBy("near", "id").limit(n).select("id", "list")

    def _ranked(self, rows: DataFrame, query: list[float], k: int) -> DataFrame:
        meta = self.log.state().meta
        scored = rows.withColumn("distance", squared_distance(F.col(meta["vector"]).cast("array<double>"), vector(query))).drop(meta["vector"], *OWN)
        top = scored.orderBy("distance", meta["id"]).limit(k)
        return top.withColumn("score", 1 / (1 + F.col("distance"))).withColumn("rank", F.row_number().over(Window.orderBy("distance", meta["id"])))

    def search(self, query: list[float], k: int, probes: int | None = None, rerank: int = 20, where: Column | None = None) -> DataFrame:
        """About the k nearest rows that pass `where`: their columns, distance (squared), score, rank."""
        q, own = np.array(query, float), self.log.state().meta["id"]
        rows = self.log.read().where(F.col("list").isin(self._probed(q, probes)))
        rows = rows.where(where) if where is not None else rows
        ids = self._approximate(rows, q, rerank * k).select(F.col("id").alias("__id"), F.col("list").alias("__list"))
        return self._ranked(rows.join(F.broadcast(ids), (F.col(own) == F.col("__id")) & (F.col("list") == F.col("__list")), "left_semi"), query, k)  # rerank x k rows

    def bounded(self, query: list[float], within: float) -> DataFrame:
        """The rows that can lie within this distance: whole lists are left out by their widest gap, rows by their own."""
        state, off = self.log.state(), self.codec.to_centres(np.array(query, float))
        widest = {int(c): gap for c, gap in merged_notes(list(state.notes.values()))["gap"].items()}
        slack = 1e-9 * (1 + within)
        near = {c: float(off[c]) for c, gap in widest.items() if off[c] - gap <= within + slack}
        if not near:
            return self.log.read().where(F.lit(False))
        at = F.create_map(*[F.lit(x) for kv in near.items() for x in kv])[F.col("list")]
        return self.log.read(state=state).where(F.col("list").isin(list(near)) & (F.abs(F.col("gap") - at) <= within + slack))

    def search_exact(self, query: list[float], k: int, where: Column | None = None, probes: int = 4) -> DataFrame:
        """The k nearest rows that pass `where`, as a full scan finds them."""
        first = self.search(query, k, probes, where=where).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
        rows = self.bounded(query, math.sqrt(first["d"])) if first["n"] == k else self.log.read()
        return self._ranked(rows.where(where) if where is not None else rows, query, k)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 20) -> DataFrame:
        """queries (query_id, query): query_id, id, distance, rank of about the k nearest rows of each."""
        state, codec = self.log.state(), self.codec
        meta, width = state.meta, codec.centres.shape[1]
        own, probes = meta["id"], probes or meta["probes"]
        kinds = {"q": dict(queries.dtypes)["query_id"], "id": self.log.read(state=state).schema[own].dataType.simpleString()}
        cast = self.spark.sparkContext.broadcast((codec.centres, codec.books))

        @F.arrow_udf("array<int>")
        def probed(v):
            import pyarrow as pa

            x, centres = matrix_of(v, width), cast.value[0]
            off = (centres**2).sum(1) - 2 * (x @ centres.T)
            return pa.array(np.argsort(off, axis=1, kind="stable")[:, :probes].tolist(), pa.list_(pa.int32()))

        counts = merged_notes(list(state.notes.values()))["rows"]
        wide = {int(c): -(-n // PART_ROWS) for c, n in counts.items() if n > PART_ROWS}
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])[F.col("list")], F.lit(1)) if wide else F.lit(1)
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
        asked = asked.withColumn("list", F.explode(probed("query"))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = self.log.read(state=state).select(F.col(own).alias("id"), F.col(meta["vector"]).cast("array<double>").alias("v"), "list", "code").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))

        def meet(left, right):
            import pyarrow as pa

            codec, out = Codec(*cast.value), {"query_id": [], "id": [], "distance": []}
            if len(left) and len(right):
                number = left.column("list")[0].as_py()
                codes, x, ids = codes_of(right.column("code").combine_chunks()), matrix_of(right.column("v").combine_chunks(), width), right.column("id")
                for i, q in zip(left.column("query_id").to_pylist(), matrix_of(left.column("query").combine_chunks(), width), strict=True):
                    near = np.argsort(codec.rank(q, number, codes), kind="stable")[: rerank * k]
                    exact = ((x[near] - q) ** 2).sum(1)
                    top = np.argsort(exact, kind="stable")[:k]
                    out["query_id"] += [i] * len(top)
                    out["id"] += ids.take(near[top]).to_pylist()
                    out["distance"] += exact[top].tolist()
            return pa.table(out, schema=pa.schema([("query_id", left.schema.field("query_id").type), ("id", right.schema.field("id").type), ("distance", pa.float64())]))

        found = asked.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInArrow(meet, f"query_id {kinds['q']}, id {kinds['id']}, distance double")
        w = Window.partitionBy("query_id").orderBy("distance", "id")  # probes x k rows a query
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, wanted: DataFrame, on: list[str]) -> float:
    """Share of `wanted` that was found."""
    total = wanted.count()
    return wanted.join(found.select(*on), on, "left_semi").count() / total if total else 1.0
