"""Operator 5: token-id files. A zstandard dictionary is trained once on serialized id arrays; each
document is compressed on its own with it, so that one short document is read without its neighbours.

A file holds documents of one doc_id range in ascending order (null first, ties by text hash):

    magic "LTOK1\\n"; sha256 of the dictionary (32 bytes); the frames, one after another;
    index: per document three unsigned 64-bit integers: frame offset, number of ids, row of `keys`;
    keys: JSON list of [doc_id]; tail: index offset, keys offset, number of documents (3 x 8 bytes)

Frames hold the ids as little-endian uint16 when the vocabulary fits, else uint32 (first byte of the
frame's content: 2 or 4). The dictionary lies beside the files as `<sha256>.dict`. Files are written
under a name of their own and renamed, and a range's content depends on its rows alone, so a task that
runs again leaves the same file.

Null and empty texts have the end id only, texts are whole. Ties in doc_id and repeated rows are all written;
a doc_id of more rows than a file holds gets several files. An empty table writes no file.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.bpe import ChunkEncoder, batches, default_path
from lumenarc.llm.common import bounded_sample, drop_caches, new_path, worker_cache

MAGIC = b"LTOK1\n"
END_ID = 0
#: Where rows without a doc_id stand.
NULL_ID = -(1 << 63)
#: The dictionary is trained on so many whole documents and bytes at most, those with the smallest hashes of doc_id.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 2000, 4 << 20, 64 << 10, 1
#: Documents in a file on average, more where that would make more than MOST_FILES files.
FILE_DOCS, MOST_FILES = 8000, 10_000


class LibraryWords:
    """Words -> ids by the tokenizers library; its own pre-tokenizer sees each word again."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}

    def __call__(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


@lru_cache(2)
def library_encoder(path: str) -> ChunkEncoder:
    words = LibraryWords(path)
    return ChunkEncoder(words, words.special)


worker_cache("tokens", library_encoder.cache_clear)


def pack(ids: bytes) -> bytes:
    a = np.frombuffer(ids, "<u4")
    return b"\x04" + ids if len(a) and a.max() > 0xFFFF else b"\x02" + a.astype("<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype("<u4")


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """On a sample of bounded size; where it is too small to train on, the sample itself is the dictionary."""
    import zstandard

    rows = bounded_sample(docs.select("doc_id", "text"), SAMPLE_DOCS, SAMPLE_BYTES, "text", "doc_id", "text").toArrow()
    encoder, samples = library_encoder(path), []
    for held in batches(t.as_py() for t in rows.column("text")):
        samples += [pack(ids) for ids in encoder.encode(held)]
    encoder.reset()
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or b"\x02\x00\x00\x00\x00\x00\x00\x00\x00"


def load_dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


class FileWriter:
    """Writes one file frame by frame; only the index is held in memory. Nothing is seen under its name before close()."""

    def __init__(self, uri: str, digest: bytes):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.aside = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.aside)
        self.out.write(MAGIC + digest)
        self.at, self.offsets, self.sizes, self.keys = len(MAGIC) + 32, [], [], []

    def add(self, key: list, frame: bytes, n: int) -> None:
        self.offsets.append(self.at)
        self.sizes.append(n)
        self.keys.append(key)
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        n = len(self.sizes)
        index = np.array([self.offsets, self.sizes, range(n)], "<u8").T.tobytes()
        self.out.write(index + json.dumps(self.keys).encode() + struct.pack("<3Q", self.at, self.at + len(index), n))
        self.out.close()
        self.fs.move(self.aside, self.path)


class TokenFile:
    """Reads one file; `ids(i)` reads the i-th document's frame alone."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        fs, path = filesystem(uri)
        self.source = fs.open_input_file(path)
        self.size = self.source.size()
        head = self.source.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        self.index_at, names_at, self.n = struct.unpack("<3Q", self.source.read_at(24, self.size - 24))
        self.index = np.frombuffer(self.source.read_at(names_at - self.index_at, self.index_at), "<u8").reshape(-1, 3)
        self.keys = json.loads(self.source.read_at(self.size - 24 - names_at, names_at))
        self.unzip = zstandard.ZstdDecompressor(dict_data=load_dictionary(dictionary)).decompress

    def ids(self, i: int) -> np.ndarray:
        at = int(self.index[i, 0])
        end = int(self.index[i + 1, 0]) if i + 1 < self.n else self.index_at
        return unpack(self.unzip(self.source.read_at(end - at, at)))


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, file_docs: int = FILE_DOCS) -> tuple[str, DataFrame]:
    """Encodes, compresses and writes `docs` (doc_id, text); returns the folder and a manifest (bucket, uri, n_docs, n_ids)."""
    spark = docs.sparkSession
    path, folder = path or default_path(), folder or new_path(spark, "tokens")
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary)
    fs, where = filesystem(f"{folder}/{digest.hexdigest()}.dict")
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # DICT_BYTES
    total = docs.count()
    files = max(1, min(MOST_FILES, -(-total // file_docs)))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    bounds = docs.select(F.percentile_approx(key, [i / files for i in range(1, files)] or [0.5], 10_000).alias("b")).first()["b"] or []
    cuts, shares = np.unique(np.array(bounds, np.int64), return_counts=True)
    # A bound that comes twice or more is a doc_id of as many files' rows: these get files of their own.
    shares = np.where(shares > 1, shares, 0)
    first = np.concatenate([[0], np.cumsum(1 + shares)])

    def compress(rows):
        import pyarrow as pa
        import zstandard

        drop_caches(but="tokens")
        encoder = library_encoder(path)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=load_dictionary(shared.value)).compress
        end = END_ID.to_bytes(4, "little")
        for batch in rows:
            frames, sizes = [], []
            for held in batches(t.as_py() for t in batch.column("text")):
                for ids in encoder.encode(held):
                    frames.append(zip_(pack(ids + end)))
                    sizes.append(len(ids) // 4 + 1)
            key, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt"))
            at = np.searchsorted(cuts, key)
            share = np.where(np.append(cuts, 0)[at] == key, np.append(shares, 0)[at], 0)
            bucket = first[at] + np.where(share > 0, 1 + salt % np.maximum(share, 1), 0)
            yield pa.record_batch([pa.array(bucket, pa.int32()), batch.column("doc_id"), batch.column("tie"), pa.array(frames, pa.binary()), pa.array(sizes, pa.int64())], names=["bucket", "doc_id", "tie", "frame", "n"])

    keyed = docs.select(
        key.alias("key"),
        F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("salt"),
        "doc_id",
        F.xxhash64("text").alias("tie"),
        "text",
    )
    packed = keyed.mapInArrow(compress, "bucket int, doc_id long, tie long, frame binary, n long")
    ranges = packed.repartition(int(first[-1]) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie")

    def write(rows):
        import pyarrow as pa

        digest = hashlib.sha256(shared.value).digest()
        bucket, uri, file = None, None, None

        def close():
            file.close()
            return pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "uri": [uri], "n_docs": pa.array([len(file.sizes)], pa.int64()), "n_ids": pa.array([sum(file.sizes)], pa.int64())})

        for batch in rows:
            for b, k, f, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "frame", "n")), strict=True):
                if b != bucket:
                    if file is not None:
                        yield close()
                    bucket, uri = b, f"{folder}/range-{b:08d}.ltok"
                    file = FileWriter(uri, digest)
                file.add([k], f, n)
        if file is not None:
            yield close()

    manifest = ranges.mapInArrow(write, "bucket int, uri string, n_docs long, n_ids long").toArrow()  # a row for each file
    spark.createDataFrame(manifest, "bucket int, uri string, n_docs long, n_ids long").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema("bucket int, uri string, n_docs long, n_ids long").parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, uint32) of every document, file by file."""
    files = manifest.orderBy("bucket").toArrow().to_pylist()
    start, plan = 0, []
    for f in files:
        plan.append((f["uri"], start))
        start += f["n_ids"]

    def read(rows):
        import pyarrow as pa
        from pyarrow import fs as afs

        fs, where = filesystem(folder)
        (name,) = [f.path for f in fs.get_file_info(afs.FileSelector(where)) if f.path.endswith(".dict")]
        with fs.open_input_stream(name) as f:
            dictionary = f.read()
        for batch in rows:
            for uri, at in zip(batch.column("uri").to_pylist(), batch.column("at").to_pylist(), strict=True):
                file = TokenFile(uri, dictionary)
                for lo in range(0, file.n, 500):
                    here = range(lo, min(file.n, lo + 500))
                    ids = [file.ids(i) for i in here]
                    sizes = np.array([len(x) for x in ids], np.int64)
                    starts = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    yield pa.record_batch([pa.array([file.keys[i][0] for i in here], pa.int64()), pa.array(starts), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    if not plan:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    listed = spark.createDataFrame(plan, "uri string, at long").repartition(len(plan))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame) -> DataFrame:
    folder, manifest = write_token_files(docs.select("doc_id", "text"))
    read = read_token_files(docs.sparkSession, folder, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
