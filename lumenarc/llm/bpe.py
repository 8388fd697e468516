"""Operator 1: byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match proposes tokens for each distinct word. A proposal is right when every token
is reachable and every adjacent pair is compatible, that is, BPE on the two tokens' bytes would not
merge across their border; all pairs of a batch are tested at once on arrays. Only words with a
failing pair are merged exactly, lowest rank first.

Nulls encode to no tokens (and decode to the empty text). Texts are whole, of any length; repeated
rows and extra columns are kept. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import bounded_batches, drop_caches, worker_cache

#: Fixed values of the vocabulary's format: how its pre-tokenizer cuts words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks whose ids a worker keeps between tasks (about 250 bytes each). The first seen stay, among
#: them the frequent ones; what comes beyond is kept for its batch. Fewer cost time, more memory.
CACHE_CHUNKS = 1_000_000
#: After a batch with a longer text the cache starts anew, since its chunks may be huge.
LONG_CHARS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The format writes bytes as letters: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one tokenizer file. Tokens are handled by rank: bytes first, then merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        as_bytes = {t: bytes(letters[c] for c in t) for t in vocab}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = {a + b for a, b in merges}
        base = sorted((t for t in vocab if t not in made), key=vocab.__getitem__)
        order = base + [a + b for a, b in merges]
        rank = {t: i for i, t in enumerate(order)}
        n = len(order)
        self.n, self.n_base = n, len(base)
        self.ids = np.array([vocab[t] for t in order], np.uint32)
        self.left, self.right = np.arange(n), np.arange(n)
        pairs = np.empty(len(merges), np.int64)
        self.merge_of = {}
        for i, (a, b) in enumerate(merges):
            c = rank[a + b]
            self.left[c], self.right[c] = rank[a], rank[b]
            pairs[i] = rank[a] * n + rank[b]
            self.merge_of[rank[a], rank[b]] = c
        at = np.argsort(pairs)
        self.pair_keys, self.pair_to = pairs[at], (at + self.n_base)
        self.tokens = {as_bytes[t]: i for i, t in enumerate(order)}
        self.byte_rank = [self.tokens[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}
        for t in self.tokens:
            self.longest[t[:3]] = max(self.longest.get(t[:3], 0), len(t))
        self.piece = {int(vocab[t]): as_bytes[t] for t in vocab} | {i: t.encode() for t, i in self.special.items()}
        merged = np.arange(self.n_base, n)
        sound = np.ones(n, bool)
        sound[merged] = self.compatible(self.left[merged], self.right[merged], merged)
        for c in range(self.n_base, n):
            sound[c] &= sound[self.left[c]] and sound[self.right[c]]
        self.sound = sound

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Per pair: no merge across the border would come before the merges that hide it.

        The later made of the two border tokens is taken apart, again and again; a crossing merge
        counts if it ranks under the merge just undone (at equal rank the left one goes first).
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40) if limit is None else limit.astype(np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crosses = (self.pair_keys[at] == key) & (self.pair_to[at] < limit[live])
            ok[live[crosses]] = False
            go = ~crosses & ((x >= self.n_base) | (y >= self.n_base))
            live, x, y = live[go], x[go], y[go]
            undo_left = x > y
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        out, i, end, get, longest = [], 0, len(word), self.tokens.get, self.longest
        while i < end:
            j = min(end, i + (longest.get(word[i : i + 3]) or 2))
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: lowest rank first, leftmost among equals; a heap over a linked list."""
        tok = [self.byte_rank[b] for b in word]
        n, of = len(tok), self.merge_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, i + 1) for i in range(n - 1) if (c := of.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            c, i, j = heapq.heappop(heap)
            if tok[i] < 0 or j >= n or tok[j] < 0 or after[i] != j or of.get((tok[i], tok[j])) != c:
                continue
            tok[i], tok[j] = c, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (d := of.get((c, tok[k]))) is not None:
                    heapq.heappush(heap, (d, i, k))
            if (h := before[i]) >= 0 and (d := of.get((tok[h], c))) is not None:
                heapq.heappush(heap, (d, h, i))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ranks of each word: proposals at once, one compatibility test over all pairs, exact merging of the rest."""
        if not words:
            return []
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for w in out for t in w), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(out)), sizes)
        bad = np.zeros(len(out), bool)
        bad[word_of[~self.sound[flat]]] = True
        inner = word_of[:-1] == word_of[1:]
        pairs, back = np.unique(flat[:-1][inner] * self.n + flat[1:][inner], return_inverse=True)
        ok = self.compatible(pairs // self.n, pairs % self.n)
        bad[word_of[:-1][inner][~ok[back]]] = True
        for i in np.nonzero(bad)[0]:
            out[i] = self.merge(words[i])
        return out


class SpeculativeWords:
    """words -> little-endian uint32 ids, by the vocabulary above."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.special = self.vocabulary.special

    def __call__(self, words: list[str]) -> list[bytes]:
        ids = self.vocabulary.ids
        return [ids[w].tobytes() for w in self.vocabulary.encode_words([w.encode() for w in words])]


class Numbered(dict):
    """Chunk -> number, given on first sight; `new` holds those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class ChunkEncoder:
    """Texts -> id bytes, one encoding per distinct word.

    A space before a character that is no white space always starts a word, so texts are cut there
    into chunks; a chunk's ids do not depend on what surrounds it. Unknown chunks are cut into words
    by WORD_PATTERN and the unknown words are encoded together by `encode_words`.
    """

    def __init__(self, encode_words, special: dict[str, int]):
        import re

        import regex

        self.encode_words, self.special = encode_words, special
        self.words = regex.compile(WORD_PATTERN).findall
        self.plain = re.compile(r"( ?[^\W\d_]+)([.,!?;:]*)").fullmatch
        self.spaces, self.cut = re.compile(r"\s \s").search, re.compile(r" (?=\S)").split
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.reset()

    def cut_back(self, most: int) -> None:
        """Keeps the first `most` chunks."""
        while len(self.later) > most:
            self.later.popitem()
        del self.later_ids[most:]

    def reset(self):
        self.first, self.later = Numbered(), Numbered()  # a text's first chunk; the others, without their space
        self.first_ids, self.later_ids, self.word_ids = [], [], {}

    def cut_words(self, chunk: str):
        m = self.plain(chunk)
        return ((m[1], m[2]) if m[2] else (chunk,)) if m else self.words(chunk)

    def learn(self) -> None:
        """Appends the ids of new chunks. A word that begins with a space is kept as the chunk without it."""
        later, first, later_ids, others = self.later, self.first, self.later_ids, self.word_ids
        known = len(later_ids)
        cut = [self.cut_words(" " + c) for c in later.new]
        cut_first = [self.cut_words(c) for c in first.new]
        fresh = set()
        for w in {w for ws in (*cut, *cut_first) for w in ws}:
            if w[0] == " ":
                if later[w[1:]] >= known:
                    fresh.add(w)
            elif w not in others:
                fresh.add(w)
        cut += [(" " + c,) for c in later.new[len(cut) :]]  # words first seen inside a chunk
        words = list(fresh)
        got = dict(zip(words, self.encode_words(words), strict=True))
        others.update((w, b) for w, b in got.items() if w[0] != " ")
        find = lambda w: got.get(w) or (later_ids[later[w[1:]]] if w[0] == " " else others[w])
        self.first_ids.extend(b"".join(map(find, ws)) for ws in cut_first)
        later_ids.extend([b"".join(map(find, ws)) for ws in cut])
        later.new, first.new = [], []

    def encode(self, texts: list[str | None], keep: int = CACHE_CHUNKS) -> list[bytes]:
        """Texts of one bounded batch."""
        if len(self.first) + len(self.word_ids) > keep // 4 or self.later.new or self.first.new:
            self.reset()
        first, later, plan = self.first, self.later.__getitem__, []
        for t in texts:
            row = []
            for p in self.marks(t) if self.marks and t and any(m in t for m in self.special) else [t or ""]:
                if p in self.special:
                    row.append(self.special[p])
                elif p:
                    parts = self.cut(p) if self.spaces(p) else p.split(" ")
                    row.append((first[parts[0]], list(map(later, parts[1:]))))
            plan.append(row)
        self.learn()
        first_ids, later_ids = self.first_ids, self.later_ids.__getitem__
        out = [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else first_ids[p[0]] + b"".join(map(later_ids, p[1])) for p in row]) for row in plan]
        if max(map(len, (t or "" for t in texts)), default=0) > LONG_CHARS:  # may have brought huge chunks
            self.reset()
        self.cut_back(keep)
        return out


@lru_cache(4)
def vocabulary_encoder(path: str) -> ChunkEncoder:
    words = SpeculativeWords(path)
    return ChunkEncoder(words, words.special)


def piece_table(path: str) -> dict[int, bytes]:
    return vocabulary_encoder(path).encode_words.vocabulary.piece


worker_cache("bpe", vocabulary_encoder.cache_clear)


def batches(values, most_bytes: int = 8 << 20):
    """Runs of texts of bounded size; one longer text stands alone."""
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v or "")
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_column(text: Column, path: str | None = None, keep: int = CACHE_CHUNKS) -> Column:
    """Token ids of a text column, as little-endian unsigned 32-bit integers in one binary value."""
    path = path or default_path()

    @F.arrow_udf("binary")
    def encode(texts):
        import pyarrow as pa

        drop_caches(but="bpe")
        encoder = vocabulary_encoder(path)
        return pa.array([ids for held in batches(x.as_py() for x in texts) for ids in encoder.encode(held, keep)], pa.binary())

    return encode(text)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The text of ids made by encode_column; bytes that are no UTF-8 become U+FFFD."""
    path = path or default_path()

    @F.arrow_udf("string")
    def decode(values):
        import pyarrow as pa

        piece = piece_table(path).__getitem__
        return pa.array([b"".join(map(piece, np.frombuffer(v.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace") for v in values], pa.string())

    return decode(ids)


def round_trip_column(text: Column, path: str | None = None, keep: int = CACHE_CHUNKS) -> Column:
    """A struct: the ids, and whether they decode to the text's bytes."""
    path = path or default_path()

    @F.arrow_udf("ids binary, same boolean")
    def both(texts):
        import pyarrow as pa

        drop_caches(but="bpe")
        encoder, piece = vocabulary_encoder(path), piece_table(path).__getitem__
        ids, same = [], []
        for held in batches((x.as_py() for x in texts), 2 << 20):
            for t, x in zip(held, encoder.encode(held, keep), strict=True):
                ids.append(x)
                same.append(b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) == (t or "").encode())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=["ids", "same"])

    return both(text)


def bpe_encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, keep: int = CACHE_CHUNKS) -> DataFrame:
    """keep: chunks a worker keeps; fewer where other operators share its executor's memory."""
    bounded_batches(df.sparkSession)
    return df.withColumn(ids_col, encode_column(F.col(text_col), path, keep))


def bpe_decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    return df.withColumn(text_col, decode_column(F.col(ids_col), path))


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from those ids."""
    ids = bpe_encode(docs.select("doc_id", "text"), path=path).drop("text")
    both = bpe_decode(ids, path=path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
