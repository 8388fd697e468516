"""Operator 9: exact removal of repeated passages by suffix arrays built in two stages.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else. The corpus is far larger
than one suffix array, so:

1. Anchors. In each LENGTH-byte window the rightmost smallest K-byte hash is an anchor (winnowing):
   equal windows have equal anchors at equal offsets. About one byte in a hundred is an anchor; its
   context is all bytes that a window around it can hold.
2. Anchors whose hash occurs once repeat nothing. Equal contexts (anchor hash and a 64-bit XXH3 of the
   bytes) that occur twice are repeated whole; this settles the inside of copies and of shared passages,
   and no text moves for it.
3. Left are distinct contexts of one anchor: the ends of repeats. One text of each is fetched; groups
   meet in blocks of bounded size, where a suffix array is built: suffixes smaller than their
   successors are sorted directly, the others are induced by one scan over the buckets, and common
   prefixes of neighbours, compared byte by byte, of LENGTH bytes or more mark repeats. Only suffixes
   that long, and those that induce them, are sorted.
4. An anchor with more contexts than GROUP would outgrow a block; its windows are counted by their XXH3
   and alignment instead (equal windows hold the anchor at equal offsets). A task settles what repeats
   among its own windows and sends one of each kind on, packed by the part that all windows around the
   same bytes go to, so that a passage in very many texts is no hot key.

Null is the empty text. Texts are compared whole, as UTF-8 bytes, and matches never cross documents. Rows of
equal text are occurrences of their own, whatever their doc_id. An empty table gives an empty result. All
other columns are kept; n_bytes, n_removed, n_spans and kept replace columns of these names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import Bloom, Scratch, bounded_batches, drop_caches, staged, text_key

LENGTH, K = 400, 200
#: Most contexts of an anchor in a block, and bytes of a block.
GROUP, BLOCK_BYTES = 200, 256 << 10
#: Windows that a task packs at once, windows to a part, and parts of an anchor's alignments that may go to different parts.
PACK_WINDOWS, PART_WINDOWS, STEPS = 1 << 19, 1 << 20, 8
_rng = np.random.default_rng(5)
_value = _rng.integers(0, 1 << 63, 257, np.uint64) * np.uint64(2) + np.uint64(1)
_base = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """base ** i and its inverse ** i modulo 2 ** 64, for i < n at least."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = 1 << max(16, int(n).bit_length())
    with np.errstate(over="ignore"):
        up = np.full(size, _base, np.uint64)
        down = np.full(size, np.uint64(pow(int(_base), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        have = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    if size <= 1 << 22:
        _powers[:] = have
    return have


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-byte strings. They choose anchors and group contexts; no match rests on them."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_value[data] * up[: len(data)], out=sums[1:])
        return mixed((sums[k:] - sums[:-k]) * down[: len(sums) - k])


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the position of its rightmost smallest one."""
    n = len(h) - w + 1
    rows = -(-len(h) // w)
    padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = h
    blocks = padded.reshape(rows, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    # The minima of consecutive windows change rarely; a window's rightmost minimum is the last position of that value inside it.
    edges = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [n]])
    out = np.empty(n, np.int64)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        at = np.flatnonzero(h[s : e + w - 1] == low[s]) + s
        if len(at) == 1:
            out[s:e] = at[0]
        else:
            p = np.arange(s, e) + w - 1
            out[s:e] = at[np.searchsorted(at, p, side="right") - 1]
    return out


def anchors(raw: bytes, length: int = LENGTH, k: int = K):
    """Positions, hashes and context hashes of a text's anchors."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none, none, none
    import xxhash

    data = np.frombuffer(raw, np.uint8)
    h = gram_hashes(data, k)
    pos = np.unique(window_minima(h, length - k + 1))
    start, end = context(pos, len(data), length, k)
    hash_ = xxhash.xxh3_64_intdigest
    c = np.fromiter((hash_(raw[s:e], p - s) for p, s, e in zip(pos.tolist(), start.tolist(), end.tolist(), strict=True)), np.uint64, len(pos))
    return pos, h[pos].view(np.int64), c.view(np.int64)


def context(pos: np.ndarray, n: int, length: int = LENGTH, k: int = K):
    return np.maximum(pos - (length - k), 0), np.minimum(pos + length, n)


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (the last one is larger than the empty one)."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes, by two-stage sorting.

    With `wanted` (a mask) only those suffixes are sorted, and the ones from which they are induced: a
    larger suffix needs its successors up to the next smaller one.
    """
    n, raw = len(t), t.tobytes()
    smaller = suffix_types(t)
    if wanted is None:
        wanted = np.ones(n, bool)
    else:
        stop = np.where(smaller, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]  # the next smaller suffix, itself included
        need = np.zeros(n + 2, np.int64)
        at = np.flatnonzero(wanted)
        np.add.at(need, at, 1)
        np.add.at(need, np.minimum(stop[at], n - 1) + 1, -1)
        wanted = np.cumsum(need)[:n] > 0
    direct = np.array(sorted(np.flatnonzero(smaller & wanted).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    first = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        buckets[t[n - 1]].append(np.array([n - 1]))
    induced = wanted & ~smaller
    out = []

    def induce(front: np.ndarray, c: int) -> np.ndarray:
        """Puts the larger predecessors of `front` into their buckets; returns those of bucket c."""
        before = front[front > 0] - 1
        before = before[induced[before]]
        letters = t[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.diff(letters)) + 1
        own = before[:0]
        for part in np.split(before, cuts) if len(before) else []:
            if t[part[0]] == c:
                own = part
            else:
                buckets[t[part[0]]].append(part)
        return own

    for c in range(256):
        front = np.concatenate(buckets[c]) if buckets[c] else np.empty(0, np.int64)
        while len(front):
            out.append(front)
            front = induce(front, c)
        own = direct[first[c] : first[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, `depth` at most, each suffix has in common with the one before it in order; all have as many."""
    windows = np.lib.stride_tricks.sliding_window_view(t, depth)
    out = np.empty(max(0, len(order) - 1), np.int64)
    for lo in range(0, len(out), 4096):
        a, b = order[lo : lo + 4097][:-1], order[lo + 1 : lo + 4097]
        unlike = windows[a] != windows[b]
        out[lo : lo + len(a)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), depth)
    return out


def repeated_in_block(texts: list[bytes], places: list[tuple], many: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the offsets where a `length`-byte string starts that the block holds at another place.

    places: (document, offset of the context in it); many: the context stands for several occurrences.
    """
    sizes = np.array([len(x) for x in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    t = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(t)) - begin[owner]
    number: dict = {}
    doc = np.array([number.setdefault(p[0], len(number)) for p in places], np.int64)
    place = doc[owner] * (1 << 40) + np.array([p[1] for p in places], np.int64)[owner] + inside
    whole = inside + length <= sizes[owner]
    order = suffix_array(t, length, whole)
    order = order[whole[order]]
    if not len(order):
        return [np.empty(0, np.int64) for _ in texts]
    run = np.concatenate([[0], np.cumsum(adjacent_prefixes(t, order, length) < length)])
    low, high = np.full(run.max() + 1, 1 << 62), np.full(run.max() + 1, -1)
    np.minimum.at(low, run, place[order])
    np.maximum.at(high, run, place[order])
    multi = np.zeros(len(low), bool)
    multi[run[np.array(many)[owner[order]]]] = True
    hit = np.zeros(len(t), bool)
    hit[order[(low != high)[run] | multi[run]]] = True
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin, sizes, strict=True)]


def spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal covered runs of sorted start offsets."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = np.concatenate([starts[:1], starts[cut + 1]])
    last = np.concatenate([starts[cut], starts[-1:]])
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


RANGES = "h long, c long, s long, e long"


def hit_ranges(rows: np.ndarray, length: int) -> list[np.ndarray]:
    """h, c, s, e of runs of consecutive windows. rows: [h, c, s] of windows that repeat."""
    h, c, s = rows[:, np.lexsort(rows[::-1])]
    cut = np.flatnonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(h) - 1]])
    return [h[first], c[first], s[first], s[last] + length]


def repeated_windows(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows with hashes w that stand for n occurrences each: one of each kind, how often it occurs (2 means more), and the count of each window's kind."""
    _, first, back = np.unique(w, return_index=True, return_inverse=True)
    total = np.minimum(np.bincount(back, n), 2).astype(np.int64)
    return first, total, total[back]


def counted_windows(ends: DataFrame, contexts: int, length: int, k: int) -> DataFrame:
    """Ranges of contexts of one occurrence whose windows occur elsewhere around the same anchor. ends: h, c, m, pos, s, bytes; contexts: their number."""
    import pyarrow as pa

    parts = max(1, contexts * (length - k) // PART_WINDOWS)
    step = -(-(length - k + 1) // STEPS)

    def ranged_rows(rows):
        return hit_ranges(rows, length) if rows.shape[1] else [np.empty(0, np.int64)] * 4

    def pack(batches):
        import xxhash

        drop_caches()
        hash_ = xxhash.xxh3_64_intdigest
        held, size = [], 0

        def packed():
            w, part, h, c, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            first, total, twice = repeated_windows(w, n)
            found = np.ascontiguousarray(np.stack(ranged_rows(np.stack([h, c, s])[:, (twice > 1) & (n == 1)])))
            order = first[np.argsort(part[first], kind="stable")]
            count = total[np.argsort(part[first], kind="stable")]
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            ids, rows = part[order[cuts]], []
            for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                at = order[b:e]
                rows.append(b"".join(x.tobytes() for x in (w[at].view(np.int64), h[at], c[at], s[at], count[b:e])))
            return pa.record_batch([pa.array(ids, pa.int32()), pa.array(rows, pa.binary()), pa.array([found.tobytes()] + [b""] * (len(rows) - 1), pa.binary())], names=["part", "rows", "found"])

        for batch in batches:
            for x in batch.to_pylist():
                raw, at = x["bytes"], x["pos"] - x["s"]
                ahead = np.arange(max(0, at + length - len(raw)), min(at, length - k) + 1)
                if not len(ahead):
                    continue
                salt = x["h"] & 0xFFFFFFFFFFFFFFFF
                w = np.fromiter((hash_(raw[at - a : at - a + length], salt ^ a << 40) for a in ahead.tolist()), np.uint64, len(ahead))
                kinds = ahead // step
                core = {j: hash_(raw[at - j * step : at - j * step + length - step + 1], salt) % parts for j in np.unique(kinds).tolist()}
                each = lambda v, n=len(ahead): np.full(n, v, np.int64)
                held.append((w, np.array([core[j] for j in kinds.tolist()]), each(x["h"]), each(x["c"]), -ahead, each(min(x["m"], 2))))
                size += len(ahead)
                if size >= PACK_WINDOWS:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    def meet(batches):
        part, held = None, []

        def close():
            w, h, c, s, n = np.concatenate([np.frombuffer(b, np.int64).reshape(5, -1) for b in held], axis=1)
            _, _, twice = repeated_windows(w, n)
            return pa.record_batch([pa.array(x) for x in ranged_rows(np.stack([h, c, s])[:, (twice > 1) & (n == 1)])], names=["h", "c", "s", "e"])

        for batch in batches:
            for p, rows, found in zip(*(batch.column(x).to_pylist() for x in ("part", "rows", "found")), strict=True):
                if p != part:
                    if held:
                        yield close()
                    part, held = p, []
                held.append(rows)
                if found:
                    yield pa.record_batch([pa.array(x) for x in np.frombuffer(found, np.int64).reshape(4, -1)], names=["h", "c", "s", "e"])
        if held:
            yield close()

    dealt = ends.mapInArrow(pack, "part int, rows binary, found binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, RANGES)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """k1, k2 (text_key), spans array<struct<s, e>>: per distinct text the byte ranges to remove, merged and in order."""
    import pyarrow as pa

    spark = bounded_batches(docs.sparkSession)
    early, scratch = Scratch(spark), Scratch(spark)

    def find(rows):
        drop_caches()
        for batch in rows:
            cols = [[], [], [], [], [], []]
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                pos, h, c = anchors(raw, length, k)
                if len(pos):
                    for col, v in zip(cols, (k1, k2, len(raw), pos, h, c), strict=True):
                        col.append(v)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["k1", "k2", "n", "pos", "h", "c"])

    k1, k2 = text_key(F.col(text_col))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    found = early.put(keyed.mapInArrow(find, "k1 long, k2 long, n long, pos array<long>, h array<long>, c array<long>"), "anchors")
    each = found.select("k1", "k2", "n", F.explode(F.arrays_zip("pos", "h", "c")).alias("a")).select("k1", "k2", "n", "a.pos", "a.h", "a.c")
    counted = found.select(F.explode(F.arrays_zip("h", "c")).alias("a")).select("a.h", "a.c").groupBy("h").agg(F.count("*").alias("occ"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    shared = early.put(counted.where("occ > 1").select("h", (F.col("c0") == F.col("c1")).alias("one")), "shared")
    held = scratch.put(each.where(Bloom(shared, F.col("h"), hashed=True).may_contain(F.col("h"))).join(shared, "h"), "held")
    early.drop()
    contexts = scratch.put(held.groupBy("h", "c").agg(F.first("one").alias("one"), F.count("*").alias("m"), F.min(F.struct("k1", "k2", "pos", "n")).alias("rep")), "contexts")
    left = F.least(F.col("rep.pos"), F.lit(length - k))
    right = F.least(F.col("rep.n") - F.col("rep.pos"), F.lit(length))
    whole = contexts.where((F.col("m") > 1) & (left + right >= length)).select("h", "c", (-left).alias("s"), right.alias("e"))

    # One text for each context whose anchor has others.
    open_ = contexts.where("not one").select("h", "c", "m", "rep.*")
    crowds = scratch.put(open_.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > group), "crowds")
    n_hot = crowds.agg(F.sum("size")).first()[0] or 0
    want = F.struct("h", "c", "m", F.col("size").isNotNull().alias("hot"), "pos")
    wanted = scratch.put(open_.join(crowds, "h", "left").groupBy("k1", "k2").agg(F.collect_list(want).alias("want")), "wanted")
    near = keyed.where(Bloom(wanted, F.col("k1"), hashed=True).may_contain(F.col("k1")))
    texts = near.groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def cut(rows):
        for batch in rows:
            out = []
            for k1, k2, text, want in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist(), batch.column("want").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in want:
                    s, e = max(w["pos"] - (length - k), 0), min(w["pos"] + length, len(raw))
                    if e - s >= length:
                        out.append((w["h"], w["c"], w["m"], w["hot"], k1, k2, w["pos"], s, raw[s:e]))
                    if len(out) >= 4000:
                        yield packed(out)
                        out = []
            if out:
                yield packed(out)

    schema = "h long, c long, m long, hot boolean, k1 long, k2 long, pos long, s long, bytes binary"

    def packed(rows):
        kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 4 + [pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    ends = scratch.put(texts.join(wanted, ["k1", "k2"]).mapInArrow(cut, schema), "ends")

    def sort_blocks(rows):
        held, size, last = [], 0, None

        def close():
            many = [x["m"] > 1 for x in held]
            got = repeated_in_block([x["bytes"] for x in held], [((x["k1"], x["k2"]), x["s"]) for x in held], many, length)
            out = [(x["h"], x["c"], s - (x["pos"] - x["s"]), e - (x["pos"] - x["s"])) for x, starts, m in zip(held, got, many, strict=True) if not m for s, e in spans(starts, length)]
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["h", "c", "s", "e"])

        for batch in rows:
            for x in batch.to_pylist():
                if x["h"] != last and size >= BLOCK_BYTES:
                    yield close()
                    held, size = [], 0
                last = x["h"]
                held.append(x)
                size += len(x["bytes"])
        if held:
            yield close()

    blocks = ends.where("not hot").repartition("h").sortWithinPartitions("h", "c")
    ranges = whole.unionByName(blocks.mapInArrow(sort_blocks, RANGES))
    if n_hot:
        ranges = ranges.unionByName(counted_windows(ends.where("hot"), n_hot, length, k))
    ranges = scratch.put(ranges, "ranges")
    placed = held.join(ranges, ["h", "c"]).select("k1", "k2", (F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e")).distinct()
    listed = placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    listed = staged(spark, listed, "spans")
    scratch.drop()
    return listed


def remove_spans(raw: bytes, found: list[dict] | None) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs, what is left."""
    out, at, removed, runs = [], 0, 0, 0
    end = None
    for x in found or []:
        s, e = x["s"], x["e"]
        if end is None or s > end:
            if end is not None:
                at = end
            out.append(raw[at:s])
            runs += 1
            removed += e - s
            end = e
        elif e > end:
            removed += e - end
            end = e
    out.append(raw[end if end is not None else 0 :])
    return removed, runs, b"".join(out)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and `kept` (binary: the bytes left, which may cut a character)."""
    import pyarrow as pa

    found = repeated_spans(docs, text_col, length)
    k1, k2 = text_key(F.col(text_col))
    rows = docs.withColumn("__k1", k1)
    flagged = rows.withColumn("__maybe", Bloom(found, F.col("k1")).may_contain(F.col("__k1")))
    raw = F.coalesce(text_col, F.lit("")).cast("binary")

    @F.arrow_udf("n_removed long, n_spans long, kept binary")
    def cut(texts, lists):
        got = [remove_spans(t.as_py(), s.as_py()) for t, s in zip(texts, lists, strict=True)]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["n_removed", "n_spans", "kept"])

    joined = flagged.where("__maybe").withColumn("__k2", k2).join(found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans")), ["__k1", "__k2"], "left")
    done = joined.withColumn("__cut", cut(raw, F.col("__spans"))).drop("__spans", "__k2")
    zero = F.lit(0).cast("long")
    plain = flagged.where("not __maybe").withColumn("__cut", F.struct(zero.alias("n_removed"), zero.alias("n_spans"), raw.alias("kept")))
    return done.unionByName(plain).withColumns({"n_bytes": F.octet_length(raw).cast("long"), "n_removed": F.col("__cut.n_removed"), "n_spans": F.col("__cut.n_spans"), "kept": F.col("__cut.kept")}).drop("__cut", "__maybe", "__k1")


def repeats_report(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """For tests: every window counted."""
    raws = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        starts = np.array([i for i in range(len(r) - length + 1) if count[r[i : i + length]] > 1], np.int64)
        gone, runs, kept = remove_spans(r, [{"s": s, "e": e} for s, e in spans(starts, length)])
        out.append((len(r), gone, runs, hashlib.sha256(kept).hexdigest()))
    return out
