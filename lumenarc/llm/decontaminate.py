"""Operator 10: benchmark decontamination, all substrings within the allowed edit distance.

An item of m characters matches a document if a substring of it is within k = (1 - SIMILARITY) m edits,
rounded down in integers. The search loses none. An item is cut into k + 1 leaves (of five characters, the
last few of four), so that k edits leave a leaf whole; likewise a group of n leaves that is left with at
most n - 1 edits holds a smaller group of which the same is true. So each match holds a group of up to MID
leaves, in it a section of about four and in that a pair of leaves with fewer edits than leaves. A pair
with one edit keeps two of three parts of it whole: seven characters in a row, or its first and last
three, one character nearer or farther apart at most. These seeds are looked up by hash at every place of
the text; pairs, sections and groups are tested by Myers' bit vectors side by side, and what is left is
verified by Myers' algorithm on the whole item, the ends of the window free. White space and words play no part.

The benchmark is read in blocks of bounded size, each carried to all tasks; documents are mapped in
place. Texts are compared in lower case with single spaces. Items that are null or blank match
nothing, equal items match each for itself, null documents match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import bounded_batches, drop_caches, staged

SIMILARITY = 0.8
#: Leaves of a group (its characters fit 64 bits) and of a section, about.
MID, SECTION = 12, 4
#: Starts of candidates are rounded to so many characters.
STEP = 8
#: Ranges of at most so many characters are tested by the groups of the item before it is verified.
LONG = 1500
#: Patterns that are tested side by side.
LANES = 1 << 13
#: Characters of the items that are carried to the tasks at once, and of the texts that are hashed at once.
BLOCK_CHARS, TEXT_CHARS = 1 << 20, 1 << 18
#: Symbols that filters tell apart; the last is no character.
SYMBOLS = 128
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
#: What stands around texts; no character.
_GAP = np.uint32(0xFFFFFFFF)


def normal_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def short(chars: np.ndarray) -> np.ndarray:
    """A symbol for each character; unlike characters may share one, which no filter minds, and what is none is told apart."""
    return np.where(chars < _GAP, chars % np.uint32(SYMBOLS - 1), np.uint32(SYMBOLS - 1)).astype(np.uint8)


def even_parts(n: int, most: int) -> list[tuple[int, int]]:
    """Ranges of nearly equal length that cover n things, `most` at most in each."""
    many = -(-n // most)
    return [(n * p // many, n * (p + 1) // many) for p in range(many)]


def leaf_sizes(m: int, most: int) -> list[int]:
    """most + 1 leaves of an item of m characters, the longer ones first."""
    size = -(-m // (most + 1))
    short_ones = size * (most + 1) - m
    return [size] * (most + 1 - short_ones) + [size - 1] * short_ones


def three_codes(symbols: np.ndarray) -> np.ndarray:
    """Of all windows of three symbols."""
    wide = symbols.astype(np.uint32)
    return wide[:-2] | wide[1:-1] << np.uint32(7) | wide[2:] << np.uint32(14)


def seed_keys(symbols: np.ndarray, threes: np.ndarray, kind: tuple[int, int], n: int) -> np.ndarray:
    """Hashes of the seeds that begin at the first n places. kind: characters in a row, 0; or 3, and how far behind them three more begin."""
    size, apart = kind
    with np.errstate(over="ignore"):
        if apart:
            key = threes[:n] * _ODD[0] + threes[apart : apart + n] * _ODD[1]
        elif size < 3:
            key = (symbols[:n] + symbols[size - 1 : size - 1 + n] * np.uint32(SYMBOLS)) * _ODD[0]
        else:
            key = threes[:n] * _ODD[0] + threes[size - 3 : size - 3 + n] * _ODD[1]
            if size == 7:
                key += symbols[3 : 3 + n] * _ODD[2]
        key ^= key >> np.uint32(15)
        key *= _ODD[3]
    return key


def seeds_of(text: str, cut: int) -> list[tuple[tuple[int, int], int, np.ndarray]]:
    """(kind, place in the text, key) of seeds one of which stands wherever the text stands with one edit, cut being where its two leaves meet; with cut 0, without an edit."""
    n = len(text)
    if cut and n >= 8:
        size = min(7, n - 3)
        asked = [((size, 0), 0), ((size, 0), 3), *(((3, n - 3 + d), 0) for d in (-1, 0, 1))]
    elif cut:
        asked = [((cut, 0), 0), ((n - cut, 0), cut)]
    else:
        asked = [((min(n, 7), 0), 0)]
    symbols = np.concatenate([short(codes(text)), np.zeros(8, np.uint8)])
    out = []
    for (size, apart), at in asked:
        own = symbols[at:].astype(np.uint32) if not apart else np.zeros(apart + 8, np.uint32)
        if apart:
            own[:3], own[apart : apart + 3] = symbols[:3], symbols[n - 3 : n]
        out.append(((size, apart), at, seed_keys(own, three_codes(own), (size, apart), 1)[0]))
    return out


def match_bits(patterns: list[str]) -> np.ndarray:
    """[pattern, symbol]: the places of a pattern that hold the symbol, as bits of 16, 32 or 64."""
    longest = max(map(len, patterns), default=0)
    kind = np.uint16 if longest <= 16 else np.uint32 if longest <= 32 else np.uint64
    out = np.zeros((len(patterns), SYMBOLS), kind)
    for x, p in enumerate(patterns):
        np.bitwise_or.at(out[x], short(codes(p)), kind(1) << np.arange(len(p), dtype=kind))
    return out


def distances(bits: np.ndarray, sizes: np.ndarray, which: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Smallest edit distance of each pattern (bits[which], of sizes[which] characters) to a substring of its text, as symbols: Myers' bit vectors side by side."""
    n, kind = len(which), bits.dtype.type
    one, bits, row = kind(1), bits.ravel(), which * SYMBOLS
    plus, minus = np.full(n, ~kind(0), kind), np.zeros(n, kind)
    top = one << (sizes[which] - 1).astype(kind)
    score = sizes[which].astype(np.int16)
    best = score.copy()
    with np.errstate(over="ignore"):
        for column in np.ascontiguousarray(texts.T):
            eq = bits[row + column]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(xh | plus)
            down = plus & xh
            score += (up & top) != 0
            score -= ((down & top) != 0).view(np.int8)
            up, down = up << one, down << one
            plus = down | ~(xv | up)
            minus = up & xv
            np.minimum(best, score, out=best)
    return best


def edit_search(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to any substring and where that ends, if it is at most `most` (Myers' bit vectors)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(xv | up) & full
        minus = up & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


class Items:
    """One block of the benchmark, ready for search."""

    def __init__(self, rows: list[tuple], similarity: float = SIMILARITY):
        self.ids, self.texts = [], []
        for item_id, text in rows:
            if words := normal_words(text):
                self.ids.append(item_id)
                self.texts.append(" ".join(words))
        loss = 1 - Fraction(str(similarity))
        self.most = [int(len(t) * loss) for t in self.texts]
        sizes = [leaf_sizes(len(t), k) for t, k in zip(self.texts, self.most, strict=True)]
        longest = max((c[0] for c in sizes), default=1)
        if longest > 64:
            raise ValueError(f"similarity {similarity} asks for leaves of more than 64 characters")
        self.group = max(2, min(MID, 64 // longest))
        units, parts, mids, texts = [], [], [], ([], [], [])
        seeds: dict[tuple[int, int], list[tuple[np.ndarray, int, int]]] = defaultdict(list)
        for i, (t, leaves) in enumerate(zip(self.texts, sizes, strict=True)):
            cut = np.cumsum([0, *leaves]).tolist()
            pairs = [*range(0, len(leaves), 2), len(leaves)]  # where pairs of leaves begin; an odd last leaf stands alone
            for g0, g1 in even_parts(len(pairs) - 1, max(1, self.group // 2)):
                lo, hi = pairs[g0], pairs[g1]
                mids.append((i, cut[lo], cut[hi] - cut[lo], hi - lo - 1))
                texts[0].append(t[cut[lo] : cut[hi]])
                for p0, p1 in even_parts(g1 - g0, SECTION // 2):
                    a, b = pairs[g0 + p0], pairs[g0 + p1]
                    parts.append((len(mids) - 1, cut[a] - cut[lo], cut[b] - cut[a], b - a - 1))
                    texts[1].append(t[cut[a] : cut[b]])
                    for x in range(a, b, 2):
                        y = min(x + 2, b)
                        units.append((len(parts) - 1, cut[x] - cut[a], cut[y] - cut[x], y - x - 1))
                        texts[2].append(t[cut[x] : cut[y]])
                        for kind, at, key in seeds_of(texts[2][-1], cut[x + 1] - cut[x] if y - x == 2 else 0):
                            seeds[kind].append((key, len(units) - 1, at))
        self.mid_item, self.mid_start, self.mid_size, self.mid_most = np.array(mids, np.int64).reshape(-1, 4).T
        self.part_mid, self.part_start, self.part_size, self.part_most = np.array(parts, np.int64).reshape(-1, 4).T
        self.unit_part, self.unit_start, self.unit_size, self.unit_most = np.array(units, np.int64).reshape(-1, 4).T
        self.groups, self.parts, self.units = map(match_bits, texts)
        self.tables = []
        for kind, own in sorted(seeds.items()):
            key, unit, at = (np.array(c) for c in zip(*own, strict=True))
            bits = max(16, len(key).bit_length() + 6)
            slot = (key >> np.uint32(32 - bits)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            count = np.bincount(slot, minlength=1 << bits).astype(np.int32)
            first = (np.cumsum(count) - count).astype(np.int32)
            self.tables.append((kind, bits, count > 0, count, first, key[order], unit[order].astype(np.int32), at[order].astype(np.int32)))

    def hits(self, symbols: np.ndarray, lo: int, hi: int):
        """(place, unit): where a seed of the unit stands in lo..hi, the unit's start by it."""
        threes = three_codes(symbols[lo : hi + 128])
        near = symbols[lo : hi + 128].astype(np.uint32)
        for kind, bits, held, count, first, full, unit, at in self.tables:
            key = seed_keys(near, threes, kind, hi - lo)
            slot = key >> np.uint32(32 - bits)
            spots = np.flatnonzero(held[slot]).astype(np.int32)
            slot = slot[spots]
            many, begins = count[slot], first[slot]
            seed = np.arange(int(many.sum()), dtype=np.int32) + np.repeat(begins - (np.cumsum(many, dtype=np.int32) - many), many)
            spot = np.repeat(spots, many)
            ok = full[seed] == key[spot]
            seed, spot = seed[ok], spot[ok]
            yield spot - at[seed] + np.int64(lo), unit[seed]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each item's best match in each text; offsets in the normal text."""
        if not self.texts:
            return []
        normal = [" ".join(normal_words(t)) for t in texts]
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        lo = 0
        while lo < len(normal):
            hi, size = lo + 1, len(normal[lo])
            while hi < len(normal) and size + len(normal[hi]) <= TEXT_CHARS:
                size += len(normal[hi])
                hi += 1
            self.candidates(normal[lo:hi], lo, found)
            lo = hi
        asked = []
        for (d, i), ranges in sorted(found.items()):
            ranges.sort()
            begin, end = ranges[0]
            for b, e in [*ranges[1:], (len(normal[d]) + 1, 0)]:
                if b <= end:
                    end = max(end, e)
                else:
                    asked.append((d, i, begin, end))
                    begin, end = b, e
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (d, i, begin, end), ok in zip(asked, self.groups_agree(normal, asked), strict=True):
            if ok and (hit := edit_search(self.texts[i], normal[d][begin:end], self.most[i])) is not None:
                stop = begin + hit[1]
                one = (hit[0], max(0, stop - len(self.texts[i])), stop)
                if (d, i) not in best or one < best[d, i]:
                    best[d, i] = one
        return [(d, i, *b) for (d, i), b in sorted(best.items())]

    def groups_agree(self, normal: list[str], asked: list[tuple[int, int, int, int]]) -> list[bool]:
        """False where the groups of an item alone, each at its best in the range, take more edits than the item may; long ranges are not asked."""
        out, lanes = [True] * len(asked), []
        for x, (_, i, begin, end) in enumerate(asked):
            lo, hi = np.searchsorted(self.mid_item, [i, i + 1])
            if hi - lo > 1 and end - begin <= LONG:
                lanes.append((x, lo, hi))
        for at in range(0, len(lanes), 256):
            part = lanes[at : at + 256]
            mid = np.concatenate([np.arange(lo, hi) for _, lo, hi in part])
            owner = np.repeat(np.arange(len(part)), [hi - lo for _, lo, hi in part])
            text = np.full((len(part), max(asked[x][3] - asked[x][2] for x, *_ in part)), SYMBOLS - 1, np.uint8)
            for r, (x, *_) in enumerate(part):
                d, _, begin, end = asked[x]
                text[r, : end - begin] = short(codes(normal[d][begin:end]))
            sums = np.bincount(owner, distances(self.groups, self.mid_size, mid, text[owner]), len(part))
            for r, (x, *_) in enumerate(part):
                out[x] = bool(sums[r] <= self.most[asked[x][1]])
        return out

    def candidates(self, texts: list[str], d0: int, found: dict) -> None:
        """Adds, for each text (numbered from d0) and item, the ranges that can hold a match."""
        pad = 256
        gap = np.full(1, _GAP, np.uint32)
        symbols = np.concatenate([np.full(pad, SYMBOLS - 1, np.uint8), short(np.concatenate([x for t in texts for x in (codes(t), gap)])), np.full(pad, SYMBOLS - 1, np.uint8)])
        begins = pad + np.cumsum([0, *(len(t) + 1 for t in texts)])
        rows, places = len(texts), (len(symbols) + pad) // STEP + 1
        stop = int(begins[-1])

        def near_enough(group, start, bits, sizes, most, slack):
            """Which groups are near enough to what stands from start on. slack: how far behind its start a group may begin."""
            across = np.arange(int(sizes.max()) + 2 * int(most.max()) + slack)
            ok = np.zeros(len(group), bool)
            for lo in range(0, len(group), LANES):
                g = group[lo : lo + LANES]
                cut = symbols[np.clip((start[lo : lo + LANES] - most[g])[:, None] + across, 0, len(symbols) - 1)]
                ok[lo : lo + LANES] = distances(bits, sizes, g, cut) <= most[g]
            return ok

        def keyed(group, doc, start):
            return np.unique((group * rows + doc) * places + (start + pad) // STEP)

        def taken(keys):
            group, rest = np.divmod(keys, rows * places)
            doc, place = np.divmod(rest, places)
            return group, doc, place * STEP - pad

        keys = []
        for lo in range(pad, stop, TEXT_CHARS):
            for start, unit in self.hits(symbols, lo, min(stop, lo + TEXT_CHARS)):
                ok = near_enough(unit, start, self.units, self.unit_size, self.unit_most, 1)
                start, unit = start[ok], unit[ok]
                doc = np.searchsorted(begins, start + self.unit_size[unit] // 2, "right") - 1
                keys.append(keyed(self.unit_part[unit], np.clip(doc, 0, rows - 1), start - self.unit_start[unit]))
        part, doc, start = taken(np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
        ok = near_enough(part, start, self.parts, self.part_size, self.part_most, STEP)
        part, doc, start = part[ok], doc[ok], start[ok]
        mid, doc, start = taken(keyed(self.part_mid[part], doc, start - self.part_start[part]))
        ok = near_enough(mid, start, self.groups, self.mid_size, self.mid_most, 2 * STEP)
        for m, d, s in zip(mid[ok].tolist(), doc[ok].tolist(), start[ok].tolist(), strict=True):
            i = int(self.mid_item[m])
            at = s - int(self.mid_start[m]) - int(begins[d])
            found[d0 + d, i].append((max(0, at - self.most[i]), min(len(texts[d]), at + 2 * STEP + len(self.texts[i]) + self.most[i])))


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int | None = None):
    """The number of blocks and, block by block, the benchmark's rows; a block holds about half of `block_chars` (BLOCK_CHARS), and all rows if they fit one."""
    block_chars = block_chars or BLOCK_CHARS
    size = benchmark.agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 16)).first()[0] or 0
    n = 1 if size <= block_chars else -(-size // block_chars) * 2
    part = F.pmod(F.xxhash64(item_col, text_col), F.lit(n))

    def each():
        for b in range(n):
            rows = benchmark.where(part == b).select(item_col, text_col).toArrow()
            yield sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))

    return n, each()


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, keep: list[str] | None = None) -> DataFrame:
    """A row for each document and item that match: the columns `keep` (doc_id), item_id (of the benchmark's type), distance, start, end.

    A benchmark of more than one block is searched block by block, each result staged, so that the driver and the tasks hold one block at a time.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark, keep = bounded_batches(docs.sparkSession), keep or ["doc_id"]
    plain = docs.select(*keep, "text")
    kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(kind)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*keep).schema), f"item_id {kind.simpleString()}", "distance int", "start int", "end int"])

    def searched(block):
        def find(batches):
            drop_caches()
            items = Items(block.value, similarity)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    got = items.search(part.column("text").to_pylist())
                    if got:
                        d, i, dist, s, e = zip(*got, strict=True)
                        at = pa.array(d)
                        cols = [part.column(c).take(at) for c in keep] + [pa.array([items.ids[x] for x in i], item_type), pa.array(dist, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
                        yield pa.record_batch(cols, names=[*keep, "item_id", "distance", "start", "end"])
            del items
            drop_caches()

        return plain.mapInArrow(find, schema)

    n, blocks = benchmark_blocks(benchmark)
    if n == 1:
        return searched(spark.sparkContext.broadcast(next(blocks)))  # BLOCK_CHARS
    out = None
    for rows in blocks:
        block = spark.sparkContext.broadcast(rows)  # BLOCK_CHARS
        found = staged(spark, searched(block), "matches")
        block.destroy()
        out = found if out is None else out.unionByName(found)
    return out
