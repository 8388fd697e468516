import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import lines as L
from lumenarc.llm import simhash as S
from lumenarc.llm import suffixes as X
from lumenarc.llm.components import connected_components, forest

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, times):
    words = text.split(" ")
    for _ in range(times):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def near_copies(spark):
    """Copies with one or two changed words of long texts, exact copies, and texts of their own."""
    base = [sentence(300) for _ in range(12)]
    texts = [t for b in base for t in (b, b, edited(b, 1), edited(b, 1), edited(b, 2))] + [sentence(60) for _ in range(40)] + ["", None, "A b", "a B"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute_components(prints, radius):
    fps = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    return forest(len(fps), i, j).tolist()


@pytest.mark.parametrize(("radius", "tile"), [(2, 2048), (5, 16), (6, 16)])
def test_simhash_components_equal_all_pairs(spark, near_copies, radius, tile, monkeypatch):
    monkeypatch.setattr(S.fingerprint_links, "__defaults__", (radius, tile))  # small tiles: classes are split
    rows = near_copies.orderBy("doc_id").collect()
    want = brute_components([S.fingerprint(r["text"]) for r in rows], radius)
    got = {r["doc_id"]: r["component"] for r in S.simhash_components(near_copies, radius=radius).collect()}
    assert [got[r["doc_id"]] for r in rows] == want
    assert len(set(want)) < len(rows)


def test_fingerprint_by_its_definition():
    import xxhash

    text = "The Cat\tsat on\nthe mat THE cat sat"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert S.fingerprint(text) == want
    assert S.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert S.fingerprint("É x") == xxhash.xxh64_intdigest("É x".encode(), 42)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


def test_one_document_of_each_group_stays(near_copies):
    repeated = near_copies.unionByName(near_copies.where("doc_id < 3"))
    comps = {r["doc_id"]: r["component"] for r in S.simhash_components(near_copies).collect()}
    kept = sorted(r["doc_id"] for r in S.keep_one_per_group(repeated).collect())
    assert kept == sorted(set(comps.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*chain, *hub, (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert len(got) == 61 + 300
    assert set(got.values()) == {0, 1000}
    assert connected_components(df.limit(0)).count() == 0


def brute_lines(rows):
    """Kept texts by all pairs of lines."""
    every = [(d, i, L.normal(x)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if len(L.normal(x)) >= L.MIN_CHARS]
    distinct = sorted({x for *_, x in every})
    sets = [{x[k : k + L.SHINGLE] for k in range(max(1, len(x) - L.SHINGLE + 1))} for x in distinct]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (c := len(sets[i] & sets[j])) >= L.SIMILARITY * (len(sets[i]) + len(sets[j]) - c)]
    i, j = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ([], [])))
    root = dict(zip(distinct, forest(len(distinct), i, j).tolist(), strict=True))
    first, gone = {}, set()
    for d, i, x in sorted(every):
        if first.setdefault(root[x], (d, i)) != (d, i):
            gone.add((d, i))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


@pytest.mark.parametrize("chunk", [1000, 3])
def test_lines_equal_all_pairs(spark, chunk, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", chunk)
    base = [sentence(40) for _ in range(8)]
    pool = base * 3 + [edited(b, 1) for b in base for _ in range(4)] + [sentence(30) for _ in range(40)] + ["short", ""]
    rows = [(d, "\n".join(RNG.choice(pool) for _ in range(RNG.randint(1, 8)))) for d in range(60)] + [(60, None), (61, "")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize("chars", [30, 60, 150, 350])
def test_bands_and_marks_recall_pairs_at_the_threshold(chars):
    """Pairs of Jaccard 0.8 to 0.85: nearly all share a band, and their marks never part them."""
    shingles = lambda t: {t[k : k + L.SHINGLE] for k in range(len(t) - L.SHINGLE + 1)}
    pairs = []
    while len(pairs) < 400:
        a, new = ("".join(RNG.choice("etaoinshrdlu ") for _ in range(n)) for n in (chars, round(0.08 * chars)))
        b = a[round(0.1 * chars) :] + new
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs.append((a, b))
    one, two = (L.signatures(list(side)) for side in zip(*pairs, strict=True))
    met = (L.band_hashes(one) == L.band_hashes(two)).any(axis=1) & (L.agreeing(L.marks(one), L.marks(two)) >= L.AGREE)
    assert met.mean() >= 0.98


def test_thinned_lines_stay_linked():
    """A band with many near copies: thinning loses no connection to lines that are similar."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 3, np.uint64)
    mark = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 62, 100).astype(np.uint64)) for b in base])
    line = np.arange(300, dtype=np.int64)
    links = L.candidates_in(np.zeros(300, np.uint64), line, mark)
    root = forest(300, *links)
    assert [len(set(root[i : i + 100])) for i in (0, 100, 200)] == [1, 1, 1]
    assert len(set(root)) == 3


def test_lines_of_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(documents).collect()}
    want = brute_lines(rows)
    assert sum(got[d] != want[d] for d in got) <= 1  # a pair at the threshold may miss all bands


def test_suffix_array_is_sorted():
    for _ in range(200):
        n = RNG.randint(1, 80)
        t = np.array([RNG.randint(0, 2) for _ in range(n)], np.uint8)
        raw = t.tobytes()
        assert X.suffix_array(t, n).tolist() == sorted(range(n), key=lambda i: raw[i:])
        some = np.array([RNG.random() < 0.3 for _ in range(n)])
        assert [i for i in X.suffix_array(t, n, some).tolist() if some[i]] == sorted(np.flatnonzero(some).tolist(), key=lambda i: raw[i:])


@pytest.mark.parametrize("group", [200, 2])
def test_repeats_equal_brute_force(spark, group):
    passage = [sentence(30) for _ in range(5)]
    texts = []
    for i in range(60):
        parts = [sentence(RNG.randint(0, 20)) for _ in range(3)]
        if i % 2:
            p = RNG.choice(passage)
            parts.insert(RNG.randint(0, 3), p[RNG.randint(0, 40) : len(p) - RNG.randint(0, 40)])
        texts.append(" ".join(parts))
    texts += [texts[1], texts[3], None, "", "ab" * 150, "é" * 70, "x" * 39, passage[0] + passage[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["k1"], r["k2"]): [x.asDict() for x in r["spans"]] for r in X.repeated_spans(df, length=40, k=20, group=group).collect()}
    keys = df.select("doc_id", *[c.alias(n) for c, n in zip(X.text_key(F.col("text")), ("k1", "k2"), strict=True)]).collect()
    got = {}
    for r in keys:
        raw = (texts[r["doc_id"]] or "").encode()
        gone, runs, kept = X.remove_spans(raw, found.get((r["k1"], r["k2"])))
        got[r["doc_id"]] = (len(raw), gone, runs, hashlib.sha256(kept).hexdigest())
    assert [got[i] for i in range(len(texts))] == X.brute_force(texts, 40)


def test_repeats_of_documents(documents):
    rows = documents.orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in X.repeats_report(documents).orderBy("doc_id").collect()]
    assert got == X.brute_force([r["text"] for r in rows])


def test_odd_rows(odd, empty):
    n = odd.count()
    assert S.simhash_report(odd).count() == n
    assert X.repeats_report(odd).count() == n
    done = L.dedup_lines(odd)
    assert done.count() == n
    assert done.columns == odd.columns
    assert S.keep_one_per_group(odd).columns == odd.columns
    for run in (S.simhash_report, X.repeats_report, L.line_report, S.keep_one_per_group):
        assert run(empty).count() == 0


def test_lines_with_a_changed_character_or_word_go(spark):
    """Lines of usual length: 60 characters with one changed character, 75 with a changed word."""
    lines = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)).replace(" ", "x") for _ in range(40)]
    typos = [x[:30] + "#" + x[31:] for x in lines]
    words = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(75)) for _ in range(40)]
    changed = [x[:36] + "###" + x[39:] for x in words]
    df = spark.createDataFrame([(0, "\n".join(lines + words)), (1, "\n".join(typos + changed))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in L.line_report(df).collect()}
    assert got[0] == 0
    assert got[1] >= 0.95 * 80


def test_short_repeated_lines_go(spark):
    df = spark.createDataFrame([(0, "Read more\n\nok\nShare this page"), (1, "read more \n\nOK\nsome other words"), (2, "ok\nno")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    assert got == {0: "Read more\n\nok\nShare this page", 1: "\nsome other words", 2: "no"}
