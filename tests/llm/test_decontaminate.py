import random

import pytest

from lumenarc.llm import decontaminate as D

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edit_distance(a, b):
    """Of a to any substring of b, by the table."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_vectors_equal_the_table():
    for _ in range(300):
        a = "".join(RNG.choice("abc") for _ in range(RNG.randint(1, 15)))
        b = "".join(RNG.choice("abc") for _ in range(RNG.randint(0, 25)))
        assert D.edit_search(a, b, len(a))[0] == min(len(a), edit_distance(a, b))


def noisy(text, rate):
    out = []
    for c in text:
        r = RNG.random()
        if r < rate / 3:
            continue
        out.append(RNG.choice("abcdefgh ") if r < rate * 2 / 3 else c + RNG.choice("abcdefgh") if r < rate else c)
    return "".join(out)


@pytest.mark.parametrize(("rate", "recall"), [(0.0, 1.0), (0.06, 0.95), (0.1, 0.9)])
def test_recall_of_edited_items(rate, recall):
    rows = [(i, prose(40)) for i in range(60)]
    items = D.Items(rows)
    texts = [f"{prose(100)} {noisy(t, rate)} {prose(60)}" for _, t in rows * 2]
    found = {(d, i) for d, i, *_ in items.search(texts)}
    assert sum((k, k % 60) in found for k in range(120)) >= recall * 120
    assert all(i == d % 60 for d, i in found)


def test_rows_equal_brute_force_on_documents(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.contamination(documents, bench).collect()}
    norm = lambda t: " ".join(D.normal_words(t))
    want = {(d["doc_id"], b["item_id"]) for b in bench.collect() for d in documents.collect() if norm(b["text"]) in norm(d["text"])}
    assert got == want
    assert want


def test_blocks_of_items_find_the_same(spark, documents, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {tuple(r) for r in D.contamination(documents, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_CHARS", 4000)
    n, blocks = D.benchmark_blocks(bench)
    assert n > 3
    assert sum(map(len, blocks)) == bench.count()
    assert {tuple(r) for r in D.contamination(documents, bench).collect()} == one
    assert one


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "so the quick brown fox jumps over the lazy dog again", "z")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([("fox", "The quick brown fox jumps over the lazy dog")], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in D.contamination(docs, bench).collect()] == [(1, "fox", 0)]


def test_odd_rows(spark, odd, empty, sf):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "A b c d e."), (3, "A b c d e."), (None, "x" * 5000)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in D.contamination(odd, bench).collect())
    assert got == sorted([("3", "3")] * 4 + [("4", "3")] * 2 + [("6", "None")])
    assert D.contamination(empty, bench).count() == 0
    assert D.contamination(odd, bench.limit(0)).count() == 0


def with_edits(text, n):
    """n substitutions at distinct places, spread over the text."""
    out = list(text)
    for x in range(n):
        out[x * len(text) // n] = "#"
    return "".join(out)


@pytest.mark.parametrize("letters", ["etaoin shrdlu", "天地玄黄宇宙洪荒日月盈昃"])
def test_every_match_within_the_limit_is_found(letters):
    rows = [(i, "".join(RNG.choice(letters) for _ in range(RNG.choice([5, 12, 56, 85, 230])))) for i in range(40)]
    items = D.Items(rows)
    limits = [len(t) // 5 for t in items.texts]
    texts = ["0" * 30 + with_edits(t, k) + "0" * 30 for t, k in zip(items.texts, limits, strict=True)]
    got = {(d, i): dist for d, i, dist, *_ in items.search(texts)}
    want = {(d, i): hit[0] for d, t in enumerate(texts) for i, p in enumerate(items.texts) if (hit := D.edit_search(p, t, limits[i]))}
    assert got == want
    assert all((d, d) in got for d in range(40))


def test_a_typo_in_most_words():
    item = "carbon dioxide concentrations increase through industrial burning activity"
    text = "carbxn dioxidq concentratzons increaze throuph industriel burning activity"
    assert [r[:3] for r in D.Items([(0, item)]).search([f"{prose(30)} {text} {prose(30)}"])] == [(0, 0, 6)]
