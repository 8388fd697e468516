import random

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import dedup as E

SCHEMA = "pos long, doi string, title string, score double, weight double"


def scan(rows, threshold):
    """One after the other, as a list grows."""
    by_doi, rest = {}, []
    for r in rows:
        doi = (r[1] or "").lower().removeprefix("https://doi.org/")
        if doi:
            by_doi.setdefault(doi, []).append(r)
        else:
            rest.append(r)
    kept = [max(g, key=lambda r: r[3] * r[4]) for g in by_doi.values()]
    for r in rest:
        rival = next((e for e in kept if E.sequence_ratio(r[2], e[2]) >= threshold), None)
        if rival is None:
            kept.append(r)
        elif r[3] * r[4] > rival[3] * rival[4]:
            kept.remove(rival)
            kept.append(r)
    return sorted(r[0] for r in kept)


def made_up(seed, n=160):
    rng = random.Random(seed)
    words = "graph neural deep model citation search index vector paper review zebra quantum".split()
    stems = [" ".join(rng.choices(words, k=5)) for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(stems))
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [t[k], rng.choice("qrs ")]])
        title = rng.choice(["", None, "  ", "".join(t).upper(), "".join(t), "".join(t), " " + "".join(t), rng.choice(stems)])
        rows.append((i, rng.choice([None, None, None, "", f"10.1000/x{rng.randrange(20)}", f"https://doi.org/10.1000/X{rng.randrange(20)}"]), title, rng.randrange(5) / 4, rng.choice([1.0, 0.5])))
    return rows


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_similar_titles_equal_all_pairs(spark, threshold):
    rows = made_up(1)
    got = {(r["a"], r["b"]): r["ratio"] for r in E.similar_titles(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
    titles = sorted({(r[2] or "").lower().strip() for r in rows} - {""})
    want = {(a, b): E.sequence_ratio(a, b) for a in titles for b in titles if a != b and E.sequence_ratio(a, b) >= threshold}
    assert got == pytest.approx(want) and want


@pytest.mark.parametrize(("seed", "replayed"), [(2, 5000), (3, 5000), (4, 2)])
def test_merging_equals_a_scan(spark, monkeypatch, seed, replayed):
    monkeypatch.setattr(E, "REPLAY_ROWS", replayed)
    rows = made_up(seed, 160 if replayed > 2 else 40)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(r["pos"] for r in E.merge_results(df, 0.85).collect()) == scan(rows, 0.85)


def test_few_and_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert E.merge_results(none).count() == 0 and E.similar_titles(none, 0.85).count() == 0
    rows = [(0, None, None, 1.0, 1.0), (1, None, None, 1.0, 1.0), (2, "10.1000/a", None, 0.1, 1.0), (3, "10.1000/A", "x", 0.2, 1.0)]
    got = E.merge_results(spark.createDataFrame(rows, SCHEMA).withColumn("seat", F.lit("s")))
    assert sorted(r["pos"] for r in got.collect()) == [0, 1, 3] and "seat" in got.columns


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_overlap_matches_equal_all_pairs(spark, threshold):
    rng = random.Random(6)
    sets = lambda n: [sorted(set(rng.choices("abcdefghijklmnop", k=rng.randrange(7)))) for _ in range(n)]
    one, two = sets(40), sets(50)
    frame = lambda rows, k: spark.createDataFrame(list(enumerate(rows)), f"{k} int, t{k} array<string>")
    got = {(r["a"], r["b"]): r["overlap"] for r in E.overlap_matches(frame(one, "a"), frame(two, "b"), threshold).collect()}
    of = lambda x, y: len({*x} & {*y}) / min(len(x), len(y)) if x and y else 0
    assert got == {(i, j): of(x, y) for i, x in enumerate(one) for j, y in enumerate(two) if of(x, y) >= threshold}


def test_copies_of_a_title_make_no_row_for_each_pair(spark, monkeypatch):
    rows = [(i, None, f"one title that is told {'twice' if i % 9 else 'again'}", 1.0 + i % 5, 1.0) for i in range(300)]
    sizes, staged = [], E.staged
    monkeypatch.setattr(E, "staged", lambda spark, df, name: sizes.append((got := staged(spark, df, name)).count()) or got)
    got = E.merge_results(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.85)
    assert sorted(r["pos"] for r in got.collect()) == scan(rows, 0.85)
    assert max(sizes) <= 300
