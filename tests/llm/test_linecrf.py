from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import linecrf as Q


def random_chain(seed=0):
    rng = np.random.default_rng(seed)
    chain = Q.Chain()
    chain.w, chain.b, chain.table = rng.normal(size=(3, Q.N)), rng.normal(size=3), rng.normal(size=(2, 2))
    lengths = [3, 0, 5, 1, 4]
    return rng, chain, lengths, rng.integers(0, 2, (sum(lengths), Q.N)).astype(np.uint8)


def test_marginals_equal_all_labelings():
    _, chain, lengths, bits = random_chain()
    got, at = chain.marginals(bits, Q.Lanes(lengths)), 0
    for n in lengths:
        own = bits[at : at + n].astype(float)
        u = [own[t] @ chain.w[0] + chain.b[0] + (own[t - 1] @ chain.w[1] if t else chain.b[1]) + (own[t + 1] @ chain.w[2] if t + 1 < n else chain.b[2]) for t in range(n)]
        weight = {y: np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(chain.table[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=n)}
        for t in range(n):
            assert got[at + t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / sum(weight.values()), abs=1e-5)
        at += n


def test_gradients_equal_differences():
    rng, chain, lengths, bits = random_chain(1)
    lanes, good = Q.Lanes(lengths), rng.integers(0, 2, len(bits))
    _, *grads = chain.gradients(bits, lanes, good)
    for held, g in zip((chain.w, chain.b, chain.table), grads, strict=True):
        for at in list(np.ndindex(held.shape))[:: max(1, held.size // 12)]:
            was, like = held[at], []
            for d in (1e-2, -1e-2):
                held[at] = was + d
                like.append(chain.gradients(bits, lanes, good)[0])
            held[at] = was
            assert (like[0] - like[1]) / 2e-2 == pytest.approx(g[at], abs=1e-3)


def test_a_neighbour_moves_a_line():
    chain = Q.Chain()
    chain.table = np.array([[1.0, -1.0], [-1.0, 1.0]])
    chain.w[0, 0] = -4.0
    bits = np.zeros((2, Q.N), np.uint8)
    alone = chain.marginals(bits[:1], Q.Lanes([1]))[0]
    bits[1, 0] = 1
    assert chain.marginals(bits, Q.Lanes([2]))[0] < alone == 0.5


def test_line_measures():
    of = lambda s, again=False: dict(zip(Q.CUTS, Q.measures(s.encode(), s.encode().split(), again), strict=True))
    got = of("The The man, the man### went HOME!!")
    assert got["symbols a word"] == pytest.approx(3 / 7) and got["exclamation marks a word"] == pytest.approx(2 / 7)
    assert got["words that repeat the one before"] == pytest.approx(1 / 7)
    assert of("ein Satz mit Ende.")["no sentence end"] == 0 and of("menu | home")["no sentence end"] == 1
    assert of("12 34")["digits among characters"] == pytest.approx(4 / 5)
    assert of("日本語 文字")["letters a word"] == 2.5
    assert Q.line_bits(None)[0].shape == Q.line_bits("\n \n")[0].shape == (0, Q.N)


def test_lines_of_mixed_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train_quality(docs, labels)
    good, bad = "The report was read and then it was sent to them.", "Home ### &&& %%% *** $$$ ### menu ### more### text***"
    lines = [f"{good[i:]}" for i in range(6)] + [f"{bad}{i}" for i in range(6)]
    p, _, n = model.lines(["\n".join(lines), good])
    assert n.tolist() == [12, 1] and p[0] > 0.5 > p[10] and p[12] > 0.5
    clean, mixed, junk = model.score([good + "\n" + good[4:], f"{good}\n{bad}", bad])
    assert clean > mixed > junk


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.quality_class_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    junk = [r["predicted"] for r in rows if not r["quality"]]
    assert junk.count(0) >= 0.95 * len(junk)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (None, 1, 1), (4, None, None), (2, 5, 0)], "doc_id long, quality int, toxic int")
    rows = Q.quality_class_report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.quality_class_report(empty, labels).count() == 0
    none = Q.quality_class_report(odd, labels.where(F.lit(False))).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = Q.quality_class_report(odd, labels.where("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in ones} <= {(1.0, 1), (0.5, 1)}
    clash = odd.withColumns({"score": F.lit("x"), "predicted": F.lit("y")})
    scored = Q.score_quality(clash, Q.train_quality(odd, labels))
    assert scored.count() == odd.count() and dict(scored.dtypes)["score"] == "double"


def test_a_hot_doc_id_gives_one_text(spark):
    rows = [(1, f"some words here {i}.") for i in range(500)] + [(2, "### ###")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert Q.labelled_lines(docs, labels, 10, 1000).num_rows == 2
    assert Q.labelled_lines(docs, labels, 10, 1).num_rows == 1
