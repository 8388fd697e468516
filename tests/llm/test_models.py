import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import langid as L
from lumenarc.llm import toxicity as T


def test_gradients_equal_differences():
    net = L.BiGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, size = L.grid([b"abc", b"b", b"zz"])
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, size, y)
    rng = np.random.default_rng(0)
    for key in net.p:
        for _ in range(4):
            at = (ord("a") if key[0] == "x" else rng.integers(net.p[key].shape[0]), *(rng.integers(s) for s in net.p[key].shape[1:]))
            held = net.p[key][at]
            losses = []
            for d in (1e-3, -1e-3):
                net.p[key][at] = held + d
                losses.append(net.gradients(x, size, y)[0])
            net.p[key][at] = held
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[key][at], abs=2e-3)


def test_pooling_equals_the_plain_network():
    net = L.BiGru(["a", "b"])
    texts = [b"one two three", b"x", b"several words, and more of them", b"seven " * 40]
    gap = b" " * L.CONTEXT
    want = []
    for t in texts:
        x, size = L.grid([gap + t + gap])
        want.append(net.forward(x, size)[L.CONTEXT : L.CONTEXT + len(t), 0].sum(axis=0))
    assert np.allclose(net.pooled(texts), want, atol=1e-3)


def test_windows_carry_the_state_across_words_and_their_own_borders():
    net = L.BiGru(["a", "b"])
    net.p["o"] *= 5
    text = b"ab cd efg " * 100
    whole = net.pooled([text])[0]
    assert whole.sum() == pytest.approx(len(text), rel=1e-3)
    x, size = L.grid([b" " * L.CONTEXT + text + b" " * L.CONTEXT])
    plain = net.forward(x, size)[L.CONTEXT : -L.CONTEXT, 0].sum(axis=0)
    assert np.allclose(whole, plain, rtol=0.02)
    by_word = net.pooled(text.split()).sum(axis=0)
    assert not np.allclose(by_word / by_word.sum(), whole / whole.sum(), rtol=1e-3)


def test_languages_on_held_out_documents(documents):
    rows = L.language_report(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(odd, empty):
    got = {r["doc_id"]: r["lang_pred"] for r in L.language_report(odd).collect()}
    assert got[None] == got[1] == got[5] == "und"
    assert L.language_report(odd).count() == odd.count()
    assert L.language_report(empty).count() == 0


def test_grammar_weighs_context():
    lex = T.Lexicon({"scum": 4.0}, {"lowei": 3.0})
    score = lambda s: lex.features(s)[0]
    plain = score("such scum here")
    assert score("you are scum") > score("you scum") > plain > score("this was not scum") > 0
    assert score("people said he is gone. such scum here") == plain
    assert score("they said it looked like scum") < score("they think it looked like scum")
    assert score("a loweian thing") > 0
    assert score("scumbag slowei") == 0
    assert score(None) == score("") == score("nothing here") == 0


def test_a_target_may_stand_on_either_side():
    lex = T.Lexicon({"scum": 4.0}, {})
    score = lambda s: lex.features(s)[0]
    assert score("i will kill you") == score("you i will kill") > score("i will kill time")
    assert score("i will kill you") > score("kill you") > score("kill time")
    assert score("scum like him") == score("him and scum") > score("scum like that")
    assert score("i will not kill you") < score("i will kill you")


def test_composition_runs_like_its_parts():
    rng = random.Random(1)
    parts = (T.insult(), T.threat(), T.negation(), T.reported())
    for _ in range(200):
        symbols = [rng.randrange(T.KINDS) for _ in range(12)]
        want = [np.prod(x) for x in zip(*(p.run(symbols) for p in parts), strict=True)]
        assert T.GRAMMAR.run(symbols) == pytest.approx(want)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.95 * len(rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(caught) >= 0.85 * len(caught)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = T.toxicity_report(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = T.toxicity_report(odd, labels.where(F.lit(False))).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert T.toxicity_report(empty, labels).count() == 0
