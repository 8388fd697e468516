import re
from collections import Counter

import pytest

from lumenarc.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def test_base_columns_equal_brute_force(documents):
    for r in documents.collect():
        assert Q.judge(r["text"])[:6] == brute(r["text"])


@pytest.mark.parametrize("many", [10, 20_000])
def test_repeats_on_tuples_and_arrays(monkeypatch, many):
    monkeypatch.setattr(Q, "MANY_WORDS", many)
    for text in ("a b c d e f a b c d e g", "a " * 30, "a b c d", "w" * 9, ""):
        assert Q.judge(text)[4] == brute(text)[4]


def test_unicode_white_space_is_no_border():
    assert Q.judge("a b c d\x1ce")[:2] == brute("a b c d\x1ce")[:2]


GOOD = "The river ran past the old mill and into the valley below the town."


@pytest.mark.parametrize("line", ["Startseite | Über uns | Impressum | Anmelden", "Accueil > Recherche > Aide", "Inicio | Quiénes somos | Iniciar sesión", "Alle Rechte vorbehalten, 2020 bis 2024, Verlag", "Pour lire plus, cliquez ici", "Todos los derechos reservados", " ".join(f"link{i} target{i}" for i in range(20)), " ".join(["Home", "About", "Help"] * 15), "Home | About | Contact | Login | Help", "Copyright (c) 2020 All rights reserved by us", "AND!! OR!! NOT!! BUT!! SO!! YET!! FOR!!", "a# b* c$ d% e& f|", "spam spam spam spam spam spam spam spam spam spam", "12 345 678 9 10 11 12"])
def test_failing_lines_go(line):
    got = Q.judge(f"{GOOD}\n{line}\nAnother plain sentence stands here for good measure.")
    assert got[7] == 1
    assert line not in got[10]
    assert GOOD in got[10]


def test_one_phrase_does_not_fail_a_long_sentence():
    line = " ".join(f"word{i}" for i in range(60)) + " and our privacy policy says so."
    assert line in Q.judge(f"{GOOD}\n{line}")[10]
    assert GOOD in Q.judge(GOOD + "\nThe home of the old menu maker was searched.")[10]


def test_documents_that_lose_too_much_are_rejected():
    junk = "\n".join(f"x{i}# y* z$ w%" for i in range(20))
    assert Q.judge(GOOD)[9]
    assert not Q.judge(f"{GOOD}\n{junk}")[9]


def test_verdicts_follow_the_labels(spark, documents, sf):
    marked = Q.quality_report(documents).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    rows = marked.collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


def test_odd_rows(odd, empty):
    rows = Q.apply_quality_rules(odd).collect()
    assert len(rows) == odd.count()
    none = next(r for r in rows if r["doc_id"] is None)
    assert (none["n_words"], none["base_failed"], none["kept"], none["clean_text"]) == (0, True, False, "")
    assert "shard" in rows[0].asDict()
    assert Q.quality_report(empty).count() == 0
