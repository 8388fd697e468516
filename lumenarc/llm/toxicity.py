"""Operator 7: toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to symbols: insult (words and stems learned from labelled rows, with
their log odds as weights), threat, target, copula, intent, negation, report, other. Clause transducers
read the symbols of one clause and pass on a factor for each insult and threat: the insult transducer
raises what a copula says of someone, the threat transducer what is meant to be done, negation damps what
follows within three words, reported speech the whole rest of its clause. These four are composed once
into one machine. The target transducer is run over the clause in both directions, since the one meant may
stand before or behind; the greater factor counts, and a threat without a target nearby weighs little.
Only clauses that hold an insult or a threat are run, whole; their scores are pooled and calibrated by
logistic regression, so isolated words outside of any pattern do not decide.

The lexicon is learned from SAMPLE_ROWS labelled rows at most of either label (those with the smallest
hashes of doc_id); at most LEXICON entries are kept. Scores depend on the whole text alone. Null and empty
texts have no clause and get the score of such texts. Without labelled rows of both labels the score is
0. Repeated rows are judged one by one, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import hash_sample
from lumenarc.llm.langid import held_out

SAMPLE_ROWS, LEXICON = 4000, 400
STEM_SIZES = range(4, 9)
MIN_EVIDENCE, MIN_PRECISION, MIN_SUPPORT = 30.0, 0.9, 4

#: Words with a grammatical part, in English, German, French and Spanish.
TARGETS = "you your yours he him his she her they them their du dich dein deine ihr euch sie tu toi vous votre ton ta il elle ils tú usted ustedes su ellos"
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún"
REPORTS = "said says say claimed claims wrote writes called calls quoted reported sagte schrieb behauptete dit écrit affirme dijo escribió afirma"
THREATS = "kill murder destroy hurt strangle töten umbringen vernichten tuer détruire matar destruir"
COPULAS = "is are am was were be being bist ist sind war seid es est êtes sont était eres son era sois"
INTENTS = "will shall gonna going should must werde wird werden soll muss vais va vas allons dois voy vas vamos debo debe"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA, INTENT = range(8)
KINDS = 8
SYMBOLS = {w: s for s, ws in ((COPULA, COPULAS), (INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws.split()}
words_of = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?").findall
clauses_of = re.compile(r"[^.!?;:\n]+").finditer


class Transducer:
    """Deterministic, over the symbols: step[state][symbol] = (next state, factor on that word's weight)."""

    def __init__(self, step: list[list[tuple[int, float]]]):
        self.step = step

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; factors multiply. Only reachable pairs of states are built."""
        number, order, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in order:
            row = []
            for s in range(KINDS):
                (na, fa), (nb, fb) = self.step[a][s], other.step[b][s]
                if (na, nb) not in number:
                    number[na, nb] = len(order)
                    order.append((na, nb))
                row.append((number[na, nb], fa * fb))
            step.append(row)
        return Transducer(step)

    def run(self, symbols: list[int]) -> list[float]:
        """The factor of each symbol."""
        state, out = 0, []
        for s in symbols:
            state, f = self.step[state][s]
            out.append(f)
        return out


def within(trigger: int, words: int, near: dict[int, float], far: dict[int, float] | None = None) -> Transducer:
    """Symbols within so many words after the trigger get the factors of `near`, others those of `far`."""
    far = far or {}
    return Transducer([[(words if s == trigger else max(0, left - 1), (near if left else far).get(s, 1.0)) for s in range(KINDS)] for left in range(words + 1)])


def insult() -> Transducer:
    """An insult that a copula says of someone, within three words, counts 1.2."""
    return within(COPULA, 3, {INSULT: 1.2})


def threat() -> Transducer:
    """A threat that is meant to be done, within three words, counts 1.3."""
    return within(INTENT, 3, {THREAT: 1.3})


def negation() -> Transducer:
    """Insults and threats count 0.4 within three words after a negation."""
    return within(NEGATION, 3, {INSULT: 0.4, THREAT: 0.4})


def reported() -> Transducer:
    """After a verb of saying the rest of the clause counts 0.6."""
    return Transducer([[(1 if at or s == REPORT else 0, 0.6 if at and s in (INSULT, THREAT) else 1.0) for s in range(KINDS)] for at in range(2)])


def target() -> Transducer:
    """A target within four words makes an insult 1.3 and a threat 1.5 times as heavy; without one a threat counts 0.3."""
    return within(TARGET, 4, {INSULT: 1.3, THREAT: 1.5}, {THREAT: 0.3})


GRAMMAR = insult().compose(threat()).compose(negation()).compose(reported())
NEAR = target()


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """The weights of a clause's words by the composed machine and the target transducer of both directions."""
    sides = zip(NEAR.run(symbols), NEAR.run(symbols[::-1])[::-1], strict=True)
    return sum(w * f * max(t) for w, f, t in zip(weights, GRAMMAR.run(symbols), sides, strict=True))


class Lexicon:
    """The lexical transducer: whole words and stems (any ending) with weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words, self.stems = words, stems
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.scan = ahocorasick.Automaton()
        for w in {*words, *stems, *THREATS.split()}:
            self.scan.add_word(w, w)
        self.scan.make_automaton()

    def read(self, word: str) -> tuple[int, float]:
        if (w := self.words.get(word)) is not None:
            return INSULT, w
        for n in self.sizes:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        s = SYMBOLS.get(word, OTHER)
        return s, 3.0 if s == THREAT else 0.0

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Sum and largest of the clause scores (logarithmic), and whether any clause matched."""
        low = (text or "").lower()
        ends = [e for e, _ in self.scan.iter(low)]
        if not ends:
            return 0.0, 0.0, 0.0
        total = most = 0.0
        k = 0
        for m in clauses_of(low):
            while k < len(ends) and ends[k] < m.start():
                k += 1
            if k == len(ends):
                break
            if ends[k] < m.end():
                got = [self.read(w) for w in words_of(m[0])]
                if any(s in (INSULT, THREAT) for s, _ in got):
                    score = clause_score([s for s, _ in got], [w for _, w in got])
                    total += score
                    most = max(most, score)
        return float(np.log1p(total)), float(np.log1p(most)), float(total > 0)


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """rows: text, toxic (0, 1). Words and stems whose presence speaks for the label, by document counts and the G test."""

    def count(batches):
        import pyarrow as pa

        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set(words_of((text or "").lower()))
                own |= {w[:n] + "*" for w in own for n in STEM_SIZES if len(w) > n}
                for w in own:
                    held.setdefault(w, [0, 0])[toxic] += 1
                if len(held) > 300_000:
                    yield pa.record_batch([pa.array(list(held)), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], names=["entry", "clean", "tox"])
                    held = {}
        if held:
            yield pa.record_batch([pa.array(list(held)), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))], names=["entry", "clean", "tox"])

    found = rows.select("text", "toxic").mapInArrow(count, "entry string, clean long, tox long").groupBy("entry").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    t, c = F.col("tox").cast("double"), F.col("clean").cast("double")
    part = lambda seen, expect: F.when(seen > 0, seen * F.log(seen / expect)).otherwise(0.0)
    all_ = float(n_toxic + n_clean)
    g = 2 * (part(t, (t + c) * n_toxic / all_) + part(c, (t + c) * n_clean / all_))
    precision = (t / n_toxic) / (t / n_toxic + c / n_clean)
    least = max(MIN_SUPPORT, n_toxic // 100)
    top = found.where((t >= least) & (precision >= MIN_PRECISION)).withColumn("g", g).where(F.col("g") >= MIN_EVIDENCE).orderBy(F.col("g").desc(), "entry").limit(LEXICON).collect()
    stats = {r["entry"]: (r["tox"], r["clean"]) for r in top}
    weight = lambda e: max(0.5, log((stats[e][0] + 0.5) / n_toxic) - log((stats[e][1] + 0.5) / n_clean))
    stems: dict[str, float] = {}
    for e in sorted((e for e in stats if e.endswith("*")), key=len):
        s = e[:-1]
        shorter = any(s[:n] in stems for n in range(1, len(s)))
        whole = stats.get(s)
        if not shorter and not (whole and whole[0] >= stats[e][0]):
            stems[s] = weight(e)
    words = {e: weight(e) for e in stats if not e.endswith("*") and not any(e[:n] in stems for n in range(1, len(e)))}
    stems = {s: w for s, w in stems.items() if not any(x.startswith(s) and stats[x][0] >= 0.9 * stats[s + "*"][0] for x in words)}
    return Lexicon(words, stems)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.1 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray | None):
        self.words, self.stems = (lexicon.words, lexicon.stems) if lexicon else ({}, {})
        self.weights = weights
        self._lexicon = None

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights, "_lexicon": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        self._lexicon = self._lexicon or Lexicon(self.words, self.stems)
        x = np.array([self._lexicon.features(t) for t in texts]).reshape(len(texts), 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (null: skipped; other than 0 and 1: as 1)."""
    marked = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.when(F.col("toxic") == 0, 0).otherwise(1).alias("toxic")).distinct()
    pick = lambda v: hash_sample(marked.where(F.col("toxic") == v), sample_rows, "doc_id")
    chosen = pick(1).unionByName(pick(0))  # 2 x sample_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model(None, None)
    lexicon = learn_lexicon(rows, counts[1], counts[0])
    words, stems = lexicon.words, lexicon.stems

    @F.arrow_udf("array<double>")
    def features(texts):
        import pyarrow as pa

        own = Lexicon(words, stems)
        return pa.array([list(own.features(t.as_py())) for t in texts], pa.list_(pa.float64()))

    seen = rows.select(features("text").alias("x"), "toxic").groupBy("x", "toxic").count().toArrow().to_pylist()
    seen.sort(key=lambda r: (r["x"], r["toxic"]))
    x = np.repeat([r["x"] for r in seen], [r["count"] for r in seen], axis=0)
    y = np.repeat([r["toxic"] for r in seen], [r["count"] for r in seen])
    return Model(lexicon, calibrate(x, y))


def toxicity_column(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(texts):
        import pyarrow as pa

        return pa.array(model.score([t.as_py() for t in texts]))

    return score(text)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = held_out(F.col("doc_id"), 5, 0)
    model = train_toxicity(docs, labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
