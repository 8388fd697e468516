"""Operator 13: document quality by a linear-chain conditional random field over lines.

Each line with a word is a position of the chain and is good or bad. Its features are measures of the
line (symbols, shouting, separators, repetition, letters, word lengths, sentence ends, an earlier equal line) cut
at fixed thresholds, and the same of the lines before and behind it; transitions between labels are learned
too. Forward-backward gives each line's probability to be good; their mean, weighted by line length in bytes, is
the document's quality, which a logistic regression on that mean, the size and the lack of any line turns
into a calibrated score.

Only documents have labels. Lines start with their document's label; after a fit, lines of low-quality documents
that the chain holds for good are relabelled good (unless that leaves none bad), and the chain is fitted again,
ROUNDS times in all. The fit, in numpy on the driver, is gradient ascent (Adam) on the exact likelihood.

The labelled sample is bounded: SAMPLE_DOCS documents of either label (those with the smallest hashes of doc_id, one
text a doc_id) and SAMPLE_LINES lines in all; a document is taken whole or not at all. Scores read whole texts and
nothing else. Null, empty and blank texts have no line and get the score learned for such texts, which is the
share of label 1 where the sample has none. With labels of one kind only the score is that label, without
labels 0.5. Repeated rows are judged one by one, an empty table gives an empty result; other columns stay in
`score_quality`, whose outputs replace input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import bounded_batches, drop_caches, hash_sample
from lumenarc.llm.langid import held_out
from lumenarc.llm.toxicity import calibrate

SAMPLE_DOCS, SAMPLE_LINES = 4000, 200_000
ROUNDS, STEPS, RATE, RIDGE = 2, 150, 0.1, 1e-4

#: Marks that are neither letters nor common punctuation, and how sentences end.
SYMBOLS = b"#*$%&|<>{}[]=_\\/~^@+"
SEPARATORS = b"|>\t"
ENDS = tuple(".!?…:;。！？；：।؟\"'»”’)]}")
#: Measures of a line and the values from which their features are 1.
CUTS = {
    "symbols a word": (0.1, 0.3, 0.6),
    "exclamation marks a word": (0.1, 0.3, 0.6),
    "separators a word": (0.1, 0.3, 0.6),
    "capitals among letters": (0.2, 0.5, 0.9),
    "words that repeat the one before": (0.05, 0.2, 0.4),
    "words said earlier in the line": (0.2, 0.4, 0.6, 0.8),
    "digits among characters": (0.1, 0.3),
    "neither letters nor blanks among characters": (0.1, 0.2, 0.4),
    "letters a word": (2.0, 9.0, 15.0),
    "words": (2, 4, 8, 16, 64, 256),
    "no sentence end": (1,),
    "starts in lower case": (1,),
    "equals an earlier line": (1,),
    "addresses a word": (0.1, 0.4),
}
N = sum(map(len, CUTS.values()))
_edges = np.array([c for cuts in CUTS.values() for c in cuts], np.float32)
_owner = np.repeat(np.arange(len(CUTS)), [len(c) for c in CUTS.values()])
_not = lambda keep: bytes(b for b in range(256) if b not in keep)
_not_symbols, _not_separators, _not_digits = _not(SYMBOLS), _not(SEPARATORS), _not(b"0123456789")


def measures(line: bytes, words: list[bytes], again: bool) -> tuple[float, ...]:
    """The measures of CUTS, in order, of a line that has words."""
    n, text = len(words), line.decode("utf-8", "replace")
    size = max(1, len(text))
    upper, lower = sum(map(str.isupper, text)), sum(map(str.islower, text))
    letters = upper + lower or sum(map(str.isalpha, text))
    blanks = sum(map(str.isspace, text))
    stripped = text.strip()
    return (
        len(line.translate(None, _not_symbols)) / n,
        line.count(b"!") / n,
        len(line.translate(None, _not_separators)) / n,
        upper / max(1, letters),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(words)) / n,
        len(line.translate(None, _not_digits)) / size,
        (size - letters - blanks) / size,
        letters / n,
        n,
        not stripped.endswith(ENDS),
        stripped[:1].islower(),
        again,
        (line.count(b"http") + line.count(b"www.") + line.count(b"@")) / n,
    )


def line_bits(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (0, 1) and byte lengths of the lines that have words."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            rows.append(measures(line, words, line in seen))
            sizes.append(len(line))
            seen.add(line)
    got = np.array(rows, np.float32).reshape(len(rows), len(CUTS))
    return (got[:, _owner] >= _edges).astype(np.uint8), np.array(sizes, np.int64)


class Lanes:
    """Lines of many documents, time-major: step t holds line t of every document that has one, longest documents first."""

    def __init__(self, lengths: Iterable[int]):
        lengths = np.asarray(list(lengths), np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        top = int(sizes[0]) if len(sizes) else 0
        alive = len(sizes) - np.cumsum(np.bincount(sizes, minlength=top + 1))[:top] if top else np.zeros(0, np.int64)
        self.alive = alive.tolist()
        self.at = np.concatenate([[0], np.cumsum(alive)]).astype(np.int64)
        step = np.repeat(np.arange(top), alive)
        lane = np.arange(self.at[-1]) - np.repeat(self.at[:-1], alive)
        self.rows = starts[lane] + step  # packed place -> line
        self.has_before, self.has_next = step > 0, step + 1 < sizes[lane]

    def __iter__(self):
        """First place and number of lanes of each step."""
        return zip(self.at.tolist(), self.alive, strict=False)


def forward_backward(unary: np.ndarray, table: np.ndarray, lanes: Lanes) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each packed place, expected transition counts, log partition. unary: log odds of good; table: log weights [from, to]."""
    n = len(unary)
    shift = np.maximum(unary, 0)
    pot = np.stack([np.exp(-shift), np.exp(unary - shift)], 1)
    a = np.exp(table)
    alpha, beta, norm = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    steps = list(lanes)
    for t, (s, k) in enumerate(steps):
        now = pot[s : s + k] if t == 0 else (alpha[steps[t - 1][0] : steps[t - 1][0] + k] @ a) * pot[s : s + k]
        norm[s : s + k] = now.sum(1)
        alpha[s : s + k] = now / norm[s : s + k, None]
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        (s, k), p = steps[t], steps[t - 1][0]
        ahead = pot[s : s + k] * beta[s : s + k] / norm[s : s + k, None]
        pairs += (alpha[p : p + k].T @ ahead) * a
        beta[p : p + k] = ahead @ a.T
    good = alpha[:, 1] * beta[:, 1]
    return good / (good + alpha[:, 0] * beta[:, 0]), pairs, float(np.log(norm).sum() + shift.sum())


class Chain:
    """Weights: [3, N] of the features of a line, the one before and the one behind; [3] of all lines, no line before, none behind; [2, 2] of transitions."""

    def __init__(self):
        self.w, self.b, self.table = np.zeros((3, N)), np.zeros(3), np.zeros((2, 2))

    def unary(self, bits: np.ndarray, lanes: Lanes) -> np.ndarray:
        """Log odds of good, by packed place. bits: by line, documents one after the other."""
        if not len(bits):
            return np.zeros(0)
        own, before, behind = (bits.astype(np.float32) @ self.w.T.astype(np.float32)).astype(float).T
        r, last = lanes.rows, len(bits) - 1
        left, right = before[np.maximum(r - 1, 0)], behind[np.minimum(r + 1, last)]
        return own[r] + self.b[0] + np.where(lanes.has_before, left, self.b[1]) + np.where(lanes.has_next, right, self.b[2])

    def marginals(self, bits: np.ndarray, lanes: Lanes) -> np.ndarray:
        """P(good) by line."""
        out = np.empty(len(bits))
        if len(bits):
            out[lanes.rows] = forward_backward(self.unary(bits, lanes), self.table, lanes)[0]
        return out

    def gradients(self, bits: np.ndarray, lanes: Lanes, good: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood a line and its gradients for labels `good` (0, 1 by line)."""
        n, r, last = len(bits), lanes.rows, len(bits) - 1
        u = self.unary(bits, lanes)
        p, pairs, log_z = forward_backward(u, self.table, lanes)
        y = good[r]
        seen = np.zeros((2, 2))
        later = lanes.has_before
        np.add.at(seen, (good[np.maximum(r - 1, 0)][later], y[later]), 1)
        like = (u @ y + (seen * self.table).sum() - log_z) / n
        d = y - p
        sides = np.zeros((3, n))
        sides[0, r] = d
        sides[1, (r - 1)[later]] = d[later]
        sides[2, np.minimum(r + 1, last)[lanes.has_next]] = d[lanes.has_next]
        w = (sides.astype(np.float32) @ bits.astype(np.float32)).astype(float)
        return like, w / n, np.array([d.sum(), d[~later].sum(), d[~lanes.has_next].sum()]) / n, (seen - pairs) / n

    def fit(self, bits: np.ndarray, lanes: Lanes, good: np.ndarray, steps: int = STEPS) -> None:
        shapes = [self.w.shape, self.b.shape, self.table.shape]
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        flat = np.concatenate([self.w.ravel(), self.b, self.table.ravel()])
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for k in range(1, steps + 1):
            self.w, self.b, self.table = (flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False))
            g = np.concatenate([x.ravel() for x in self.gradients(bits, lanes, good)[1:]]) - RIDGE * flat
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            flat = flat + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w, self.b, self.table = (flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False))


def relabelled(marginals: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Line labels after a fit: lines of label-0 documents that look good become good, unless the whole document does."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    likely = marginals >= 0.5
    any_bad = np.bincount(doc, ~likely, len(lengths)) > 0
    return np.where((labels[doc] == 1) | (likely & any_bad[doc]), 1, 0)


def document_features(marginals: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length-weighted share of good lines (0.5 without a line), size (logarithmic), no line at all; a row a document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.bincount(doc, sizes, len(lengths))
    share = np.divide(np.bincount(doc, sizes * marginals, len(lengths)), whole, out=np.full(len(lengths), 0.5), where=whole > 0)
    return np.stack([share, np.log1p(whole) / 10, whole == 0], 1)


class Model:
    """chain None: every score is `share`."""

    def __init__(self, chain: Chain | None, weights: np.ndarray | None, share: float, knows_empty: bool):
        self.chain, self.weights, self.share, self.knows_empty = chain, weights, share, knows_empty

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) and byte lengths of all lines, lines of each document."""
        parts = [line_bits(t) for t in texts]
        lengths = np.array([len(s) for _, s in parts], np.int64)
        bits = np.concatenate([b for b, _ in parts]) if parts else np.zeros((0, N), np.uint8)
        sizes = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
        return self.chain.marginals(bits, Lanes(lengths)), sizes, lengths

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.chain is None:
            return np.full(len(texts), self.share)
        x = document_features(*self.lines(texts))
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return p if self.knows_empty else np.where(x[:, 2] == 1, self.share, p)


def labelled_lines(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_lines: int):
    """quality, bits, sizes of the sample's documents, as an Arrow table."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(1).alias("quality")).distinct()
    pick = lambda v: hash_sample(marked.where(F.col("quality") == v), sample_docs, "doc_id")
    chosen = pick(1).unionByName(pick(0))  # 2 x sample_docs rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    @F.arrow_udf("struct<n long, bits binary, sizes binary>")
    def lines(rows):
        import pyarrow as pa

        got = [line_bits(t.as_py()) for t in rows]
        fits = [len(s) <= sample_lines for _, s in got]
        return pa.StructArray.from_arrays(
            [pa.array([len(s) for _, s in got], pa.int64()), pa.array([b.tobytes() if f else None for (b, _), f in zip(got, fits, strict=True)], pa.binary()), pa.array([s.tobytes() if f else None for (_, s), f in zip(got, fits, strict=True)], pa.binary())], names=["n", "bits", "sizes"]
        )

    seen = texts.select("doc_id", "quality", lines("text").alias("l")).where("l.bits is not null")
    order = Window.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id", "quality").rowsBetween(Window.unboundedPreceding, 0)  # 2 x sample_docs rows
    return seen.withColumn("sum", F.sum("l.n").over(order)).where(F.col("sum") <= sample_lines).select("quality", "l.bits", "l.sizes").toArrow()


def train_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (null: skipped; other than 0 and 1: as 1)."""
    bounded_batches(docs.sparkSession)
    got = labelled_lines(docs, labels, sample_docs, sample_lines)
    y = np.array(got.column("quality").to_pylist(), np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Model(None, None, share, True)
    sizes = [np.frombuffer(s, np.int64) for s in got.column("sizes").to_pylist()]
    lengths = np.array([len(s) for s in sizes])
    bits = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(-1, N)
    if not len(bits):
        return Model(None, None, share, True)
    lanes, good, chain = Lanes(lengths), np.repeat(y, lengths), Chain()
    for _ in range(ROUNDS):
        chain.fit(bits, lanes, good)
        p = chain.marginals(bits, lanes)
        good = relabelled(p, lengths, y)
    x = document_features(p, np.concatenate(sizes), lengths)
    return Model(chain, calibrate(x, y), share, bool((lengths == 0).any()))


def quality_score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(texts):
        import pyarrow as pa

        drop_caches()
        return pa.array(model.score([t.as_py() for t in texts]))

    return score(text)


def score_quality(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """df with score and predicted (1 from `least`)."""
    bounded_batches(df.sparkSession)
    scored = df.withColumn("__s", quality_score(F.col(text_col), model))
    return scored.withColumns({"score": F.col("__s"), "predicted": F.when(F.col("__s") >= least, 1).otherwise(0)}).drop("__s")


def quality_class_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = held_out(F.col("doc_id"), 5, 0)
    model = train_quality(docs, labels.where(~held))
    return score_quality(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
