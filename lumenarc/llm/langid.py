"""Operator 6: language identification by a bidirectional gated recurrent network over bytes.

The network reads the whole text, across words, in windows of WINDOW bytes with CONTEXT bytes more on either
side, which set its state and are not counted. It labels every byte position, and a document's probabilities
are the mean over all positions of the text.

Training, on the driver in numpy, is backpropagation through time with Adam over all of the whole texts
of a bounded sample: SAMPLE_DOCS documents and SAMPLE_BYTES bytes at most, those with the smallest hashes
of doc_id; a text is taken whole or not at all.

Null texts and those without a letter are `und` with score 0. With no labelled row, as in an empty table,
everything is `und`. Repeated rows are judged one by one; other columns stay, lang_pred and score replace
columns of these names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import bounded_batches, bounded_sample, drop_caches

SAMPLE_DOCS, SAMPLE_BYTES = 1000, 1 << 20
HIDDEN, BATCH, RATE = 12, 128, 0.01
#: Bytes of a window and of the context on either side, and bytes of a training window.
WINDOW, CONTEXT, LESSON = 256, 16, 64
#: Training goes over its windows as often as it takes for so many steps, twice at least.
STEPS, EPOCHS = 400, 2
#: Windows that are read side by side.
LANES = 1024


def grid(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes [time, window] and the lengths."""
    size = np.array([len(w) for w in windows])
    width = int(size.max())
    flat = b"".join([w.ljust(width) for w in windows])
    return np.frombuffer(flat, np.uint8).reshape(len(windows), width).T, size


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Forward and backward GRU, a softmax over labels at each position. Input weights are a table by byte."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("x", init(256, 3 * hidden)), ("u", init(hidden, 3 * hidden)), ("c", np.zeros(3 * hidden, np.float32)))}
        self.p |= {"o": init(2 * hidden, len(labels)), "oc": np.zeros(len(labels), np.float32)}

    def direction(self, d: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [time, word, hidden] in reading order; `live` masks padding, where the state stays."""
        h, n = self.h, x.shape[1]
        inputs, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        state = np.zeros((n, h), np.float32)
        out = np.empty((len(x), n, h), np.float32)
        for t in range(len(x)):
            gx = inputs[x[t]] + c
            zr = sigmoid(gx[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            cand = np.tanh(gx[:, 2 * h :] + rs @ u[:, 2 * h :])
            new = np.where(live[t][:, None], z * state + (1 - z) * cand, state)
            if keep is not None:
                keep.append((state, z, r, rs, cand))
            out[t] = state = new
        return out

    def forward(self, x: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Label probabilities [time, word, label]; zero on padding."""
        live = np.arange(len(x))[:, None] < size[None]
        held = ([], []) if keep is not None else (None, None)
        f = self.direction("f", x, live, held[0])
        b = self.direction("b", x[::-1], live[::-1], held[1])[::-1]
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.p["o"] + self.p["oc"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        probs = e / e.sum(axis=2, keepdims=True) * live[:, :, None]
        if keep is not None:
            keep |= {"held": held, "both": both, "live": live}
        return probs

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradients, through time in both directions."""
        keep: dict = {}
        probs = self.forward(x, size, keep)
        live, both, h = keep["live"], keep["both"], self.h
        n = live.sum()
        loss = -np.log(np.maximum(probs[:, np.arange(len(y)), y], 1e-9))[live].sum() / n
        d_logits = probs.copy()
        d_logits[:, np.arange(len(y)), y] -= live
        d_logits /= n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.einsum("tni,tnk->ik", both, d_logits)
        g["oc"] = d_logits.sum(axis=(0, 1))
        d_both = d_logits @ self.p["o"].T
        for d, held, dh_all, xs, lv in (("f", keep["held"][0], d_both[:, :, :h], x, live), ("b", keep["held"][1], d_both[::-1, :, h:], x[::-1], live[::-1])):
            u = self.p["u" + d]
            ahead = np.zeros((x.shape[1], h), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                state, z, r, rs, cand = held[t]
                total = dh_all[t] + ahead
                on = lv[t][:, None]
                dn = total * on
                d_cand = dn * (1 - z) * (1 - cand * cand)
                d_rs = d_cand @ u[:, 2 * h :].T
                d_z = dn * (state - cand) * z * (1 - z)
                d_r = d_rs * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                ahead = np.where(on, dn * z + d_rs * r + d_zr @ u[:, : 2 * h].T, total)
                full = np.concatenate([d_zr, d_cand], axis=1)
                np.add.at(g["x" + d], xs[t], full)
                g["u" + d][:, : 2 * h] += state.T @ d_zr
                g["u" + d][:, 2 * h :] += rs.T @ d_cand
                g["c" + d] += full.sum(axis=0)
        return float(loss), g

    def fit(self, windows: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        order = np.argsort([len(w) for w in windows], kind="stable")
        runs = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, epochs = 0, max(EPOCHS, -(-steps // len(runs)))
        for epoch in range(epochs):
            for k in rng.permutation(len(runs)):
                x, size = grid([windows[i] for i in runs[k]])
                _, g = self.gradients(x, size, y[runs[k]])
                step += 1
                rate = RATE / (1 + 3 * epoch / epochs)
                for key, grad in g.items():
                    m[key] += 0.1 * (grad - m[key])
                    v[key] += 0.01 * (grad * grad - v[key])
                    self.p[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def logits(self, d: str, x: np.ndarray, out: np.ndarray, keep: range) -> None:
        """Adds what one direction says of whole windows to out [time, label, window], for the times in `keep`; in place on few arrays."""
        h, n = self.h, x.shape[1]
        factor = (-1, -1, -2)  # of update, reset and candidate, so that exponentials take them as they are
        part = lambda a: [np.ascontiguousarray(f * a[:, i * h : (i + 1) * h]) for i, f in enumerate(factor)]
        (x_z, x_r, x_c), (u_z, u_r, u_c) = part(self.p["x" + d] + self.p["c" + d]), part(self.p["u" + d])
        o = np.ascontiguousarray((self.p["o"][: self.h] if d == "f" else self.p["o"][self.h :]).T)
        state, said = np.zeros((n, h), np.float32), np.empty((len(o), n), np.float32)
        z, r, c, by = (np.empty((n, h), np.float32) for _ in range(4))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            at = x[t]
            for gate, table, u in ((z, x_z, u_z), (r, x_r, u_r)):
                np.take(table, at, axis=0, out=gate, mode="clip")
                gate += np.matmul(state, u, out=by)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            r *= state
            np.take(x_c, at, axis=0, out=c, mode="clip")
            c += np.matmul(r, u_c, out=by)
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1  # the hyperbolic tangent
            state -= c
            state *= z
            state += c
            if t in keep:
                np.matmul(o, state.T, out=said)
                out[t - keep.start] += said

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """[text, label]: the probabilities of all positions of each text, summed."""
        sizes = np.array([len(t) for t in texts], np.int64)
        gap = b" " * CONTEXT
        buffer = np.frombuffer(b"".join([gap + t + gap for t in texts]) + b" " * WINDOW, np.uint8)
        begin = np.cumsum(sizes + 2 * CONTEXT) - sizes - 2 * CONTEXT
        many = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = begin[owner] + place * WINDOW
        size = np.minimum(sizes[owner] - place * WINDOW, WINDOW)
        out = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(size, kind="stable")
        with np.errstate(over="ignore"):
            for lo in range(0, len(order), LANES):
                at = order[lo : lo + LANES]
                width = int(size[at[-1]]) + 2 * CONTEXT
                x = buffer[start[at] + np.arange(width)[:, None]]
                keep = range(CONTEXT, width - CONTEXT)
                logits = np.repeat(self.p["oc"][None, :, None], len(keep), axis=0) + np.zeros((1, 1, len(at)), np.float32)
                for d in "fb":
                    self.logits(d, x, logits, keep)
                logits -= logits.max(axis=1, keepdims=True)
                np.exp(logits, out=logits)
                share = (np.arange(len(keep))[:, None] < size[at]) / logits.sum(axis=1)
                np.add.at(out, owner[at], np.einsum("tln,tn->nl", logits, share.astype(np.float32)))
        return out

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest label of each text and its probability."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        raws = [texts[i].encode("utf-8", "surrogatepass") for i in some]
        for i, raw, sums in zip(some, raws, self.pooled(raws) if some else [], strict=True):
            names[i] = self.labels[int(sums.argmax())]
            scores[i] = float(min(1.0, sums.max() / len(raw)))
        return names, scores


def train_language_model(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> BiGru | None:
    """rows: doc_id, text, lang; nulls are skipped."""
    given = rows.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sample = bounded_sample(given, sample_docs, sample_bytes, "text", "doc_id", "text", "lang").select("text", "lang").toArrow()
    labels = sorted(set(sample.column("lang").to_pylist()))
    windows, y = [], []
    for text, lang in zip(sample.column("text").to_pylist(), sample.column("lang").to_pylist(), strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        own = [raw[i : i + LESSON] for i in range(0, len(raw), LESSON)]
        windows += own
        y += [labels.index(lang)] * len(own)
    if not windows:
        return None
    model = BiGru(labels)
    model.fit(windows, np.array(y))
    return model


def language_column(text: Column, model: BiGru | None) -> Column:
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("lang_pred string, score double")
    def label(texts):
        import pyarrow as pa

        from lumenarc.llm.bpe import batches

        drop_caches()
        names, scores = [], []
        for held in batches((t.as_py() for t in texts), 1 << 20):
            n, s = model.label(held)
            names += n
            scores += s
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return label(text)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def predict_languages(df: DataFrame, model: BiGru | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    bounded_batches(df.sparkSession)
    done = df.withColumn("__l", language_column(F.col(text_col), model))
    return done.withColumns({"lang_pred": F.col("__l.lang_pred"), "score": F.col("__l.score")}).drop("__l")


def language_report(docs: DataFrame) -> DataFrame:
    held = held_out(F.col("doc_id"), 4, 2)
    model = train_language_model(docs.where(~held))
    return predict_languages(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
