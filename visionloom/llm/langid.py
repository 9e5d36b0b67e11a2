"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy through time.

Texts are read whole, as windows of bytes; every position gets language probabilities, which are pooled per document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_sample, fold, utf8

HIDDEN, WINDOW = 8, 48  # units a direction; bytes of a window
_LETTER = re.compile(r"[^\W\d_]")


GATES = 3  # update, reset, candidate


@dataclass
class BiGRU:
    """Per direction: byte tables (3 x 256 x H) and recurrent matrices (3 x H x H) of the gates; a shared output layer.

    Softsign, x / (1 + |x|), bounds the candidate and, scaled to 0..1, the gates: it needs no transcendental function.
    """

    table: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    labels: list[str]
    least: float = 0.0  # pooled probability below which no learned language is recognised

    def _run(self, x: np.ndarray, d: int, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) of the bytes x (T, B) in direction d; keep: what the way back needs."""
        steps, batch = x.shape
        tables, mats = self.table[d], self.recur[d]
        h = np.zeros((batch, HIDDEN), np.float32)
        states, kept = np.empty((steps, batch, HIDDEN), np.float32), []
        work = np.empty((batch, HIDDEN), np.float32)

        def bounded(a: np.ndarray) -> np.ndarray:
            np.abs(a, out=work)
            np.add(work, 1, out=work)
            a /= work
            return a

        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z, r, n = (tables[k].take(x[t], axis=0) for k in range(GATES))
            z += h @ mats[0]
            r += h @ mats[1]
            bounded(z)
            bounded(r)
            r += 1
            r *= 0.5
            r *= h
            n += r @ mats[2]
            bounded(n)
            z += 1
            z *= 0.5
            before = h
            h = states[t]
            np.subtract(before, n, out=h)
            h *= z
            h += n
            if keep:
                kept.append((t, z, r, n, before))
        return states, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(L, T, B): of each language at each position of the bytes x (T, B)."""
        forth, back = (self._run(x, d, False)[0].reshape(-1, HIDDEN) for d in (0, 1))
        y = self.out[:, :HIDDEN] @ forth.T
        y += self.out[:, HIDDEN:] @ back.T
        y += self.bias[:, None]
        np.clip(y, -40, 40, out=y)
        np.exp(y, out=y)
        y /= y.sum(0)
        return y.reshape(len(self.labels), *x.shape)


def _blank(labels: list[str], seed: int) -> BiGRU:
    g = np.random.default_rng(seed)
    put = lambda *n, s: (g.standard_normal(n) * s).astype(np.float32)
    return BiGRU([put(GATES, 256, HIDDEN, s=0.5) for _ in (0, 1)], [put(GATES, HIDDEN, HIDDEN, s=0.4) for _ in (0, 1)], put(len(labels), 2 * HIDDEN, s=0.3), np.zeros(len(labels), np.float32), labels)


def train(texts: list[bytes], langs: list[str], steps: int = 400, batch: int = 160, rate: float = 0.03, seed: int = 7) -> BiGRU:
    """Backpropagation through time over random windows of the texts, batches balanced by language; Adam."""
    labels = sorted(set(langs))
    net, g = _blank(labels, seed), np.random.default_rng(seed)
    pools = [[t for t, x in zip(texts, langs) if x == y and t] for y in labels]
    pools = [p or [b" "] for p in pools]
    params = [*net.table, *net.recur, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = g.integers(0, len(labels), batch)
        x = np.zeros((batch, WINDOW), np.uint8)
        for i, k in enumerate(y):
            t = pools[k][g.integers(len(pools[k]))]
            at = int(g.integers(0, max(1, len(t) - WINDOW + 1)))
            part = np.frombuffer(t[at : at + WINDOW], np.uint8)
            x[i, : len(part)] = part
        x = np.ascontiguousarray(x.T)
        grads = _gradients(net, x, y)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, d, a, b in zip(params, grads, m, v):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _gradients(net: BiGRU, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy of the labels y (B) at every position of x (T, B), padding zero bytes left out."""
    steps, batch = x.shape
    runs = [net._run(x, d, True) for d in (0, 1)]
    s = np.concatenate([r[0] for r in runs], axis=2).reshape(steps * batch, 2 * HIDDEN)
    p = s @ net.out.T + net.bias
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    p[np.arange(steps * batch), np.tile(y, steps)] -= 1
    real = (x > 0).reshape(-1, 1)
    p *= real / max(1, int(real.sum()))
    d_out, d_bias, d_s = p.T @ s, p.sum(0), (p @ net.out).reshape(steps, batch, 2 * HIDDEN)
    tables, recurs = [], []
    slope = lambda a: (1 - np.abs(a)) ** 2  # noqa: E731  of softsign, from its value
    for d, (_, kept) in enumerate(runs):
        mats, d_mats = net.recur[d], np.zeros_like(net.recur[d])
        d_a = np.empty((GATES, steps, batch, HIDDEN), np.float32)
        d_h = np.zeros((batch, HIDDEN), np.float32)
        for t, z, rh, n, before in reversed(kept):
            d_h = d_h + d_s[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            r = bounded_gate(net, x[t], d, before)
            d_n = d_h * (1 - z) * slope(n)
            d_rh = d_n @ mats[2].T
            d_z = d_h * (before - n) * 0.5 * slope(2 * z - 1)
            d_r = d_rh * before * 0.5 * slope(2 * r - 1)
            d_a[0, t], d_a[1, t], d_a[2, t] = d_z, d_r, d_n
            d_mats += np.stack([before.T @ d_z, before.T @ d_r, rh.T @ d_n])
            d_h = d_h * z + d_rh * r + d_z @ mats[0].T + d_r @ mats[1].T
        d_table = np.zeros_like(net.table[d])
        for k in range(GATES):
            np.add.at(d_table[k], x.reshape(-1), d_a[k].reshape(-1, HIDDEN))
        tables.append(d_table)
        recurs.append(d_mats)
    return [*tables, *recurs, d_out, d_bias]


def bounded_gate(net: BiGRU, at: np.ndarray, d: int, before: np.ndarray) -> np.ndarray:
    """The reset gate of a step, made again on the way back."""
    a = net.table[d][1].take(at, axis=0) + before @ net.recur[d][1]
    return 0.5 + 0.5 * a / (1 + np.abs(a))


def score_texts(net: BiGRU, texts: list[str | None], width: int = 1024) -> list[tuple[str, float]]:
    """(language, pooled probability) per whole text; ("und", 0) where it is null or has no letter."""
    raw = [utf8(t) if t and _LETTER.search(t) else b"" for t in texts]
    sums, n = np.zeros((len(raw), len(net.labels))), np.array([len(r) for r in raw], np.int64)
    windows = -(-n // WINDOW)
    owner = np.repeat(np.arange(len(raw)), windows)
    ahead = np.concatenate([[0], np.cumsum(windows)])
    i = 0
    while i < len(raw):  # whole texts are laid out a few MB at a time
        j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + 16 * width, "right")) - 1)
        x = np.zeros((int(ahead[j] - ahead[i]), WINDOW), np.uint8)
        for k in range(i, j):
            if n[k]:
                x[ahead[k] - ahead[i] : ahead[k + 1] - ahead[i]].reshape(-1)[: n[k]] = np.frombuffer(raw[k], np.uint8)
        for at in range(0, len(x), width):
            part = np.ascontiguousarray(x[at : at + width].T)
            p = net.probabilities(part)
            p *= part > 0
            total = p.sum(1)
            who = owner[ahead[i] + at : ahead[i] + at + part.shape[1]]
            for k in range(len(net.labels)):
                sums[:, k] += np.bincount(who, total[k], len(raw))
        i = j
    out = []
    for k, s in enumerate(sums):
        best = int(s.argmax())
        out.append((net.labels[best], float(min(1.0, s[best] / s.sum()))) if n[k] and s.sum() > 0 else ("und", 0.0))
    return out


def least_score(net: BiGRU, texts: list[str]) -> float:
    """Halfway from chance, one in as many as there are languages, to what all but a hundredth of these texts reach: so it
    follows the number of languages and how sure the network is of text that it was not trained on."""
    scores = [x for lang, x in score_texts(net, texts) if lang != "und"]
    return (1 / len(net.labels) + float(np.quantile(scores, 0.01))) / 2 if scores else 0.0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 3300, sample_chars: int = 20_000, folds: int = 5, steps: int = 400) -> BiGRU | None:
    """A network from at most `sample` documents with a lang, none of fold 0; of each, the slice of `sample_chars`
    characters that begins at a hashed place. One in eleven of them sets the least score and trains nothing. None where
    there is nothing to learn from; rows of null ids, texts or langs are left out, of repeated ids one row counts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null").where(fold(F.col("doc_id"), folds) != 0)
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int") + 1
    got = bounded_sample(rows.withColumn("text", F.substring("text", at, F.lit(sample_chars))), "doc_id", sample).collect()
    got = sorted((r for r in got if _LETTER.search(r["text"])), key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    if not got:
        return None
    taught = [r for i, r in enumerate(got) if i % 11 != 5]
    net = train([utf8(r["text"]) for r in taught], [r["lang"] for r in taught], steps)
    net.least = least_score(net, [r["text"] for i, r in enumerate(got) if i % 11 == 5])
    return net


def identify(docs: DataFrame, net: BiGRU | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; every byte of every text is read. Without a network all is `und`, as are null texts
    and texts without a letter. Equal texts have equal results; columns of docs with these names are replaced. No shuffle."""

    def fn(texts: list) -> dict:
        if net is None:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        unlike = list(dict.fromkeys(texts))
        known = {t: x for lo in range(0, len(unlike), 500) for t, x in zip(unlike[lo : lo + 500], score_texts(net, unlike[lo : lo + 500]))}
        found = [known[t] for t in texts]
        return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], fn, [text])


def language_of_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document. Null text or no letter: `und`, 0. Null ids count as held out;
    repeated ids keep a row each."""
    net = fit(docs)
    src = docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    return identify(src, net).select("doc_id", "held_out", "lang_pred", "score")
