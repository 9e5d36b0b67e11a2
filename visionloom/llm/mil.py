"""Multiple-instance learning: toxicity (noisy-or over sentences) and quality (gated attention over passages)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_sample, fold, utf8

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def _sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, out: int, limit: int, most_bytes: int) -> list:
    """At most `limit` labelled (doc_id, text, label) rows outside fold `out`, chosen by a hash of the id, whose texts have
    most_bytes in all: those that fit, in the hash's order. Rows without id, text or label teach nothing; of repeated ids
    one row counts."""
    marks = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label")).where("label is not null and doc_id is not null")
    marks = bounded_sample(marks.where(fold(F.col("doc_id"), folds) != out), "doc_id", limit)
    texts = docs.select("doc_id", "text").where("text is not null")
    one = F.min_by(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"), "label"), F.xxhash64("text")).alias("r")
    sizes = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    room, taken = most_bytes, []
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            taken.append((r["doc_id"], r["h"], int(r["label"] > 0)))
    if not taken:
        return []
    chosen = docs.sparkSession.createDataFrame(taken, T.StructType([docs.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("label", T.IntegerType())]))
    same = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["text"], r["label"]) for r in same.collect())


# --- toxicity -------------------------------------------------------------------------------------------------------


def word_features(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 letters, which meet the forms of one stem."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n)]


def folded(text: str) -> str:
    """Lower case with every character in its place: of all characters only the dotted capital I grows, so it is an i."""
    return text.replace("\u0130", "i").lower()


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive) of the sentences that hold more than their end."""
    spans, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            spans.append((at, m.end()))
        at = m.end()
    return spans + ([(at, len(text))] if text[at:].strip() else [])


@dataclass
class NoisyOr:
    """P(document) = 1 - (1 - prior) * prod over sentences of (1 - evidence).

    A sentence's evidence is what its words add to one without any: 1 - (1 - sigmoid(bias + sum of weights)) / (1 -
    sigmoid(bias)), and counts from `least` on. So sentences that hold nothing known, however many, change nothing."""

    weights: dict[str, float]
    bias: float
    prior: float
    least: float = 0.05

    def evidence(self, s: float) -> float:
        return 1 - float(np.exp(np.logaddexp(0, self.bias) - np.logaddexp(0, self.bias + s)))

    def scorer(self):
        """Scores a text: (document score, [(start, end, score)] of the sentences with evidence)."""
        known: dict[str, float] = {}
        weights = self.weights

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            if not text:
                return self.prior, []
            if len(known) > 100_000:
                known.clear()
            low = folded(text)
            words = _WORD.findall(low)
            for w in set(words).difference(known):
                known[w] = sum(weights.get(f, 0.0) for f in word_features(w))
            if not any(map(known.__getitem__, words)):
                return self.prior, []
            rest, hits = 1 - self.prior, []
            for a, b in sentences(low):
                s = sum(map(known.__getitem__, _WORD.findall(low[a:b])))
                if s > 0 and (p := self.evidence(s)) >= self.least:
                    rest *= 1 - p
                    hits.append((a, b, p))
            return 1 - rest, hits

        return score


def train_noisy_or(rows: list[tuple[int, str, int]], features: int = 2000, steps: int = 120, rate: float = 0.3, penalty: float = 1e-3, chance: float = 0.05) -> NoisyOr:
    """Gradient steps (Adam) on the documents' log likelihood.

    Features are words and beginnings of words that stand out in toxic documents more than chance allows: of all candidates
    as many are taken as keep the expected share of chance finds under `chance` (Benjamini and Hochberg, with Chernoff's
    bound for the binomial tail), so any number of labels has its own bound; where none passes, the likeliest are taken.
    Weights begin at a prior, the log odds (half a document added to each side) less their standard error, twice, shrunk
    where few documents show it, and are drawn to it, so a word that others always explain keeps its own; they are zero or
    more: a sentence is not excused by its words. A word between two others counts once, so copies and near copies of a
    document are no further evidence. Without both labels there is only the prior."""
    on, off, bags, met = Counter(), Counter(), [], (set(), set())
    for _, text, y in rows:
        low = folded(text)
        bags.append([Counter(f for w in _WORD.findall(low[a:b]) for f in word_features(w)) for a, b in sentences(low)] or [Counter()])
        words = ["", *_WORD.findall(low), ""]
        fresh = {w for k, w in enumerate(words[1:-1], 1) if (t := hash((words[k - 1], w, words[k + 1]))) not in met[y] and not met[y].add(t)}
        (on if y else off).update({f for w in fresh for f in word_features(w)})
    del met
    n1, n0 = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    if not n1 or not n0:
        return NoisyOr({}, -7.0, min(0.99, max(0.01, n1 / max(1, n1 + n0))))
    names = sorted(on)
    c, n, r = np.array([on[f] for f in names], float), np.array([on[f] + off[f] for f in names], float), n1 / (n1 + n0)
    share = np.clip(c / n, r, 1 - 1e-12)
    log_p = -n * (share * np.log(share / r) + (1 - share) * np.log((1 - share) / (1 - r)))
    by = np.sort(log_p)
    passed = np.flatnonzero(by <= np.log(chance * np.arange(1, len(by) + 1) / max(1, len(by)))) if len(by) else []
    most = by[passed[-1]] if len(passed) else (by[0] if len(by) else 0.0)
    odds = np.log((n0 + 1) / (n1 + 1)) + np.log((c + 0.5) / (n - c + 0.5))
    sure = {f: float(o - e) for f, o, e, p in zip(names, odds, np.sqrt(1 / (c + 0.5) + 1 / (n - c + 0.5)), log_p) if p <= most and o > e}
    # the widest beginning that is about as telling stands for its longer forms, so that forms not seen here count too
    told = {f for f in sure if not any(sure[p] >= sure[f] - 0.5 for k in (4, 5, 6) if (p := f"{f[:k]}-") != f and k <= len(f.rstrip("-")) and p in sure)}
    chosen = sorted(told, key=lambda f: (-sure[f] * np.sqrt(on[f]), f))[:features]
    index = {f: i for i, f in enumerate(chosen)}
    sent, feat, doc = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            k = len(doc)
            doc.append(d)
            for f in s:
                if f in index:
                    sent.append(k), feat.append(index[f])
    sent, feat, doc = np.array(sent, int), np.array(feat, int), np.array(doc)
    y = np.array([y for *_, y in rows], float)
    prior = np.array([2 * sure[f] * on[f] / (on[f] + 2) for f in chosen])
    w, bias, lead = prior.copy(), -5.0, -4.0
    m, v = np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)
    for step in range(1, steps + 1):
        s = bias + np.bincount(sent, w[feat], len(doc))
        total = np.logaddexp(0, lead) + np.bincount(doc, np.logaddexp(0, s) - np.logaddexp(0, bias), len(y))
        p = -np.expm1(-total)
        d_total = np.where(y > 0, -np.exp(-total) / np.maximum(p, 1e-9), 1.0)
        slope, flat = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(-bias))
        d_s = d_total[doc] * slope
        g = np.concatenate([np.bincount(feat, d_s[sent], len(w)) / len(y) + penalty * (w - prior), [(d_total[doc] * (slope - flat)).sum() / len(y), d_total.sum() / (1 + np.exp(-lead)) / len(y)]])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(0, w - move[:-2])
        bias, lead = float(np.clip(bias - move[-2], -8, -3)), float(np.clip(lead - move[-1], -8, -1.5))
    return NoisyOr({f: float(x) for f, x in zip(chosen, w) if x > 1e-3}, bias, 1 / (1 + float(np.exp(-lead))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_bytes: int = 32_000_000) -> NoisyOr:
    """Learned from at most `sample` labelled documents of most_bytes in all, none whose fold of 4 is 2."""
    return train_noisy_or(_sample(docs, labels, "toxic", 4, 2, sample, most_bytes))


def score_toxicity(docs: DataFrame, model: NoisyOr, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score, predicted and offending: the sentences (start, end, score) whose evidence is `threshold` or more.

    Null and empty texts score the prior, as do texts without known words. All sentences of a text are read. Repeated rows
    are treated alike; columns of docs with these names are replaced. No shuffle.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

    def fn(texts: list, score) -> dict:
        found = [score(t) for t in texts]
        return {
            "score": [s for s, _ in found],
            "predicted": [int(s >= threshold) for s, _ in found],
            "offending": [[{"start": a, "end": b, "score": p} for a, b, p in hits if p >= threshold] for _, hits in found],
        }

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(span))]
    return append_columns(docs, fields, fn, [text], setup=model.scorer)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) per document. Null ids are not held out; repeated ids keep a row
    each. Without labels every score is the prior, 0.01; an empty table gives no rows."""
    model = fit_toxicity(docs, labels)
    src = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return score_toxicity(src, model).select("doc_id", "held_out", "score", "predicted", "offending")


# --- quality --------------------------------------------------------------------------------------------------------

PASSAGE = 512  # bytes of a passage; a longer text has several, the last of what is left
KINDS = 12
_KIND = np.full(256, KINDS - 1, np.int64)
for _k, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!?", b"|", b"'\"()[]{}-_/\\"]):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 10  # the last kind is the other signs


def passages(text: str | None, block: int = 2048) -> np.ndarray:
    """(n, KINDS + 5) features of a text's passages: shares of kinds of bytes, repetition within, word lengths, size.
    Worked out for `block` passages at a time; what stays is a quarter of the text's size. Null and empty: one passage."""
    raw = utf8(text)
    n = max(1, -(-len(raw) // PASSAGE))
    x = np.zeros((n, KINDS + 5))
    x[:, KINDS + 4] = min(1.0, np.log1p(len(raw)) / 12)
    for lo in range(0, n if raw else 0, block):
        part = raw[lo * PASSAGE : (lo + block) * PASSAGE]
        hi = min(n, lo + block)
        at = np.arange(len(part)) // PASSAGE
        kinds = np.bincount(at * KINDS + _KIND[np.frombuffer(part, np.uint8)], minlength=(hi - lo) * KINDS).reshape(hi - lo, KINDS)
        x[lo:hi, :KINDS] = kinds / np.maximum(1, kinds.sum(1))[:, None]
        for i in range(lo, hi):
            own = part[(i - lo) * PASSAGE : (i - lo + 1) * PASSAGE]
            words = own.split()
            if words:
                x[i, KINDS] = len(set(words)) / len(words)
                x[i, KINDS + 1] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
                x[i, KINDS + 2] = min(2.0, len(own) / len(words) / 10)
                x[i, KINDS + 3] = min(1.0, len(words) / 80)
    return x


@dataclass
class GatedAttention:
    """h = tanh(E x); a = softmax over passages of w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum(a h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.tanh((x - self.mean) / self.scale @ self.p["E"] + self.p["e"])
        tv, su = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return h, tv, su, (tv * su) @ self.p["w"]

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Document scores and each passage's attention."""
        sizes = [len(b) for b in bags]
        ahead = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        h, _, _, s = self.encode(np.concatenate(bags))
        owner = np.repeat(np.arange(len(bags)), sizes)
        a = np.exp(s - np.maximum.reduceat(s, ahead)[owner])
        a /= np.add.reduceat(a, ahead)[owner]
        z = np.add.reduceat(a[:, None] * h, ahead, axis=0)
        return 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["b"]))), np.split(a, ahead[1:])


def train_attention(bags: list[np.ndarray], y: list[int], hidden: int = 12, steps: int = 200, rate: float = 0.02, seed: int = 3) -> GatedAttention:
    """All documents in every step (Adam on cross entropy, labels weighted to equal parts of 1 : 2 at most)."""
    x, sizes = np.concatenate(bags), [len(b) for b in bags]
    ahead = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    owner, g = np.repeat(np.arange(len(bags)), sizes), np.random.default_rng(seed)
    put = lambda *n: g.standard_normal(n) * 0.3
    p = {"E": put(x.shape[1], hidden), "e": np.zeros(hidden), "V": put(hidden, 8), "U": put(hidden, 8), "w": put(8), "c": put(hidden), "b": np.zeros(1)}
    net = GatedAttention(x.mean(0), x.std(0) + 0.02, p)
    xs, t = (x - net.mean) / net.scale, np.array(y, float)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    weight = np.where(t > 0, 1.0, min(2.0, max(1.0, t.sum() / max(1, len(t) - t.sum())))) / len(t)
    for step in range(1, steps + 1):
        h, tv, su, s = net.encode(x)
        a = np.exp(s - np.maximum.reduceat(s, ahead)[owner])
        a /= np.add.reduceat(a, ahead)[owner]
        z = np.add.reduceat(a[:, None] * h, ahead, axis=0)
        q = 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))
        d = (q - t) * weight
        d_z = d[:, None] * p["c"]
        d_a = (d_z[owner] * h).sum(1)
        d_s = a * (d_a - np.add.reduceat(a * d_a, ahead)[owner])
        d_g = d_s[:, None] * p["w"]
        d_tv, d_su = d_g * su * (1 - tv * tv), d_g * tv * su * (1 - su)
        d_h = a[:, None] * d_z[owner] + d_tv @ p["V"].T + d_su @ p["U"].T
        d_h *= 1 - h * h
        grads = {"E": xs.T @ d_h, "e": d_h.sum(0), "V": h.T @ d_tv, "U": h.T @ d_su, "w": (tv * su).T @ d_s, "c": z.T @ d, "b": np.array([d.sum()])}
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] += 0.1 * (grads[k] - m[k])
            v[k] += 0.01 * (grads[k] ** 2 - v[k])
            p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 2500, most_bytes: int = 32_000_000) -> GatedAttention | None:
    """Learned from at most `sample` labelled documents of most_bytes in all, none whose fold of 3 is 1. None without any."""
    rows = _sample(docs, labels, "quality", 3, 1, sample, most_bytes)
    return train_attention([passages(t) for _, t, _ in rows], [y for *_, y in rows]) if rows else None


def score_quality(docs: DataFrame, model: GatedAttention | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score, predicted and attended: the passage of most attention. Null text is one empty passage. Repeated
    rows are treated alike; columns of docs with these names are replaced. No shuffle.

    Without a model every document scores 0.5."""

    def fn(texts: list) -> dict:
        scores, most, lo = [], [], 0
        while model is not None and lo < len(texts):
            bags, size = [], 0
            while lo < len(texts) and (not bags or size < 8192):  # passages at once, or one text
                bags.append(passages(texts[lo]))
                size += len(bags[-1])
                lo += 1
            s, attention = model.score(bags)
            scores += np.clip(s, 0, 1).tolist()
            most += [int(a.argmax()) for a in attention]
        if model is None:
            scores, most = [0.5] * len(texts), [0] * len(texts)
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores], "attended": most}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("attended", T.IntegerType())]
    return append_columns(docs, fields, fn, [text])


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, attended) per document. Null ids are not held out; repeated ids keep a row
    each; without labels every score is 0.5; an empty table gives no rows."""
    model = fit_quality(docs, labels)
    src = docs.select("doc_id", "text", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    return score_quality(src, model).select("doc_id", "held_out", "score", "predicted", "attended")
