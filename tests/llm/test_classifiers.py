"""The queries of the trained operators held against plain loops over their own models, and what they learn."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from test_llm import DATA, base_spans, docs, made
from visionloom.llm import langid, matroska, mil, pii
from visionloom.llm.common import bounded_sample, table


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_query_equals_a_plain_noisy_or(spark):
    d, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    _, odd = made(spark)
    d = d.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    model = mil.fit_toxicity(d, labels)
    assert model.weights
    soft = lambda z: math.log1p(math.exp(z))

    def plain(text):
        rest = 1 - model.prior
        for sentence in re.split(r"[.!?\n]+", (text or "").replace("İ", "i").lower()):
            s = sum(model.weights.get(f, 0) for w in re.findall(r"\w+", sentence) for f in [w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) >= k)])
            p = 1 - math.exp(soft(model.bias) - soft(model.bias + s))
            rest *= 1 - p if p >= 0.05 else 1
        return 1 - rest

    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = mil.toxicity_of_documents(d, labels).collect()
    assert len(rows) == d.count()
    for r in rows:
        if list(texts).count(r["doc_id"]) == 1 and r["doc_id"] not in (None, 3):
            t = texts[r["doc_id"]]
            assert r["held_out"] == (fold(r["doc_id"], 4) == 2)
            assert r["predicted"] == int(r["score"] >= 0.3)
            for s in r["offending"]:
                assert 0.3 <= s["score"] <= r["score"] + 1e-9
    one = {r["text"]: r["score"] for r in mil.score_toxicity(d, model).collect()}
    for t, s in one.items():
        assert abs(s - plain(t)) < 1e-9


def trained_toxicity():
    g = random.Random(7)
    plain = lambda n: " ".join(g.choice(["the", "of", "tree", "house", "river", "stone", f"w{g.randrange(4000)}"]) + ("." if g.random() < 0.1 else "") for _ in range(n))
    rows = [(i, plain(60) + (f" {g.choice(['vilest', 'vilely', 'awful'])} tree. " if i % 5 == 0 else ". ") + plain(60), int(i % 5 == 0)) for i in range(300)]
    return mil.train_noisy_or(rows), plain


def test_toxicity_does_not_grow_with_clean_sentences():
    model, plain = trained_toxicity()
    score = model.scorer()
    clean = "the river of the house. "
    assert score(clean * 100_000)[0] == score(clean)[0] < 0.3
    long = ". ".join(plain(12) for _ in range(3000))
    assert score(long)[0] < 0.3 <= score(long + " an awful thing.")[0]
    assert score("")[0] == score(None)[0] == score("İ")[0] == model.prior


def test_toxicity_folds_every_letter():
    score = trained_toxicity()[0].scorer()
    text = "A RIVER İ. AN AWFUL TREE. İ"
    p, hits = score(text)
    assert p >= 0.3 and [text[a:b] for a, b, _ in hits] == [" AN AWFUL TREE."]


def test_toxicity_copies_are_no_evidence_and_few_labels_teach():
    g = random.Random(1)
    word = lambda: f"w{g.randrange(3000)}"
    text = lambda: " ".join(word() for _ in range(60))
    copied = text()
    rows = [(i, text(), 0) for i in range(150)] + [(200 + i, copied, 1) for i in range(40)] + [(300 + i, text() + f" scummy {word()}. " + text(), 1) for i in range(12)]
    model = mil.train_noisy_or(rows)
    assert {f.rstrip("-") for f in model.weights} <= {"scummy", "scumm", "scum"} and model.weights
    few = mil.train_noisy_or([(i, f"{word()} {'vile' if i % 3 == 0 else 'good'} words {word()}", int(i % 3 == 0)) for i in range(12)])
    assert few.scorer()("a vile thing")[0] > few.scorer()("a good thing")[0]


def test_quality_query_equals_a_plain_attention_network(spark):
    d, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = mil.fit_quality(d, labels)
    p = model.p
    sig = lambda z: 1 / (1 + math.exp(-z))

    def plain(text):
        raw = (text or "").encode()
        kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!?", b"|", b"'\"()[]{}-_/\\"]
        logits, hidden = [], []
        for at in range(0, max(1, len(raw)), 512):
            part = raw[at : at + 512]
            x = [0.0] * 17
            for c in part:
                x[10 if c > 127 else next((k for k, own in enumerate(kinds) if c in own), 11)] += 1 / len(part)
            words = part.split()
            if words:
                x[12:16] = [len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), min(2, len(part) / len(words) / 10), min(1, len(words) / 80)]
            x[16] = min(1, math.log1p(len(raw)) / 12)
            h = [math.tanh(sum((x[i] - model.mean[i]) / model.scale[i] * p["E"][i, j] for i in range(17)) + p["e"][j]) for j in range(12)]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(12))) * sig(sum(h[i] * p["U"][i, j] for i in range(12))) for j in range(8)]
            hidden.append(h)
            logits.append(sum(a * b for a, b in zip(gate, p["w"])))
        a = [math.exp(v - max(logits)) for v in logits]
        z = [sum(w * h[j] for w, h in zip(a, hidden)) / sum(a) for j in range(12)]
        return sig(sum(x * y for x, y in zip(z, p["c"])) + float(p["b"][0])), a.index(max(a))

    _, odd = made(spark)
    some = d.select("doc_id", "text").where("length(text) < 4000").limit(60).unionByName(odd.select("doc_id", "text").where("text is null or length(text) < 2000").limit(30))
    for r in mil.score_quality(some, model).collect():
        s, k = plain(r["text"])
        assert abs(r["score"] - s) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["attended"] == k
    rows = mil.quality_of_documents(d, labels).collect()
    assert len(rows) == d.count() and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    assert np.array_equal(mil.passages("Ab 1. é\n" * 5000, block=7), mil.passages("Ab 1. é\n" * 5000))


def test_quality_held_out(spark):
    d, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = mil.quality_of_documents(d, labels).where("held_out").join(labels, "doc_id")
    right, n = out.where("predicted = quality").count(), out.count()
    assert n > 50 and right / n > 0.9


def test_language_query_equals_a_plain_recurrence(spark):
    net = langid.train([b"ein haus am see und der wald", b"una casa en la playa", b"the house at the lake"], ["de", "es", "en"], steps=60, batch=24)
    texts = ["das haus am see " * 9, "una casa " * 20, "the lake", "é", "12", "", None]
    soft = lambda v: v / (1 + np.abs(v))

    def plain(text):
        raw = text.encode()
        total = np.zeros(3)
        for at in range(0, len(raw), 48):
            window = raw[at : at + 48] + bytes(max(0, 48 - len(raw[at : at + 48])))
            sides = []
            for d in (0, 1):
                h, out = np.zeros(8, np.float32), [None] * 48
                for t in range(48) if d == 0 else range(47, -1, -1):
                    c = window[t]
                    z = (1 + soft(net.table[d][0][c] + h @ net.recur[d][0])) / 2
                    r = (1 + soft(net.table[d][1][c] + h @ net.recur[d][1])) / 2
                    n = soft(net.table[d][2][c] + (r * h) @ net.recur[d][2])
                    h = z * h + (1 - z) * n
                    out[t] = h
                sides.append(out)
            for t in range(min(48, len(raw) - at)):
                y = net.out @ np.concatenate([sides[0][t], sides[1][t]]) + net.bias
                total += np.exp(y) / np.exp(y).sum()
        return net.labels[int(total.argmax())], total.max() / total.sum()

    rows = langid.identify(docs(spark, list(enumerate(texts))), net).collect()
    for r in rows:
        if r["text"] and any(c.isalpha() for c in r["text"]):
            lang, score = plain(r["text"])
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert 1 / 3 <= langid.least_score(net, [t for t in texts if t]) < 1


def test_media_columns_equal_hashlib(spark):
    rows, df = made(spark)
    rows += [(900, "x" * 576), (901, "é" * 288), (902, "a\x00b" * 40_000)]
    out = matroska.media_features(docs(spark, rows)).collect()
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        x = [c - 128 for c in payload]
        want.setdefault(i, []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])), len(payload) // 576, t))
    media = {r["text"]: r["media"] for r in matroska.encode_texts(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    for r in out:
        found = [w for w in want[r["doc_id"]] if (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == w[:4]]
        assert found
        *_, changes, packets, t = found[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[t]), hashlib.sha256(media[t]).hexdigest())
        assert f"packets={packets};" in r["feature"] and r["feature"].endswith(f"changes={changes}")


def test_personal_data_columns(spark):
    g = random.Random(3)
    parts = ["a.b@c.de", "10.0.0.7", "4111 1111 1111 1111", "+1 (774) 555-2163", "word", "é😀", "5"]
    rows = [(i, " ".join(g.choice(parts) for _ in range(8))) for i in range(40)] + [(50, None), (51, "")]
    for r in pii.personal_data(docs(spark, rows)).collect():
        spans = base_spans(dict(rows)[r["doc_id"]])
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        every = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in spans} <= set(every)
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def luhn_number(g, n):
    head = "".join(g.choice("123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(head + c))) % 10 == 0)


def corpus(g, n=400):
    word = lambda: "".join(g.choice("abcdefghijklm") for _ in range(g.randrange(2, 8)))
    some = [lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(g.randrange(1, 256)) for _ in range(4)), lambda: luhn_number(g, 16), lambda: f"+1 ({g.randrange(200, 999)}) 555-{g.randrange(1000, 9999)}"]
    return [(i, " ".join(word() for _ in range(12)) + " " + some[i % 4]() + " " + " ".join(word() for _ in range(5))) for i in range(n)], word


def test_boosted_trees_find_disguised_items_and_leave_look_alikes(spark):
    g = random.Random(11)
    rows, word = corpus(g)
    models = pii.fit(docs(spark, rows))
    for k in pii.KINDS:
        assert models[k].trees and models[k].threshold <= 1 and models[k].precision >= 0.95 and models[k].recall >= 0.8, k
    card = luhn_number(g, 16)
    wrong = card[:-1] + str((int(card[-1]) + 4) % 10)
    fours = lambda c, by: by.join(c[i : i + 4] for i in range(0, 16, 4))
    hidden = [("email", "jane.doe [at] mail [dot] com"), ("email", "jane(at)mail.org"), ("email", "joe at mail dot net"), ("ip", "10[.]0[.]3[.]44"), ("ip", "192(dot)168(dot)1(dot)20"), ("card", fours(card, ".")), ("card", fours(card, "/")), ("phone", "(212) 555-0187"), ("phone", "0049 30 5557712")]
    alike = [fours(wrong, "."), wrong, "we met at noon.Then", "at 10.30", "2024-05-17 10:30", "1 234 567", "978-3-16-148410-0", "999.12.13.14"]
    planted = [(1000 + i, f"{word()} {word()} {s} {word()} {word()}") for i, (_, s) in enumerate(hidden)]
    planted += [(2000 + i, f"{word()} {word()} {s} {word()} {word()}") for i, s in enumerate(alike)]
    out = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["all_spans"]] for r in pii.find_spans(docs(spark, planted), models).collect()}
    for i, item in enumerate(hidden):
        assert out[1000 + i] == [item], (item, out[1000 + i])
    for i, s in enumerate(alike):
        assert not out[2000 + i], (s, out[2000 + i])
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, planted), models).collect()}
    assert all(f"[{k.upper()}]" in red[1000 + i] and s not in red[1000 + i] for i, (k, s) in enumerate(hidden))


def test_personal_data_in_one_long_text(spark):
    models = {k: pii.Boosted() for k in pii.KINDS}
    text = "é a@b.cd " * 200_000
    df = docs(spark, [(1, text), (2, "+1 2 3 4 5 6 7 8 " * 5000)])
    rows = {r[0]: r for r in pii.find_spans(df, models).select("doc_id", F.size("base_spans"), F.get("base_spans", F.lit(199_999))).collect()}
    assert rows[1][1] == 200_000 and tuple(rows[1][2]) == ("email", 199_999 * 9 + 2, 200_000 * 9 - 1)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, models).collect()}
    assert red[1] == "é [EMAIL] " * 200_000


def test_overlapping_kinds_are_redacted_whole(spark):
    models = {k: pii.Boosted() for k in pii.KINDS}
    rows = [(1, "x 4111 1111 1111 1111@mail.com y"), (2, "+1.2.3.44.5555"), (3, "a@1.2.3.4 b"), (4, "\x01a@b.cd\x02 \x01"), (5, None)]
    df = docs(spark, rows)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, models).collect()}
    assert red == {1: "x [CARD] y", 2: "[PHONE]", 3: "[EMAIL] b", 4: "\x01[EMAIL]\x02 \x01", 5: None}


def test_bounded_sample_ignores_repeats_and_order(spark):
    rows = [(i % 500, f"t{i % 7}") for i in range(4000)] + [(None, "x")] + [(7, "t1")] * 3000
    a = bounded_sample(spark.createDataFrame(rows, "k long, v string"), "k", 50).collect()
    b = bounded_sample(spark.createDataFrame(rows[::-1], "k long, v string").repartition(5), "k", 50).collect()
    assert len(a) == 50 and sorted(a) == sorted(b) and len({r["k"] for r in a}) == 50
    assert bounded_sample(spark.createDataFrame([], "k long, v string"), "k", 50).count() == 0
