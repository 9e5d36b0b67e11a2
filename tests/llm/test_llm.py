import io
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from visionloom.llm import decontaminate as D
from visionloom.llm import langid, matroska, mil, packing, pii, sharding, simhash, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string, spans string, media string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "m") for i, t in texts], DOCS)


def made(spark):
    g = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "Théta"]
    texts = [" ".join(g.choice(words) for _ in range(g.randrange(1, 60))) for _ in range(40)]
    texts += [t.replace("eta", "Eta") for t in texts[:10]] + texts[:5] + [texts[7] + " end", None, "", "  \n", "word " * 20_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (None, None)]
    return rows, docs(spark, rows)


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_and_slots(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r[0]: (r[1], r[2]) for r in df.select("k", sharding.jump_bucket(F.col("k"), 24), sharding.jump_bucket(F.col("k"), 25)).collect()}
    assert got == {k: (jump(k, 24), jump(k, 25)) for k in keys}
    assert all(a == b or b == 24 for a, b in got.values())
    rows, df = made(spark)
    out = sharding.shard_documents(df).collect()
    assert len(out) == len(rows)
    for s in {r["shard"] for r in out}:
        mine = sorted(r["slot"] for r in out if r["shard"] == s)
        assert mine == list(range(len(mine)))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_matroska(spark):
    rows, df = made(spark)
    out = matroska.media_features(df).collect()
    assert len(out) == len(rows)
    for _, t in rows:
        raw, _ = matroska.padded(t)
        media = matroska.mux(raw)
        packets = matroska.demux(media)
        assert matroska.packet_bytes(media, packets) == raw and all(p[7] for p in packets)
        assert [p[1] for p in packets] == sorted(p[1] for p in packets)
    media = matroska.encode_texts(df)
    assert matroska.packet_table(media, "doc_id").where("error is not null").count() == 0
    broken = media.limit(1).withColumn("media", F.expr("substring(media, 1, length(media) - 30)"))
    assert matroska.packet_table(broken, "doc_id").where("error is not null").count() == 1
    xiph = bytes([2, 255, 45, 10]) + bytes(300) + bytes(10) + bytes(7)
    assert matroska.lace_sizes(xiph, 0, len(xiph), 1) == ([300, 10, 7], 4)
    ebml = bytes([2, 0x40 | 500 >> 8, 500 & 255, 0x5F, 0xF9]) + bytes(500 + 494 + 9)  # the second is 6 bytes shorter
    assert matroska.lace_sizes(ebml, 0, len(ebml), 3) == ([500, 494, 9], 5)


def test_near_duplicates_equal_brute_force(spark):
    rows, df = made(spark)
    prints = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (i, _), k in zip(rows, group):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    want = Counter((i, f"{p:016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, group))
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    assert {r["node"]: r["component"] for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_groups(n, near):
    """The smallest member that each of n reaches over pairs for which near(i, j)."""
    group = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if near(i, j)]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return group


def test_linked_fingerprints_equal_brute_force(spark):
    g = random.Random(2)
    base = [g.getrandbits(64) for _ in range(50)]
    all_ = list({x ^ sum(1 << b for b in g.sample(range(64), k)) for x in base for k in (0, 1, 2, 3, 4, 5)})
    chain = [0]
    for i in range(0, 63, 3):  # each three bits from the last: one group, of which only neighbours are near
        chain.append(chain[-1] | 7 << i)
    all_ = sorted({x - (x >> 63 << 64) for x in all_ + chain + [1 << b for b in range(20)]})
    want = brute_groups(len(all_), lambda i, j: ((all_[i] ^ all_[j]) & (1 << 64) - 1).bit_count() <= 3)
    got = {r["node"]: r["component"] for r in simhash.linked(spark.createDataFrame([(x,) for x in all_], "f long"), 3).collect()}
    assert {x: got.get(x, x) for x in all_} == {x: all_[k] for x, k in zip(all_, want)}
    many = Counter(want)
    assert set(got) == {x for x, k in zip(all_, want) if many[k] > 1}
    pairs = simhash.pivot_links(simhash.block_keys(spark.createDataFrame([(1 << b,) for b in range(40)], "f long"))).count()
    assert pairs < 40 * 20  # of 780 near pairs only those with the smallest under a key


def test_a_null_id_bridges_groups(spark):
    g = random.Random(1)
    body = [f"w{g.randrange(500)}" for _ in range(150)]
    prints = {t: simhash.fingerprint(t) for t in (" ".join(body[: 150 - k]) for k in range(60))}
    far = lambda x, y: (prints[x] ^ prints[y]).bit_count()
    a, b, c = next((x, y, z) for y in prints for x in prints for z in prints if 0 < far(x, y) <= 3 and 0 < far(y, z) <= 3 < far(x, z))
    rows = spark.createDataFrame([(7, a), (None, b), (9, c), (None, "alone"), (None, "alone")], "doc_id long, text string")
    out = Counter(map(tuple, simhash.near_duplicates(rows).collect()))
    hexed = lambda t: f"{simhash.fingerprint(t):016x}"
    assert out == Counter({(7, hexed(a), 7): 1, (None, hexed(b), 7): 1, (9, hexed(c), 7): 1, (None, hexed("alone"), None): 2})


def test_packing(spark):
    from tokenizers import Tokenizer

    rows, df = made(spark)
    tok = Tokenizer.from_file(packing.default_vocabulary())
    odd = ["L'été d'Élan, it's 12.5%!! © x　y", "<|endoftext|> a", "\x01 b \x01c", "ǅ İ Σας ΣΑΣ", "á é.", "ﬁne, ßÿ… naïve|", "tab\tcr\rff\x0c.\n\n"]
    encode = packing.word_tokenizer(packing.default_vocabulary())
    for t in odd + [t or "" for _, t in rows]:
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    out = packing.pack_documents(df).collect()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, k, k * 2048, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(n for b in bins.values() for _, n in b) // 2048) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_minimum_bin_slack_is_exact_on_small_cases():
    g = random.Random(4)
    for _ in range(50):
        counts = {n: g.randrange(1, 5) for n in g.sample(range(1, 30), 8)}
        used = Counter()
        for recipe, bins in packing.minimum_bin_slack(counts, 30):
            assert sum(n * k for n, k in recipe) <= 30
            used.update({n: k * bins for n, k in recipe})
        assert used == Counter(counts)


def test_language_held_out(spark):
    from visionloom.llm.common import table

    d = table(spark, DATA, "documents")
    out = langid.language_of_documents(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.where("lang = lang_pred").count(), out.count()
    assert n and right / n > 0.9
    _, odd = made(spark)
    empty = langid.identify(odd, None)
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}
    net = langid.train([b"aaaa bbbb", b"cccc dddd"], ["x", "y"], steps=40, batch=16)
    assert [x[0] for x in langid.score_texts(net, [None, "", "12 !", "aa ab", "cd cc"])] == ["und", "und", "und", "x", "y"]


def test_gradients_of_the_recurrent_network():
    net = langid._blank(["x", "y"], 1)
    net.table, net.recur = [t.astype(np.float64) for t in net.table], [t.astype(np.float64) for t in net.recur]
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    x, y = np.random.default_rng(0).integers(1, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        p = net.probabilities(x)
        return -np.mean([np.log(p[y[b], t, b]) for t in range(6) for b in range(4)])

    grads = langid._gradients(net, x, y)
    for p, d in zip([*net.table, *net.recur, net.out, net.bias], grads):
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        keep = p[i]
        p[i] = keep + 1e-2
        up = loss()
        p[i] = keep - 1e-2
        down = loss()
        p[i] = keep
        assert abs((up - down) / 2e-2 - d[i]) < 0.05 * abs(d[i]) + 1e-4


def test_toxicity_and_quality():
    g = random.Random(3)
    plain = lambda n: " ".join(g.choice(["the", "of", "tree", "house", "river", "stone"]) + ("." if g.random() < 0.1 else "") for _ in range(n))
    rows = [(i, plain(80) + (f" {g.choice(['vilest', 'vilely', 'awful'])} tree. " if i % 4 == 0 else ". ") + plain(80), int(i % 4 == 0)) for i in range(400)]
    score = mil.train_noisy_or(rows).scorer()
    assert score("a river. the vileness here. a stone")[0] > 0.5 > score("a river. the stone. a tree")[0]
    text = "a river. awful tree. a stone."
    (a, b, p), = [h for h in score(text)[1] if h[2] > 0.3]
    assert "awful" in text[a:b] and "stone" not in text[a:b]
    assert 0 <= score(None)[0] < 0.3 and 0 <= score("")[0] < 0.3
    junk = lambda: "".join(g.choice(["ABC!! ", "$$$ ", "### "]) for _ in range(100))
    bags = [(mil.passages(plain(150) if i % 2 else plain(60) + junk()), i % 2) for i in range(300)]
    net = mil.train_attention([b for b, _ in bags], [y for _, y in bags], steps=80)
    s, attention = net.score([mil.passages(plain(120)), mil.passages(plain(60) + junk()), mil.passages(None)])
    assert s[0] > 0.5 > s[1] and abs(attention[1].sum() - 1) < 1e-9


def test_classifiers_over_odd_documents(spark):
    _, df = made(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert mil.quality_of_documents(df, labels).count() == df.count()
    tox = mil.toxicity_of_documents(df, labels)
    assert tox.count() == df.count() and tox.where("score is null or score < 0 or score > 1").count() == 0


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def base_spans(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in re.finditer(p, t or "") if ok[k](m.group())]


def test_personal_data_base_spans(spark):
    rows, _ = made(spark)
    g = random.Random(9)
    parts = ["a.b@c.de", "x@y.z_q@e.f", "1.2.3.4", "300.1.1.1", "0001.002.3.255.7", "4111 1111 1111 1111", "4111111111111112", "+1 (774) 555-2163", "+12", "é😀", " ", "word", "5", "@", ".", "+", "1-2 3", "9" * 3000]
    rows += [(100 + i, "".join(g.choice(parts) for _ in range(12))) for i in range(150)]
    df = docs(spark, rows)
    models = pii.fit(df)
    out = pii.find_spans(df.select("doc_id", "text"), models).collect()
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == base_spans(r["text"]), r["text"]
        assert set(map(tuple, r["base_spans"])) <= set(map(tuple, r["all_spans"]))
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, models).collect()}
    assert red[35] == dict(rows)[35] and all(not base_spans(t) or "[" in t for t in red.values())
    assert pii.personal_data(df).count() == len(rows) and pii.personal_data(df.limit(0)).count() == 0


def test_archives(spark):
    out = io.BytesIO()
    z = warc.ZipWriter(out, zip64=True)
    for name, data in ((warc.DATA, b"abc" * 50), (warc.INDEX, b"")):
        z.begin(name), z.write(data), z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
        assert other.read(warc.DATA) == b"abc" * 50 and other.testzip() is None
    f = io.BytesIO(out.getvalue())
    at, n, how = warc.zip_directory(f, len(out.getvalue()))[warc.DATA]
    assert (out.getvalue()[at : at + n], how) == (b"abc" * 50, 0)
    big = "é" * 700
    rows = [(1, "u", big), (2, "u\r\nX: 1", big), (3, None, None), (4, "v", ""), (5, "v", "x" * 999), (6, "v", "x" * 999), (9, "w", big), (9, "w", big), (None, "w", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.deduplicated_archives(df).collect())
    assert got == Counter([(1, 1400, "revisit", 9), (2, 1400, "revisit", 9), (3, 0, "response", None), (4, 0, "response", None), (5, 999, "response", None), (6, 999, "response", None), (9, 1400, "response", None), (9, 1400, "response", None), (None, 1400, "revisit", 9)])
    assert warc.deduplicated_archives(df.limit(0)).count() == 0


def brute_windows(text, items, window):
    words, hit, names = D.words_of(text), set(), set()
    at = {}
    for k in {min(window, len(D.words_of(t))) for _, t in items} - {0}:
        for j in range(len(words) - k + 1):
            at.setdefault(tuple(words[j : j + k]), []).append(j)
    for name, t in items:
        w = D.words_of(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in at.get(tuple(w[i : i + k]), []):
                hit.update(range(j, j + k))
                names.add(name)
    return len(words), hit, names


def test_windows_equal_brute_force(spark):
    g = random.Random(8)
    text = lambda n: " ".join(g.choice("abc") for _ in range(n))
    items = [(str(i), text(g.randrange(0, 12))) for i in range(12)]
    sam = D.Automaton([(i, D.words_of(t)) for i, t in items], 5)
    for _ in range(300):
        t = text(g.randrange(0, 40))
        spans, names = sam.scan(D.words_of(t))
        n, hit, want = brute_windows(t, items, 5)
        assert ({p for a, b in spans for p in range(a, b)}, names) == (hit, want)
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(99, None), (98, " . ")], "item_id long, text string")
    rows = [(i, text(g.randrange(0, 30)).replace(" ", ", ", 3)) for i in range(20)] + [(50, None), (51, "")]
    for block in (300_000, 20):
        found = D.find_windows(docs(spark, rows), bench, window=5, block_words=block).collect()
        for r in found:
            n, hit, want = brute_windows(r["text"], items, 5)
            assert (r["n_words"], {p for s in r["hit_spans"] for p in range(s["start"], s["end"])}, set(r["hit_items"])) == (n, hit, want)
    kept = D.decontaminate(docs(spark, [(1, "Z z, clean É text"), (2, "head " + items[3][1] + " tail end of it all x y z w q r s t u v"), (3, None)]), bench, window=5).collect()
    assert {r["doc_id"]: r["text"] for r in kept}[1] == "Z z, clean É text"


def test_pipeline_stages(spark):
    """Each stage on a few hundred documents against plain loops that share none of its code."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    d = P.table(spark, DATA, "documents")
    benchmark = [(str(r["item_id"]), r["text"]) for r in P.table(spark, DATA, "benchmark").collect()]
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "benchmark_passages", "personal_data", "packing"]
    taken = {}
    before, rows = d, {r["doc_id"]: r["text"] for r in d.collect()}
    for name, stage in P.STAGES[:-1]:
        after = P.written(stage(spark, before, DATA), name)[0]
        assert after.columns == P.COLUMNS
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        taken[name] = (rows, kept)
        before, rows = after, kept
    was, now = taken["language"]
    langs = {r["doc_id"]: r["lang"] for r in d.collect()}
    lettered = [i for i, t in was.items() if t and any(c.isalpha() for c in t)]
    assert set(now) <= set(lettered) and len(now) > 0.95 * sum(langs[i] is not None for i in lettered)
    was, now = taken["near_duplicates"]
    ids = sorted(was)
    words = [was[i].split() for i in ids]
    sets = [{tuple(bytes(x, "utf-8").lower() for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = brute_groups(len(ids), lambda i, j: len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])))
    assert set(now) == {ids[k] for k in group} and all(was[i] == t for i, t in now.items())
    was, now = taken["benchmark_passages"]
    cuts = 0
    for i, t in was.items():
        n, hit, _ = brute_windows(t, benchmark, 10)
        assert (i in now) == (len(hit) <= 0.8 * n)
        if i in now:
            left = [w for k, w in enumerate(D.words_of(t)) if k not in hit]
            assert D.words_of(now[i]) == left and (hit or now[i] == t)
            cuts += bool(hit)
    assert cuts
    was, now = taken["personal_data"]
    assert set(was) == set(now)
    for i, t in was.items():
        assert not base_spans(now[i]) and (not base_spans(t) or now[i] != t)
    assert sum(now[i] == t for i, t in was.items() if not base_spans(t)) > 0.95 * sum(not base_spans(t) for t in was.values())
    packed = P.STAGES[-1][1](spark, before, DATA).collect()
    tok = Tokenizer.from_file(packing.default_vocabulary())
    size = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == size
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as P

    t, u = "one two three four five six seven", "other words that share nothing with these"
    rows = [(1, t), (1, t), (2, u), (2, t), (None, t), (None, t), (None, "nobody has an id here"), (None, "nobody has an id here")]
    out = P.near_duplicates(spark, docs(spark, rows), "").select("doc_id", "text").collect()
    assert Counter(map(tuple, out)) == Counter([(1, t), (2, u), (None, "nobody has an id here")])


def test_the_pipeline_on_odd_tables(spark):
    import corpus_pipeline as P

    rows, df = made(spark)
    for part in (df, df.limit(0), docs(spark, [(None, None), (1, ""), (1, "")])):
        for _, stage in P.STAGES[1:]:
            stage(spark, part, DATA).count()
        P.language(spark, part, DATA).count()
    P.language(spark, df.withColumn("lang", F.lit("x")), DATA).count()
