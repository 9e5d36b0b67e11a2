import hashlib
import math
import random
import re
import zlib
from bisect import bisect
from collections import Counter, defaultdict

import duckdb
import numpy as np

from visionloom.llm import lexical, linededup, queries, runs

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, n_lines string, k1 string, runs string, n string, terms string, __id string, collapsed string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "a", "b", "c", "d", "e", "f", "g") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same_as_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(map(tuple, got.select(*want.columns).collect()))
    assert rows == Counter(want.fetchall()) and rows


def common_lines(rows):
    """(n_lines, n_dropped, kept text) per row, line by line; rows without an id are one document by text."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    who = lambda i, t: (i is not None, i if i is not None else t or "")
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(who(i, t))
    out = []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            ids = held.get(key(line), ())
            top = max((x for x in ids if x[0]), default=None)
            if len(ids) < 3 or (who(i, t) == top if top else False):
                kept.append(line)
            elif not top:
                kept.append(None)  # held by rows without an id alone: one of these texts keeps it
        out.append((i, t, (t or "").count("\n") + 1, kept))
    return out


def test_common_lines_equal_brute_force(spark):
    g = random.Random(7)
    long = [f"A Line that Many documents hold {k} é" for k in range(6)] + ["exactly twenty chars", "nineteen characters", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    rows = []
    for i in range(60):
        lines = [g.choice(["\t", "", " \v"]) + (x if g.random() < 0.7 else x.lower()) + g.choice(["", "\r", "  "]) for x in g.choices(long, k=g.randrange(0, 6))]
        lines += [f"own line of document number {i} {k}" for k in range(g.randrange(3))] + [""] * g.randrange(2)
        g.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(3, rows[4][1]), (5, rows[5][1]), (70, None), (71, ""), (72, "\n\n"), (None, "\n".join(long)), (None, None), (80, "\n".join([long[0]] * 20_000)), (81, long[0] + "\n" + "x" * 100_000)]
    out = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.without_common_lines(docs(spark, rows)).collect()]
    want = [(i, None if t is None else "\n".join(x for x in kept), n, n - len(kept)) for i, t, n, kept in common_lines(rows)]
    assert Counter(out) == Counter(want)
    kept = linededup.deduplicated_lines(docs(spark, rows))
    assert Counter(map(tuple, kept.collect())) == Counter((i, n, d, sha(t or "")) for i, t, n, d in want)
    full = linededup.without_common_lines(docs(spark, rows))
    assert {"lang", "k1", "__id"} <= set(full.columns) and full.where("lang = 'xx' and k1 = 'b' and __id = 'f'").count() == len(rows)
    assert linededup.without_common_lines(docs(spark, rows).limit(0)).count() == 0


def test_lines_without_ids_stay_once(spark):
    line = "a line that is held by rows without an id"
    rows = [(None, f"{line}\n{k}") for k in range(4)] * 2
    out = [r["text"] for r in linededup.without_common_lines(docs(spark, rows)).collect()]
    assert sum(line in t for t in out) == 2 and len({t for t in out if line in t}) == 1  # one text, which two rows have


def test_lines_equal_sql(spark):
    same_as_sql(spark, "op11_line_dedup")


def brute_runs(w, least):
    """Runs by their definition, period by period."""
    out = {}
    for d in range(1, len(w) // 2 + 1):
        i = 0
        while i + d < len(w):
            if w[i] != w[i + d]:
                i += 1
                continue
            j = i
            while j + d < len(w) and w[j] == w[j + d]:
                j += 1
            if j - i >= d:
                out.setdefault((i, j + d), d)
            i = j
    return sorted((a, b - a, d) for (a, b), d in out.items() if b - a >= max(least, 2 * d))


def test_runs_equal_brute_force():
    g = random.Random(11)
    cases = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 6, ["a"] * 3000, list("abaababaabaababaababa" * 3)]
    x, y = ["a"], ["b", "a"]
    for _ in range(9):  # Fibonacci words hold the most runs
        x, y = y, y + x
    cases.append(y)
    for _ in range(400):
        k = g.randrange(1, 4)
        w = [g.choice("abc"[:k]) for _ in range(g.randrange(1, 60))]
        if g.random() < 0.6:
            p = [g.choice("abcd") for _ in range(g.randrange(1, 9))]
            at = g.randrange(len(w) + 1)
            w[at:at] = (p * 9)[: g.randrange(2, 40)]
        cases.append(w)
    for w in cases:
        for least in (2, 12):
            want = brute_runs(w, least)
            assert runs.word_runs([c.encode() for c in w], least) == want, (w, least)
    w = np.array([g.randrange(30) for _ in range(400)] + list(range(40)) * 3 + [g.randrange(2) for _ in range(200)], np.int32)
    assert sorted((a, b - a, d) for a, b, d in runs.seeded_runs(w)) == brute_runs(w.tolist(), 2)
    parts = runs.repetitive(w, 12)
    assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in brute_runs(w.tolist(), 12)) and sum(b - a for a, b in parts) < len(w)


def test_an_ordered_set_in_blocks():
    g = random.Random(1)
    for order in (list(range(5000)), list(range(5000, 0, -1)), g.sample(range(9000), 5000)):
        held, plain = runs.Positions(order[0]), [order[0]]
        for x in order[1:]:
            k = bisect(plain, x)
            assert held.add(x) == (plain[k - 1] if k else -1, plain[k] if k < len(plain) else -1)
            plain.insert(k, x)
        assert list(held) == plain and held.n == len(order)


def test_periodic_query_equals_brute_force(spark):
    g = random.Random(3)
    rows = [(i, " ".join(g.choice(["x", "y", "Zé", "w"]) for _ in range(g.randrange(0, 90)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a b " * 10), (None, None), (7, rows[7][1]), (203, "la " * 60_000), (204, " ".join(map(str, range(30_000))))]
    out = Counter(map(tuple, runs.periodic_runs(docs(spark, rows)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + math.floor((len(w) - a) / (3 + h // 10 % 8))
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = brute_runs(w, 12) if len(w) < 1000 else [(0, len(w), 1)] if w[0] == w[1] else []
        gone = {k for s, n, d in found for k in range(s + d, s + n)}
        best = min(((-n, s, d) for s, n, d in found), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want[(i, len(found), *first, sha("".join(f"{s},{n},{d}\n" for s, n, d in sorted(found, key=lambda r: (r[0], r[2])))), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert out == want and sum(k[1] > 0 for k in want) > 5
    assert runs.periodic_runs(docs(spark, rows).limit(0)).count() == 0
    kept = runs.with_runs(docs(spark, rows))
    assert dict(kept.dtypes)["runs"].startswith("array") and kept.where("k1 = 'b'").count() == len(rows)


def brute_search(rows, items, k=10):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in rows]
    total, n_docs = sum(map(len, words)), sum(map(bool, words))
    df = Counter(w for ws in words for w in set(ws))
    wanted = defaultdict(set)
    for i, t in items:
        if t is not None:
            wanted[i].update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        found = []
        for (i, _), ws in zip(rows, words):
            tf, m = Counter(ws), 100 - 90 + 90 * len(ws) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def test_search_equals_brute_force(spark):
    g = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["Été", "ΣΑΣ", "a1", "ｆ"]
    text = lambda n: g.choice([" ", ", ", "-_"]).join(g.choice(words[: g.randrange(1, 44)]) for _ in range(n))
    rows = [(i * 7 - 100, text(g.randrange(0, 30))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "...!"), (None, text(9)), (None, None), (rows[3][0], rows[3][1]), (1003, "w1 " * 50_000)] + [(2000 + k, "w2 w3 same") for k in range(30)]
    items = [(k, text(g.randrange(1, 9))) for k in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "SAME w2"), (33, "w4"), (None, "w5 w6"), (34, "w1 w1 W1")]
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, score string")
    want = brute_search(rows, items)
    for block in (200_000, 5):  # one block, and many
        assert Counter(map(tuple, lexical.search(docs(spark, rows), bench, block_words=block).collect())) == want
    assert all(k == 1 for k in want.values())
    assert lexical.search(docs(spark, rows).limit(0), bench).count() == 0
    assert lexical.search(docs(spark, rows), bench.limit(0)).count() == 0
    queries_ = [(0, [(0, 5)])]
    segment = lexical.Segment(queries_, 100, 1000, 3)
    for at in range(0, 40, 8):  # windows far smaller than a segment share its heaps
        segment.take(list(range(at, at + 8)), np.full(8, 10), np.arange(8), np.zeros(8, np.int32), np.array([(at + k) % 7 + 1 for k in range(8)], np.int32))
    assert [i for _, i, s in sorted(segment.best(), key=lambda x: (-x[2], x[1]))] == [6, 13, 20]


def test_search_equals_sql(spark):
    same_as_sql(spark, "op13_lexical_search")
