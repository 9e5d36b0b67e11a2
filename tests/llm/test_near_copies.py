import random
from collections import Counter

from visionloom.llm import shingles
from test_llm import docs


def shingle_words(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts, copies of them with a few words changed, copies of copies, boilerplate, and rows without id or words."""
    g = random.Random(4)
    text = lambda n: [f"w{g.randrange(3000)}" for _ in range(n)]
    rows, line = [], " ".join(text(40))
    for i in range(25):
        t = text(g.choice([3, 6, 40, 200, 700]))
        rows.append(" ".join(t))
        for _ in range(g.randrange(4)):
            t = list(t)
            for _ in range(g.randrange(1, 1 + max(1, len(t) // 50))):
                t[g.randrange(len(t))] = f"x{g.randrange(3000)}"
            rows.append(" ".join(t))
    rows += [line + " " + " ".join(text(n)) for n in (0, 2, 4, 6, 8, 10, 12, 60, 60, 60)] + [rows[0], rows[3].upper(), None, "", " \n"]
    g.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[5] + " "), (None, "all alone and without any id here"), (None, "all alone and without any id here"), (None, None)]


def test_near_copies_equal_brute_force(spark):
    rows = planted()
    sets, group = [shingle_words(t) for _, t in rows], list(range(len(rows)))
    near = [(i, j, s) for i in range(len(rows)) for j in range(i) if (s := similarity(sets[i], sets[j])) >= 0.8]
    assert sum(s < 0.95 for *_, s in near) > 15
    for _ in rows:
        for i, j, _ in near:
            group[i] = group[j] = min(group[i], group[j])
    want = Counter()
    for k in set(group):
        ids = [i for (i, _), c in zip(rows, group) if c == k and i is not None]
        want[min(ids) if ids else None] += 1
    df = docs(spark, rows)
    assert Counter(r["doc_id"] for r in shingles.first_of_near_copies(df).collect()) == want
    assert shingles.first_of_near_copies(df.limit(0)).count() == 0


def test_a_bridge_between_groups_and_the_order_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "COMMON", 2)
    w = [f"w{i}" for i in range(100)]
    chain = [" ".join([f"y{k}"] * (2 * k) + w[2 * k :]) for k in range(12)]  # only neighbours are similar
    df = docs(spark, list(enumerate(chain)))
    s = [shingle_words(t) for t in chain]
    assert similarity(s[0], s[11]) < 0.8 <= min(similarity(s[i], s[i + 1]) for i in range(11))
    assert [r["doc_id"] for r in shingles.first_of_near_copies(df).collect()] == [0]


def test_the_pipeline_drops_near_copies(spark):
    import corpus_pipeline as P

    rows = planted()
    rows = [r for r in rows if r[0] is not None]
    kept = P.near_duplicates(spark, docs(spark, rows), "").collect()
    sets = [shingle_words(r["text"]) for r in kept]
    assert not any(similarity(sets[i], sets[j]) >= 0.8 for i in range(len(sets)) for j in range(i))


def test_odd_bits_lose_no_similar_pair_and_drop_a_crowd(spark):
    from pyspark.sql import functions as F

    g = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in [2] * 20 + [9] * 40:  # a few words changed, and so many that pairs are less similar than 0.8
        t = list(base)
        for at in g.sample(range(150), n):
            t[at] = f"x{g.randrange(10**6)}"
        texts.append(" ".join(t))
    prints = shingles.with_prefix(docs(spark, list(enumerate(texts)))).select("doc_id", "n", *shingles.ODD)
    a, b = (prints.toDF(f"{p}id", f"{p}n", *[f"{p}{c}" for c in shingles.ODD]) for p in "xy")
    kept = {(r["xid"], r["yid"]) for r in a.join(b, F.expr("xid < yid")).where(shingles._odd_enough("x", "y", "xn", "yn")).collect()}
    sets = [shingle_words(t) for t in texts]
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if similarity(sets[i], sets[j]) >= 0.8}
    assert near and near <= kept and len(kept - near) < 200
    assert len({(i, j) for i in range(20, 60) for j in range(i + 1, 60)} & kept) < 80  # of 780
