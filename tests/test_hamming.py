import random

from visionloom.operators import hamming


def signed(v):
    return v - (v >> 63 << 64)


def test_pairs_equal_brute_force_whatever_is_divided(spark):
    g = random.Random(6)
    base = [g.getrandbits(64) for _ in range(60)] + [0x77777777 << 32 | g.getrandbits(32) for _ in range(150)]
    near = [x ^ sum(1 << b for b in g.sample(range(64), k)) for x in base[:100] for k in (1, 3, 6, 7)]
    rows = list(enumerate(base + near + base[:20] * 3)) + [(9999, None)]
    rows = [(i, None if v is None else signed(v)) for i, v in rows]
    df = spark.createDataFrame(rows, "id long, fp long")
    known = [(i, v) for i, v in rows if v is not None]
    for d in (2, 6):
        want = {(i, j, k) for i, v in known for j, w in known if i < j and (k := ((v ^ w) & (1 << 64) - 1).bit_count()) <= d}
        got = [tuple(r) for r in hamming.near_duplicate_pairs(df, d).collect()]
        assert set(got) == want and len(got) == len(want)
        rep = {}
        for i, v in known:
            rep.setdefault(v, i)
        pairs = {(i, j, k) for i, j, k in want if k and rep[dict(known)[i]] == i and rep[dict(known)[j]] == j}
        for hot in (3, 1000):  # with keys that are divided, and without
            got = [tuple(r) for r in hamming.near_representatives(df, d, hot).collect()]
            assert set(got) == pairs and len(got) == len(pairs)
        assert {r["id"]: r["rep"] for r in hamming.membership(df).collect()} == {i: rep[v] for i, v in known}
        links = {r["id"]: (r["rep"], r["copies"], r["links"]) for r in hamming.near_links(df, d).collect()}
        count = lambda v: sum(w == v for _, w in known)
        assert links == {i: (rep[v], count(v), sum(k > 0 and i in (a, b) for a, b, k in want)) for i, v in known}
    assert hamming.near_duplicate_pairs(df.limit(0)).count() == 0


def test_a_million_prints_of_which_half_are_equal(spark):
    one = spark.range(500_000).selectExpr("id", "7L fp")
    rest = spark.range(500_000, 1_000_000).selectExpr("id", "xxhash64(id) fp")
    assert hamming.membership(one.union(rest)).where("rep = 0").count() == 500_000
    few = one.union(rest.where("id < 520000"))
    out = hamming.near_links(few, 6)
    assert out.count() == 520_000 and out.selectExpr("max(copies)").first()[0] == 500_000


def test_ids_of_one_print_are_dealt_out_and_keep_their_links(spark):
    rows = [(i, 5 if i < 300 else signed(i * 0x9E3779B97F4A7C15 % (1 << 64))) for i in range(340)] + [(900, 4), (901, 7), (902, None)]
    df = spark.createDataFrame(rows, "id long, fp long")
    for many in (7, 1 << 18):
        got = sorted(map(tuple, hamming.membership(df, many).collect()))
        assert got == [(i, 0 if v == 5 else i) for i, v in rows if v is not None]
        links = {r["id"]: (r["rep"], r["copies"], r["links"]) for r in hamming.near_links(df, 2, many).collect()}
        assert len(links) == 342 and links[7] == (0, 300, 2) and links[900] == (900, 1, 301) and links[901] == (901, 1, 301) and links[320] == (320, 1, 0)


def test_keys_are_dealt_by_their_number_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hamming, "ROWS", 1000)
    df = spark.range(4000).selectExpr("id", "xxhash64(id div 2) ^ (id % 2) fp")
    out = hamming.representative_pairs(hamming.representatives(df).select("fp"), 6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan
    assert out.where("distance = 1").count() == 2000


def test_the_first_agreement_of_a_pair(spark):
    masks = hamming.block_masks(8)
    g = random.Random(2)
    rows = []
    for _ in range(200):
        a = g.getrandbits(64)
        b = a ^ sum(1 << i for i in g.sample(range(64), 6))
        agreed = [i for i, m in enumerate(masks) if (a ^ b) & m == 0]
        for s in hamming.agreeing(8, 2):
            if set(s) <= set(agreed):
                rows.append((sum(1 << i for i in s), signed(a), signed(b), list(s) == agreed[:2]))
    df = spark.createDataFrame(rows, "s int, a long, b long, want boolean")
    assert df.where(hamming.meets_first("s", "a", "b", masks) != df["want"]).count() == 0 and df.where("not want").count() > 50


def test_findings_of_near_copies_broadcast_no_keys(spark):
    from visionloom.operators import clean

    images = spark.range(60).selectExpr("concat('o', id) uid", "CASE WHEN id % 3 = 0 THEN 'train' WHEN id % 3 = 1 THEN 'val' END split", "id ord")
    prints = images.selectExpr("uid id", "xxhash64(ord div 2) ^ (ord % 2) fp")
    out = clean.near_duplicates(images, prints)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["image_uid"], r["rule"], r["n"]) for r in out.collect()} == {(f"o{i + 1}", "leak_near_duplicate_across_splits" if i % 3 == 0 else "image_duplicate_near", 1) for i in range(0, 60, 2)}


def test_findings_of_near_copies_join_images_once_a_side(spark):
    from visionloom.operators import clean

    split = ["train", "val", "test", None]
    images = spark.range(77).selectExpr("concat('o', id) uid", "get(array('train', 'val', 'test'), CAST(id % 4 AS INT)) split", "(id * 5) % 11 ord")
    prints = spark.range(90).selectExpr("concat('o', id) id", "xxhash64(id div 6) ^ shiftleft(1L, CAST(id % 3 AS INT)) fp")  # some have no image
    want = []
    for i in range(77):
        for j in range(i + 1, min(77, i // 6 * 6 + 6)):
            s, t = split[i % 4], split[j % 4]
            rule = "leak_near_duplicate_across_splits" if s and t and s != t else "image_duplicate_near"
            want.append((rule, max((k * 5 % 11, f"o{k}") for k in (i, j))[1], 0 if i % 3 == j % 3 else 2))
    out = clean.near_duplicates(images, prints)
    assert sorted((r["rule"], r["image_uid"], r["n"]) for r in out.collect()) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 77") == 2  # once a side of a pair


def test_pairs_of_copies_are_dealt_out_to_tasks_and_none_is_lost(spark):
    rows = [(i, 5) for i in range(60)] + [(100 + i, 4) for i in range(9)] + [(200, 7), (201, signed(0xFFFF << 40)), (202, None)]
    df = spark.createDataFrame(rows, "id long, fp long")
    near = hamming.representative_pairs(hamming.representatives(df).select("fp"), 2)
    known = [r for r in rows if r[1] is not None]
    want = sorted((i, j, k) for i, v in known for j, w in known if i < j and (k := ((v ^ w) & (1 << 64) - 1).bit_count()) <= 2)
    for many in (1, 7, 59, 60, 1 << 10):
        out = hamming.expand_pairs(df, near, many=many).selectExpr("a", "b", "distance", "spark_partition_id() task").collect()
        assert sorted((r["a"], r["b"], r["distance"]) for r in out) == want
        assert many > 7 or len({r["task"] for r in out if r["a"] < 60 and r["b"] < 60}) > 1
    with_more = df.selectExpr("struct(-id ord, id uid) id", "fp")
    out = hamming.expand_pairs(df, near, with_more, 7).selectExpr("b.uid a", "a.uid b", "distance").collect()
    assert sorted(map(tuple, out)) == want
