import random

from pyspark.sql import functions as F

from visionloom.llm import simhash


def plain(links):
    group = {}
    for a, b in links:
        group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return group


def test_components_equal_brute_force(spark):
    g = random.Random(3)
    cases = [[], [(1, 1)], [(5, 4), (4, 5), (5, 5)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)], [(i, 99) for i in range(50)]]
    cases += [[(g.randrange(60), g.randrange(60)) for _ in range(g.randrange(5, 70))] for _ in range(4)]
    cases.append([(i, i + 7) for i in range(0, 80, 2)] + [(i, 100 - i) for i in range(20)])
    for links in cases:
        df = spark.createDataFrame(links, "a long, b long")
        want = plain([x for x in links if x[0] != x[1]])
        got = simhash.components(df).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want), links
    first, more = cases[-2], [(200, 3), (201, 202), (5, 40), (7, 7)]
    found = simhash.components(spark.createDataFrame(first, "a long, b long"))
    got = simhash.with_links(found, spark.createDataFrame(more, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == plain([x for x in first + more if x[0] != x[1]]) and len({r["node"] for r in got}) == len(got)


def test_fingerprints_that_share_a_long_stretch(spark):
    g = random.Random(8)
    top = 0x1234ABCD << 32
    prints = [top | g.getrandbits(32) for _ in range(3000)]
    prints += [p ^ (1 << g.randrange(32)) ^ (1 << g.randrange(32)) for p in prints[:200]]
    prints = sorted(set(prints))
    near = [(a, b) for i, a in enumerate(prints[:]) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    want = plain(near)
    df = spark.createDataFrame([(p,) for p in prints], "f long")
    got = {r["node"]: r["component"] for r in simhash.linked(df).collect()}
    assert got == want
    keyed = simhash.block_keys(df)
    apart = simhash.apart_links(keyed, spark.createDataFrame([], "node long, component long"), hot=100)
    assert {(max(r), min(r)) for r in map(tuple, apart.collect())} == {(max(x), min(x)) for x in near}
    assert apart.count() == len(near) and apart.where(F.expr("a >= b")).count() == 0
