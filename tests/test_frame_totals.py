import random

from pyspark.sql import functions as F

from visionloom.sources import formats

FRAMES, INTERVALS = "video long, frame long", "video long, label string, start long, end long"


def test_totals_equal_a_plain_loop(spark):
    g = random.Random(3)
    frames = [(g.choice([0, 1, 2, None]), g.choice([g.randrange(-40, 40), g.randrange(10**12), 5, None])) for _ in range(400)]
    spans = [(g.choice([0, 1, 3, None]), g.choice(["a", "b", "", None]), s, g.choice([s, s - 1, s + 7, 10**12, 2**63 - 1, None])) for s in (g.randrange(-50, 50) for _ in range(300))]
    spans += [(1, "all", -(2**63), 2**63 - 1), (1, "none", 41, 42), (1, "a", None, 9)]
    want = {}
    for v, label, s, e in spans:
        for w, f in frames:
            if None not in (v, s, e, f) and v == w and s <= f <= e:
                n, t = want.get((v, label), (0, 0))
                want[v, label] = n + 1, t + f
    for parts in (1, 7):  # one range, and several
        iv = spark.createDataFrame(spans, INTERVALS).repartition(parts)
        got = formats.frame_label_totals(spark.createDataFrame(frames, FRAMES).repartition(parts), iv, "video")
        assert got.columns == ["video", "label", "n", "total"]
        assert {(r["video"], r["label"]): (r["n"], r["total"]) for r in got.collect()} == want
    assert formats.frame_label_totals(got.select("video", F.col("n").alias("frame")).limit(0), iv, "video").count() == 0


def test_long_intervals_over_many_frames_in_ranges_make_no_pairs(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are four ranges
    try:
        n = 300_000  # 4.5 x 10^10 pairs
        frames = spark.range(n).selectExpr("0L video", "id frame")
        spans = spark.range(n).selectExpr("0L video", "'x' label", "id start", f"{10**12}L end")
        row = formats.frame_label_totals(frames, spans, "video").first()
        assert row["n"] == n * (n + 1) // 2 and row["total"] == sum(f * (f + 1) for f in range(n))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_queries_of_totals_join_nothing(spark):
    from visionloom.plans import queries, record_queries

    known = queries.queries() | record_queries.queries()
    for name in ("openlabel_frames", "openlabel_clipped", "openlabel_long_intervals"):
        assert "Join" not in known[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
