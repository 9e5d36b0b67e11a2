import json
import random

from pyspark.sql import functions as F

from visionloom.functions.scalar import bucket, category_key, make_uid, normalize_split, parse_number
from visionloom.operators import clean, evals, merge, metrics, review, split, taxonomy
from visionloom.sources import formats
from visionloom.streaming.metric_stream import latest_frames, tail_new_epochs

IM = "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long"
AN = "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double"


def messy(spark):
    im = [("a", "a.jpg", "s", 40, 30, "train", "g", "h1", 1), ("b", "b.jpg", "s", 40, 30, "val", "g", "h1", 2), ("c", "c.jpg", "s", 8, 6, None, None, None, 3), ("d", "d.jpg", "s", 0, 6, None, None, "h2", 4)]
    an = [("a", "Closed Eye", "bbox", 35.0, 25.0, 60.0, 50.0, None), ("a", "closed_eye", "bbox", 1.0, 1.0, 1.0, 5.0, None), ("b", "cat", "bbox", 1.0, 1.0, 5.0, 5.0, None), ("a", "cat", "bbox", 1.0, 1.0, 5.0, 5.0, None), ("a", "cat", "bbox", 1.0, 1.0, 5.0001, 5.0, None), ("a", "walk", "image", None, None, None, None, None)]
    return spark.createDataFrame(im, IM), spark.createDataFrame(an, AN)


def test_scalars(spark):
    df = spark.createDataFrame([("Valid", " nan ", "Closed-Eye 1")], "s string, n string, c string")
    r = df.select(normalize_split(F.col("s")), parse_number(F.col("n")), category_key(F.col("c")), make_uid(F.col("s"), F.lit(None)), bucket(F.lit(5), [0, 1, 5, 10])).first()
    assert (r[0], r[1], r[2], len(r[3]), r[4]) == ("val", None, "closedeye1", 16, 2)


def test_every_rule_fires_and_cleaning_settles(spark):
    im, an = messy(spark)
    rules = {r["rule"] for r in clean.findings(im, an).collect()}
    assert {"image_invalid_size", "image_too_small", "leak_duplicate_across_splits", "leak_group_across_splits", "label_out_of_bounds", "label_invalid_size", "label_duplicate", "image_without_annotation", "category_name_variants", "class_too_few"} <= rules
    im2, an2 = clean.apply(im, an)
    assert {r["uid"] for r in im2.collect()} == {"a", "c"}
    rows = an2.where("kind = 'bbox'").collect()
    assert len(rows) == 2 and max(r["x2"] for r in rows) == 40 and max(r["y2"] for r in rows) == 30
    again = {r["rule"] for r in clean.findings(im2, an2).collect()}
    assert not again & {"image_invalid_size", "label_out_of_bounds", "label_invalid_size", "label_duplicate"}


def test_near_duplicates_equal_brute_force(spark):
    g = random.Random(1)
    base = [g.getrandbits(64) for _ in range(60)]
    all_ = base + [x ^ (1 << g.randrange(64)) ^ (1 << g.randrange(64)) for x in base for _ in range(2)]
    signed = [(i, x - (x >> 63 << 64)) for i, x in enumerate(all_)]
    got = {(r["a"], r["b"]) for r in clean.near_duplicate_pairs(spark.createDataFrame(signed, "id long, fp long"), 4).collect()}
    assert got == {(i, j) for i in range(len(all_)) for j in range(i + 1, len(all_)) if (all_[i] ^ all_[j]).bit_count() <= 4} and got


def test_taxonomy(spark):
    im, an = messy(spark)
    s = taxonomy.suggest_merges(an).collect()
    assert [(r["key"], r["total"]) for r in s] == [("closedeye", 2)]
    im2, an2 = taxonomy.apply_mapping(im, an, kind="bbox", keep=["cat"])
    assert an2.count() == 3 and {r["uid"] for r in im2.collect()} == {"a", "b"}
    issues = {(r["name"], r["issue"]) for r in taxonomy.validate_names(spark.createDataFrame([(" x",), ("a/b",), ("..",)], "category string")).collect()}
    assert issues == {(" x", "padded"), ("a/b", "illegal_character"), ("..", "reserved")}


def test_split_keeps_groups_whole(spark):
    im = spark.createDataFrame([(f"i{k}", f"{k}.jpg", "s", 9, 9, None, f"g{k // 3}", None, k) for k in range(300)], IM)
    an = spark.createDataFrame([(f"i{k}", "rare" if k % 50 == 0 else "cat", "image", None, None, None, None, None) for k in range(300)], AN)
    done = split.assign(im, an).cache()
    assert done.groupBy("grp").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    share = {r["split"]: r["images"] / 300 for r in split.report(done).collect()}
    assert abs(share["train"] - 0.8) < 0.05 and abs(share["val"] - 0.1) < 0.05
    key = lambda df: sorted((r["uid"], r["split"]) for r in df.collect())
    assert key(done) == key(split.assign(im, an)) and key(done) != key(split.assign(im, an, seed=8))
    assert split.largest_remainder(10, [0.8, 0.1, 0.1]) == [8, 1, 1]


def test_merge_conflicts(spark):
    im, an = messy(spark)
    other = spark.createDataFrame([("a", "a.jpg", "t", 1, 1, None, None, None, 1), ("b", "other.jpg", "t", 1, 1, None, None, None, 2)], IM)
    boxes = spark.createDataFrame([("a", "x", "image", None, None, None, None, None), ("b", "y", "image", None, None, None, None, None)], AN)
    i2, a2, w = merge.merge((im, an), (other, boxes))
    assert i2.count() == 5 and i2.select("uid").distinct().count() == 5 and w.count() == 1
    moved = a2.where("category = 'y'").first()["image_uid"]
    assert moved != "b" and a2.where("category = 'x'").count() == 0


def test_metrics(spark):
    lines = [(1, 1, "1,2.0,0.4"), (1, 2, "2,1.5,0.3"), (1, 3, "2,1.0,0.5"), (1, 4, "3,,0.6"), (1, 5, "4,1")]
    rows = metrics.parse_results(spark.createDataFrame(lines, "run_id int, arrival long, line string"), ["epoch", "train/loss", "metrics/mAP50(B)"]).cache()
    got = {(r["epoch"], r["metric"]): r["value"] for r in rows.collect()}
    assert got[(2, "metrics/mAP50(B)")] == 0.5 and (3, "train/loss") not in got and not any(e == 4 for e, _ in got)
    assert metrics.best(rows, "metrics/mAP50(B)").first()["epoch"] == 3
    assert metrics.progress(rows, 6).first()["percent"] == 0.5
    assert metrics.headline(rows).where("epoch = 2").first()["train_loss"] == 1.0


def test_evals(spark):
    m = evals.confusion(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "p int, t int"), "p", "t")
    got = {r["name"]: (r["precision"], r["recall"]) for r in evals.class_metrics(m).collect()}
    assert got == {0: (0.5, 1.0), 1: (1.0, 0.5)}
    labels = spark.createDataFrame([(["background", "a", "b"],)], "l array<string>").select(evals.normalize_labels("l").alias("l")).first()["l"]
    assert labels == ["a", "b", "background"]


def test_review_and_manifest(spark):
    frames = spark.createDataFrame([("u", True, [(0, None, 0.9, [0.0, 0.0, 2.0, 2.0]), (5, None, 0.8, [1.0, 1.0, 3.0, 3.0]), (0, None, 0.9, [1.0])]), ("v", False, None)], "uid string, ok boolean, detections array<struct<class_index:int,class_name:string,confidence:double,bbox:array<double>>>")
    boxes = review.frame_annotations(frames, ["cat"]).cache()
    assert sorted(r["category"] for r in boxes.collect()) == ["cat", "class_5"]
    first = boxes.where("category = 'cat'").first()["box_id"]
    edits = spark.createDataFrame([(first, 1, "update", None, "dog", None, None, None, None), ("n", 2, "add", "u", "owl", 0.0, 0.0, 1.0, 1.0)], "box_id string, seq long, op string, image_uid string, category string, x1 double, y1 double, x2 double, y2 double")
    after = {r["category"]: r["review"] for r in review.apply_edits(boxes, edits).collect()}
    assert after == {"dog": "edited", "class_5": "pending", "owl": "added"}
    m = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 0, "")], "path string, size long, sha256 string")
    f = spark.createDataFrame([("b", 3, "h"), ("c", 9, "z")], "path string, size long, sha256 string")
    assert {r["path"]: r["problem"] for r in review.verify_manifest(m, f).collect()} == {"a": "missing", "b": "size", "c": None}


def test_readers_and_export(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/p1.txt").write_text("0 0.5 0.5 0.5 0.5\n\n9 0.1 0.1 0.1 0.1\nbad\n")
    im = spark.createDataFrame([("u1", "images/p1.jpg", "s", 64, 48, "train", None, None, 1)], IM)
    an = formats.yolo_annotations(im, formats.yolo_labels(spark, str(tmp_path / "labels"), ["cat", "dog"])).withColumn("score", F.lit(None).cast("double"))
    r = an.first()
    assert an.count() == 1 and (r["category"], r["x1"], r["y1"], r["x2"], r["y2"]) == ("cat", 16.0, 12.0, 48.0, 36.0)
    classes = spark.createDataFrame([("cat", 0)], "category string, index int")
    assert formats.yolo_lines(im, an, classes).first()["lines"] == "0 0.500000 0.500000 0.500000 0.500000"
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "t/1.jpg", "width": 64, "height": 48}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [10, 5, 20, 10], "iscrowd": 1}, {"id": 2, "image_id": 9, "category_id": 3, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 3, "name": "cat"}]}))
    images, boxes = formats.coco(spark, str(tmp_path / "c.json"))
    b = boxes.first()
    assert images.first()["grp"] == "t" and boxes.count() == 1 and (b["x2"], b["y2"], b["grp"]) == (30.0, 15.0, "iscrowd")
    (tmp_path / "v.xml").write_text("<annotation><filename>1.jpg</filename><size><width>64</width><height>48</height></size><object><name>cat</name><difficult>1</difficult><bndbox><xmin>10</xmin><ymin>5</ymin><xmax>29</xmax><ymax>14</ymax></bndbox></object></annotation>")
    v = formats.voc(spark, str(tmp_path / "v.xml"), one_based=True).first()
    assert (v["x1"], v["y1"], v["x2"], v["difficult"]) == (9.0, 4.0, 29.0, True)
    (tmp_path / "l.json").write_text(json.dumps({"imagePath": "1.jpg", "imageWidth": 64, "imageHeight": 48, "shapes": [{"label": "cat", "shape_type": "rectangle", "points": [[30, 20], [10, 5]]}, {"label": "dog", "shape_type": "circle", "points": [[20, 20], [30, 20]]}, {"label": "x", "shape_type": "line", "points": [[0, 0], [1, 1]]}]}))
    got = {r["category"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in formats.labelme(spark, str(tmp_path / "l.json")).collect()}
    assert got == {"cat": (10.0, 5.0, 30.0, 20.0), "dog": (10.0, 10.0, 30.0, 30.0)}
    (tmp_path / "o.json").write_text(json.dumps({"openlabel": {"actions": {"0": {"type": "act/drive", "frame_intervals": [{"frame_start": 0, "frame_end": 2}]}, "1": {"type": "act/--", "frame_intervals": [{"frame_start": 0, "frame_end": 9}]}}}}))
    iv = formats.openlabel_intervals(spark, str(tmp_path / "o.json"), "act").withColumn("video", F.lit("v"))
    frames = spark.createDataFrame([("v", i) for i in range(5)], "video string, frame long")
    assert formats.frame_labels(frames, iv, "video").count() == 3


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def tail():
        rows = spark.readStream.schema("run_id long, epoch int, value double").json(str(src))
        q = tail_new_epochs(rows).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    (src / "1.json").write_text('{"run_id":1,"epoch":1,"value":0.1}\n{"run_id":1,"epoch":2,"value":0.2}\n')
    tail()
    (src / "2.json").write_text('{"run_id":1,"epoch":2,"value":0.9}\n{"run_id":1,"epoch":3,"value":0.3}\n')
    tail()
    assert sorted((r["epoch"], r["value"]) for r in spark.read.parquet(str(out)).collect()) == [(1, 0.1), (2, 0.2), (3, 0.3)]
    r = latest_frames(spark.createDataFrame([("s", 1, "x"), ("s", 3, "z"), ("s", 2, "y")], "session string, frame_id long, payload string")).first()
    assert (r["payload"], r["dropped"]) == ("z", 2)
