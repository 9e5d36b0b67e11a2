import pytest
from pyspark.sql import functions as F

from visionloom.operators import analytics, clean, evals, jobs, report, review, split

IM = "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long"
AN = "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double"


def small(spark):
    im = [(f"i{i}", f"i{i}.jpg", "s", 640, 480, "train" if i < 8 else "val", None, None, i) for i in range(11)]
    an = [(f"i{i}", "cat" if i < 8 else "dog", "bbox", 1.0, 1.0, 11.0, 11.0, None) for i in range(10)]
    return spark.createDataFrame(im, IM), spark.createDataFrame(an, AN)


def test_findings_tell_what_the_data_show(spark):
    got = {r["code"]: (r["level"], r["value"]) for r in analytics.findings(*small(spark)).collect()}
    assert got == {"few_instances": ("warning", 2.0), "mostly_small": ("advice", 1.0), "unlabeled": ("info", 1.0), "missing_in_val": ("warning", 1.0), "missing_in_test": ("warning", 2.0), "shifted": ("warning", 2.0), "one_size": ("info", 1.0)}
    im, an = small(spark)
    assert "healthy" in {r["code"] for r in analytics.findings(im.where("false"), an.where("false")).collect()}


def test_a_report_shows_and_escapes(spark):
    im, an = small(spark)
    html = report.dataset_report(im, an.withColumn("category", F.concat("category", F.lit("<b>"))))
    assert "cat&lt;b&gt;" in html and "<svg" in html and "<b>" not in html
    matrix = evals.confusion(spark.createDataFrame([("a", "a"), ("a", "b")], "p string, t string"), "p", "t")
    assert "Confusion" in report.evaluation_report(spark.createDataFrame([("mAP50", 0.5)], "metric string, value double"), evals.class_metrics(matrix), matrix)
    assert report.bars([]) == ""


def test_reports_show_heat_notes_and_samples(spark, tmp_path):
    from test_files import png

    png(tmp_path / "i0.png", 64, 48)
    im, an = small(spark)
    files = im.withColumn("path", F.concat(F.lit(f"{tmp_path}/"), F.regexp_replace("rel_path", "jpg", "png")))
    html = report.dataset_report(files, an, path="path")
    assert "has 4 times as many as dog (2)" in html and html.count("<figure>") == 11 and html.count("data:image/png;base64,") == 1
    assert report.heat(0, 5) != report.heat(1, 5) != report.heat(5, 5) and report.heat(0, 0) == "color:#bbb"
    grid = report.matrix("x", ["a"], [("<r>", [0])])
    assert "&lt;r&gt;" in grid and "<rect" in report.columns([("0+", 3), ("1+", 0)])
    report.write_report(html, str(tmp_path / "deep" / "r.html"))
    assert (tmp_path / "deep" / "r.html").read_text() == html


def test_minimums_leave_one_train_unit(spark):
    u = spark.createDataFrame([(f"u{i}", "train") for i in range(3)], "unit string, split string")
    got = {r["unit"]: r["split"] for r in split.ensure_minimums(u, 5, 5).collect()}
    assert got == {"u0": "val", "u1": "val", "u2": "train"}
    im, _ = small(spark)
    assert [(r["split"], r["actual"], r["off"]) for r in split.ratio_deviation(im).collect()] == [("train", 0.7273, True), ("val", 0.2727, True), ("test", 0.0, True)]


def test_near_copies_across_splits_are_leaks(spark):
    im, _ = small(spark)
    prints = spark.createDataFrame([("i0", 0), ("i1", 1), ("i9", 3)], "id string, fp long")
    got = {(r["image_uid"], r["rule"]) for r in clean.near_duplicates(im, prints, 1).collect()}
    assert got == {("i1", "image_duplicate_near"), ("i9", "leak_near_duplicate_across_splits")}
    files = im.withColumn("path", F.col("rel_path"))
    probed = spark.createDataFrame([("i0.jpg", 6), ("i1.jpg", 1)], "path string, orientation int")
    found = clean.file_findings(files, probed, spark.createDataFrame([("i2.jpg",)], "path string"), spark.createDataFrame([("x.txt",)], "rel string"))
    assert sorted(r["rule"] for r in found.collect()) == ["image_exif_orientation", "image_unreadable", "label_orphan"]


def test_evaluations(spark):
    p = spark.createDataFrame([("e", {0: "cat"}, [0, 2], [0.5, float("nan")], [0.4], [0.44, 0.54], [0.1, 0.2], [0.1, 0.2], [7])], "eval_id string, names map<int,string>, ap_class_index array<int>, p array<double>, r array<double>, f1 array<double>, ap50 array<double>, ap array<double>, nt_per_class array<int>")
    rows = evals.per_class_rows(p)
    assert [(r["name"], r["instances"], r["precision"], r["recall"]) for r in rows.orderBy("index").collect()] == [("cat", 7, 0.5, 0.4), ("class_2", 0, None, None)]
    results = spark.createDataFrame([("e", "metrics/mAP50(B)", 0.5), ("e", "fitness", float("nan")), ("e", "lr", 1.0)], "eval_id string, key string, value double")
    assert {r["metric"]: r["value"] for r in evals.overall(results, rows).collect()} == {"mAP50": 0.5, "f1": 0.49}
    runs = spark.createDataFrame([("A", "e", "val", True), ("B", "x", "test", False)], "label string, eval_id string, split string, ok boolean")
    assert {r["note"]: r["detail"] for r in evals.comparison_notes(runs, rows).collect()} == {"several_splits": "test,val", "different_classes": "2", "failed": "B"}
    item = "struct<eval_id:string,created_at:int>"
    cards = spark.createDataFrame([("m", [("a", 1), ("b", 2)]), ("n", None)], f"model_id string, evals array<{item}>")
    new = spark.createDataFrame([("m", ("a", 3))], f"model_id string, item_row {item}")
    assert {r["model_id"]: r["evals"] and [tuple(e) for e in r["evals"]] for r in evals.attach(cards, new).collect()} == {"m": [("b", 2), ("a", 3)], "n": None}


def test_reviews(spark):
    im = spark.createDataFrame([("a", "confirmed", True), ("b", None, None)], "uid string, review_status string, touched boolean")
    boxes = spark.createDataFrame([("b",)], "image_uid string")
    want = {"all": "ab", "pending": "b", "confirmed": "a", "edited": "a", "with_boxes": "b", "empty": "a", "other": "ab"}
    assert {n: "".join(sorted(r["uid"] for r in review.filter_images(im, boxes, n).collect())) for n in want} == want


def test_streams_follow_jobs_and_logs(spark, tmp_path):
    def run(rows, schema, fn, name):
        src = str(tmp_path / name)
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src)
            q = fn(spark.readStream.schema(schema).json(src)).writeStream.format("parquet").option("checkpointLocation", src + "_c").option("path", src + "_o").trigger(availableNow=True).start()
            q.awaitTermination(90)
        return spark.read.parquet(src + "_o")

    events = [[(1, 0, "start"), (1, 1, "bad")], [(1, 2, "stop"), (1, 3, "exit"), (1, 1, "done")]]
    got = run(events, "job_id long, seq long, event string", jobs.follow_states, "jobs")
    assert [(r["seq"], r["status"]) for r in got.orderBy("seq").collect()] == [(0, "running"), (2, "stopping"), (3, "stopped")]
    lines = [[(1, 0, 0, "a"), (1, 0, 1, "b")], [(1, 1, 0, "c")]]
    got = run(lines, "run_id long, arrival long, pos int, line string", jobs.tail_log, "logs")
    assert [(r["seq"], r["line"]) for r in got.orderBy("seq").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_sources_of_weights_and_formats(spark):
    a = spark.createDataFrame([("X/a.pt", "one")], "path string, label string")
    b = spark.createDataFrame([("x/A.pt", "two"), ("m_openvino_model/", "three"), ("q.bin", "four")], "path string, label string")
    got = {r["label"]: r["f"] for r in jobs.weights([a, b]).withColumn("f", jobs.weights_format(F.col("path"))).collect()}
    assert got == {"one": "pt", "three": "openvino", "four": None}
    shown = spark.createDataFrame([("val_batch1_pred.jpg",), ("val_batch0_pred.jpg",), ("val_batch2_pred.jpg",), ("x.png",)], "name string")
    assert [r["name"] for r in jobs.preview(shown).collect()] == ["val_batch0_pred.jpg", "val_batch1_pred.jpg"]
