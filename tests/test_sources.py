import json
import os

import pytest

from test_files import png
from visionloom.operators import export, records, review
from visionloom.sources import datasets, formats


def voc_xml(name, x):
    named = f"<filename>{name}</filename>" if name else ""
    return f"<annotation>{named}<object><name>dog</name><bndbox><xmin>{x}</xmin><ymin>2</ymin><xmax>60</xmax><ymax>9</ymax></bndbox></object></annotation>"


def test_voc_boxes_meet_the_image_beside_them(spark, tmp_path):
    for part in ("a", "b"):
        png(tmp_path / part / "JPEGImages" / "1.png")
        (tmp_path / part / "Annotations").mkdir(parents=True)
        (tmp_path / part / "Annotations" / "1.xml").write_text(voc_xml("1.jpg" if part == "a" else "1.png", 1 if part == "a" else 5))
    (tmp_path / "b" / "Annotations" / "gone.xml").write_text(voc_xml("", 7))
    d = datasets.load_voc(spark, str(tmp_path))
    rel = {r["uid"]: r["rel_path"] for r in d.images.collect()}
    assert {rel[r["image_uid"]]: r["x1"] for r in d.annotations.collect()} == {"a/JPEGImages/1.png": 1.0, "b/JPEGImages/1.png": 5.0}


def test_labelme_and_coco_resolve_images(spark, tmp_path):
    lm = tmp_path / "lm"
    for part in ("train", "val"):
        png(lm / part / "images" / "a.png")
        (lm / part / "annotations").mkdir(parents=True)
        (lm / part / "annotations" / "a.json").write_text(json.dumps({"imagePath": "..\\other\\gone.png" if part == "val" else "a.png", "shapes": [{"label": part, "shape_type": "rectangle", "points": [[1, 2], [9, 9]]}]}))
    d = datasets.load_labelme(spark, str(lm))
    rel = {r["uid"]: (r["rel_path"], r["split"]) for r in d.images.collect()}
    assert {rel[r["image_uid"]]: r["category"] for r in d.annotations.collect()} == {("train/images/a.png", "train"): "train", ("val/images/a.png", "val"): "val"}
    coco = tmp_path / "coco"
    png(coco / "images" / "x.png", 64, 48)
    (coco / "instances_val.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "sub/x.png"}, {"id": 2, "file_name": "no.png", "width": 5, "height": 6}], "annotations": [], "categories": []}))
    sizes = {r["rel_path"]: (r["width"], r["height"], r["split"]) for r in datasets.load_coco(spark, str(coco)).images.collect()}
    assert sizes == {"sub/x.png": (64, 48, "val"), "no.png": (5, 6, "val")}


def test_yolo_layouts(spark, tmp_path):
    flat = tmp_path / "flat"
    png(flat / "images" / "a.png")
    png(flat / "stray.png")
    (flat / "labels").mkdir()
    (flat / "labels" / "a.txt").write_text("0 .5 .5 .5 .5")
    (flat / "data.yaml").write_text("names: [cat]\ntrain: nowhere\n")
    d = datasets.load_yolo(spark, str(flat))
    assert [(r["rel_path"], r["split"]) for r in d.images.collect()] == [("images/a.png", None)] and d.annotations.count() == 1
    told = tmp_path / "told"
    png(told / "p" / "images" / "a.png")
    png(told / "test" / "images" / "b.png")
    (told / "data.yaml").write_text("names: [cat]\ntrain: ./p/images\nval: p/images\n")
    assert [(r["rel_path"], r["split"]) for r in datasets.load_yolo(spark, str(told)).images.collect()] == [("p/images/a.png", "train")]


def test_openlabel_objects_and_frames(spark, tmp_path):
    for i in range(4):
        png(tmp_path / "frames" / f"f{i}.png")
    png(tmp_path / "other" / "f9.png")
    doc = {"metadata": {"name": "drive"}, "streams": {"c": {"stream_properties": {"total_frames": 3}}}, "actions": {"0": {"type": "gaze/road", "frame_intervals": [{"frame_start": 0, "frame_end": 10**12}, {"frame_start": "x"}]}, "1": {"type": "gaze/--", "frame_intervals": [{"frame_start": 0, "frame_end": 1}]}}, "objects": {"7": {"type": "phone", "frame_intervals": [{"frame_start": 2, "frame_end": 2}]}}}
    (tmp_path / "v.json").write_text(json.dumps({"openlabel": doc}))
    d = datasets.load_openlabel(spark, str(tmp_path), level="gaze", frames_dir="frames", include_objects=True)
    rel = {r["uid"]: r["rel_path"] for r in d.images.collect()}
    assert len(rel) == 4 and {r["grp"] for r in d.images.collect()} == {"drive"}
    assert sorted((rel[r["image_uid"]], r["category"]) for r in d.annotations.collect()) == sorted([(f"frames/f{i}.png", "road") for i in range(4)] + [("frames/f2.png", "phone")])
    assert [r["frame"] for r in d.warnings.collect()] == [3]
    assert datasets.load_openlabel(spark, str(tmp_path)).images.count() == 5
    assert formats.openlabel_videos(spark, str(tmp_path / "v.json")).first()["total_frames"] == 3


def test_adapters_and_merged_sources(spark, tmp_path):
    before = datasets.available_adapters()
    assert before == ["openlabel", "coco", "voc", "labelme", "yolo"] and datasets.get_adapter("voc").load is datasets.load_voc
    (tmp_path / "mine.txt").write_text("x")
    empty = datasets.Dataset(spark.createDataFrame([("u", "a.jpg", "s", 1, 1, None, None, None, 1)], "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long"), spark.createDataFrame([], "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double"))

    def broken(*_):
        raise OSError

    datasets.register(datasets.Adapter("broken", broken, broken), before="openlabel")
    datasets.register(datasets.Adapter("mine", lambda s, root: os.path.exists(f"{root}/mine.txt"), lambda s, root, **o: empty), before="yolo")
    try:
        assert datasets.available_adapters() == ["broken", "openlabel", "coco", "voc", "labelme", "mine", "yolo"]
        assert datasets.detect_format(spark, str(tmp_path)) == "mine"
        d = datasets.load_and_merge(spark, [{"root": str(tmp_path), "source_id": "one"}, {"root": str(tmp_path), "fmt": "mine", "source_id": "two"}])
        assert d.images.count() == 1 and [s["source_id"] for s in d.sources] == ["one", "two"] and d.sources[1]["images"] == 1
        with pytest.raises(ValueError):
            datasets.get_adapter("nothing")
    finally:
        for name in ("broken", "mine"):
            datasets._ADAPTERS.pop(name)


def test_documents_and_snapshots_come_back(spark, tmp_path):
    for i, text in enumerate(['{"id": 1, "created_at": "2024-01-02", "more": 1}', '{"id": 2, "created_at": "2024-03-01"}', "{broken", "[1]", '{"id": 3}']):
        (tmp_path / "runs" / str(i)).mkdir(parents=True)
        (tmp_path / "runs" / str(i) / "job.json").write_text(text)
    docs = records.scan_documents(spark, str(tmp_path / "runs"), "job.json", "id bigint, created_at string")
    assert [r["id"] for r in records.newest_first(docs).collect()] == [2, 1, 3]
    records.write_documents(docs.select("id", "created_at"), str(tmp_path / "out"), "id")
    assert json.loads((tmp_path / "out" / "2.json").read_text()) == {"id": 2, "created_at": "2024-03-01"}
    im = spark.createDataFrame([("u", "a.jpg", "s", 1, 2, None, "g", None, 5)], "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long")
    an = spark.createDataFrame([("u", "cat", "bbox", 0.0, 0.5, 1.0, 2.0, None)], "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double")
    for fmt in ("json", "parquet"):
        records.save_snapshot(im, an, str(tmp_path / fmt), fmt)
        i2, a2 = records.load_snapshot(spark, str(tmp_path / fmt), fmt)
        assert i2.collect() == im.collect() and a2.collect() == an.collect()


def test_links_fall_back_and_existing_files_stay(spark, tmp_path):
    png(tmp_path / "in" / "a.png")
    rows = spark.createDataFrame([(str(tmp_path / "in" / "a.png"), "x/a.png"), (str(tmp_path / "in" / "gone.png"), "x/b.png")], "source string, path string")
    for how in ("copy", "hard", "symbolic"):
        out = tmp_path / how
        for _ in range(2):
            got = {r["path"]: r["problem"] for r in export.place_files(rows, str(out), how=how).collect()}
            assert got["x/a.png"] is None and got["x/b.png"]
        assert (out / "x" / "a.png").read_bytes() == (tmp_path / "in" / "a.png").read_bytes()
        assert (out / "x" / "a.png").is_symlink() == (how == "symbolic")
        assert ((out / "x" / "a.png").stat().st_ino == (tmp_path / "in" / "a.png").stat().st_ino) == (how != "copy")
    with pytest.raises(ValueError):
        export.place_files(rows, str(tmp_path), how="teleport")


def test_a_scorer_annotates_and_failures_are_counted(spark):
    import pandas as pd

    im = spark.createDataFrame([(f"u{i}", f"{i}.jpg") for i in range(6)], "uid string, rel_path string")

    def score(parts):
        for p in parts:
            found = [[{"class_index": 0, "class_name": None, "confidence": 0.9, "bbox": [0.0, 0.0, 2.0, 2.0]}] if u in ("u1", "u2") else [] for u in p["uid"]]
            yield pd.DataFrame({"uid": p["uid"], "ok": p["uid"] != "u2", "error": [("bad" if u == "u2" else None) for u in p["uid"]], "detections": found})

    boxes, report = review.annotate(im, score, ["cat"])
    assert [(r["image_uid"], r["category"]) for r in boxes.collect()] == [("u1", "cat")]
    assert report.first().asDict() == {"images": 6, "scored": 5, "failed": 1, "with_objects": 1, "empty": 4, "objects": 1}
