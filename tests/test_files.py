import json
import struct
import zlib

import numpy as np
import pytest

from visionloom.operators import clean, export
from visionloom.sources import datasets, images as pictures


def png(path, w=64, h=48, shade=0):
    """A small gray gradient."""
    rows = b"".join(b"\0" + bytes((x * 3 + y * shade) % 256 for x in range(w)) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def yolo(tmp_path_factory):
    root = tmp_path_factory.mktemp("yolo")
    for split, n in (("train", 3), ("valid", 2)):
        for i in range(n):
            png(root / split / "images" / f"v{i}_000{i}.png", shade=i)
            (root / split / "labels").mkdir(parents=True, exist_ok=True)
            (root / split / "labels" / f"v{i}_000{i}.txt").write_text("0 0.5 0.5 0.25 0.25\n\n1 0.5 0.5 2 2 extra\n9 .1 .1 .1 .1\nx y\n")
    (root / "train" / "labels" / "lonely.txt").write_text("0 .5 .5 .1 .1")
    (root / "data.yaml").write_text("train: train/images\nval: valid/images\nnames: {0: cat, '1': dog}\n")
    return root


def test_yolo_is_found_and_read(spark, yolo):
    assert datasets.detect_format(spark, str(yolo)) == "yolo"
    d = datasets.load_dataset(spark, str(yolo), group_by="stem")
    rows = {r["rel_path"]: r for r in d.images.collect()}
    assert len(rows) == 5 and rows["valid/images/v1_0001.png"]["split"] == "val" and rows["train/images/v0_0000.png"]["width"] == 64
    assert {r["grp"] for r in rows.values()} == {"v0_", "v1_", "v2_"}
    boxes = d.annotations.collect()
    assert len(boxes) == 10 and {r["category"] for r in boxes} == {"cat", "dog"} and len({r["image_uid"] for r in boxes}) == 5
    cat = next(r for r in boxes if r["category"] == "cat")
    assert (cat["x1"], cat["y1"], cat["x2"], cat["y2"]) == (24.0, 18.0, 40.0, 30.0)
    assert [r["rel"] for r in d.orphan_labels.collect()] == ["train/labels/lonely.txt"]


def test_yolo_goes_out_and_comes_back(spark, yolo, tmp_path):
    d = datasets.load_dataset(spark, str(yolo))
    paths = datasets.list_files(spark, str(yolo)).selectExpr("rel rel_path", "path")
    card = export.export_yolo(d.images.join(paths, "rel_path"), d.annotations, str(tmp_path / "out"), files="path")
    assert card["images_exported"] == {"train": 3, "val": 2, "test": 0} and card["boxes"] == 10 and card["clamped"] == 5 and card["files_missing"] == 0
    assert (tmp_path / "out" / "labels" / "train" / "v0_0000.txt").read_text() == "0 0.500000 0.500000 0.250000 0.250000\n1 0.500000 0.500000 1.000000 1.000000"
    again = datasets.load_dataset(spark, str(tmp_path / "out"))
    assert again.images.count() == 5 and again.annotations.count() == 10 and again.classes == ["cat", "dog"]
    with pytest.raises(FileExistsError):
        export.export_yolo(d.images, d.annotations, str(tmp_path / "out"))


def test_other_formats_are_found_and_read(spark, tmp_path):
    coco = tmp_path / "coco"
    png(coco / "train" / "a.png")
    (coco / "instances_train.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png", "width": 64, "height": 48}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 7, "category_id": 1, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 1, "name": "cat"}]}))
    d = datasets.load_dataset(spark, str(coco))
    assert datasets.detect_format(spark, str(coco)) == "coco" and d.annotations.first()["x2"] == 4.0 and d.annotations.count() == 1 and d.images.first()["split"] == "train"
    voc = tmp_path / "voc"
    png(voc / "JPEGImages" / "1.png")
    (voc / "Annotations").mkdir()
    (voc / "Annotations" / "1.xml").write_text("<annotation><filename>1.png</filename><size><width>64</width><height>48</height></size><object><name>dog</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>9</xmax><ymax>9</ymax></bndbox></object></annotation>")
    (voc / "ImageSets" / "Main").mkdir(parents=True)
    (voc / "ImageSets" / "Main" / "val.txt").write_text("1 1\n")
    d = datasets.load_dataset(spark, str(voc), one_based=True)
    assert d.images.first()["split"] == "val" and d.annotations.first()["x1"] == 0.0
    lm = tmp_path / "lm"
    png(lm / "b.png")
    (lm / "b.json").write_text(json.dumps({"imagePath": "b.png", "shapes": [{"label": "x", "shape_type": "rectangle", "points": [[9, 9], [1, 2]]}, {"label": "x", "shape_type": "line", "points": [[9, 9], [1, 2]]}]}))
    d = datasets.load_dataset(spark, str(lm))
    assert d.annotations.first()["x1"] == 1.0 and d.skipped.first()["n"] == 1
    ol = tmp_path / "ol"
    for i in range(4):
        png(ol / "frames" / f"{i:06}.png")
    (ol / "s.json").write_text(json.dumps({"openlabel": {"actions": {"0": {"type": "driver/safe", "frame_intervals": [{"frame_start": 1, "frame_end": 2}]}}}}))
    d = datasets.load_dataset(spark, str(ol), level="driver")
    assert d.annotations.count() == 2 and d.images.count() == 4 and d.images.first()["grp"] == "s"
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, str(ol / "frames"))


def test_pictures(spark, tmp_path):
    for i, shade in enumerate((1, 1, 9)):
        png(tmp_path / f"{i}.png", shade=shade)
    (tmp_path / "bad.png").write_bytes(b"no picture")
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 34) + b"Exif\0\0" + b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 6
    (tmp_path / "turned.jpg").write_bytes(jpeg)
    files = datasets.list_files(spark, str(tmp_path))
    probed = pictures.probe(files)
    assert pictures.turned(probed).select("width", "height", "orientation").collect() == [(40, 30, 6)]
    assert probed.where("width is null").count() == 1
    assert {r["path"].rsplit("/", 1)[1] for r in pictures.unreadable(spark, str(tmp_path)).collect()} == {"bad.png", "turned.jpg"}
    prints = pictures.perceptual_hashes(pictures.decoded(spark, str(tmp_path))).selectExpr("regexp_extract(path, '([^/]+)$', 1) id", "fp")
    assert [(r["a"], r["b"], r["distance"]) for r in clean.near_duplicate_pairs(prints).collect()] == [("0.png", "1.png", 0)]
    assert pictures.hashes(spark, str(tmp_path)).select("sha1").distinct().count() == 4


def test_fingerprint_is_stable_under_scale():
    coarse = np.random.default_rng(3).uniform(0, 255, (16, 16))
    x = np.kron(coarse, np.ones((8, 8)))
    assert bin(pictures.perceptual(x) ^ pictures.perceptual(np.kron(x, np.ones((2, 2))))).count("1") <= 6


def test_file_names_are_unique_and_policies_hold(spark):
    im = spark.createDataFrame([(f"u{i:09}", p, s, 10, 10, sp, None, None, i) for i, (p, s, sp) in enumerate([("a/1.jpg", "s", "train"), ("b/1.png", "s", "train"), ("c/1.jpg", "s", None), ("d/1.jpg", "s", "val"), ("e/s_1.jpg", "t", "train")])], "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long")
    got = {r["uid"]: (r["split"], r["stem"]) for r in export.target_stems(im).collect()}
    assert got["u000000000"] == ("train", "1") and got["u000000003"] == ("val", "1") and got["u000000004"] == ("train", "s_1")
    assert len(set(got.values())) == 5
    an = spark.createDataFrame([("u000000000", "b", "image"), ("u000000000", "a", "image"), ("u000000001", "z", "image")], "image_uid string, category string, kind string")
    table = spark.createDataFrame([("a", 0), ("b", 1)], "category string, index int")
    pick = lambda p: sorted((r["uid"][-1], r["category"], r["reason"]) for r in export.classification_targets(im, an, table, p).where("uid < 'u000000002'").collect())
    assert pick("first") == [("0", "a", None), ("1", None, "unknown class")]
    assert pick("duplicate") == [("0", "a", None), ("0", "b", None), ("1", None, "unknown class")]
    assert pick("skip") == [("0", None, "several labels"), ("1", None, "unknown class")]
    with pytest.raises(ValueError):
        export.resolve_classes(an, ["a", "b"])
