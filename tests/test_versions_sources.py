import json

import pytest

from visionloom.operators import versions
from visionloom.sources import datasets, datasource
from visionloom.sources.thumbs import png

IM = "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long"
AN = "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double"


def tables(spark, n, category="cat"):
    im = [(f"i{k}", f"{k}.jpg", "s", 64, 48, "train", None, None, k) for k in range(n)]
    return spark.createDataFrame(im, IM), spark.createDataFrame([(f"i{k}", category if k else "cat", "bbox", 1.0, 1.0, 2.0, 2.0, None) for k in range(n)], AN)


def test_versions_and_a_write_that_dies(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    assert versions.versions(spark, root).count() == 0
    with pytest.raises(ValueError):
        versions.read(spark, root)
    assert versions.commit(*tables(spark, 3), root, "first") == 1
    assert versions.commit(*tables(spark, 5, "dog"), root) == 2
    assert [t.count() for t in versions.read(spark, root, 1)] == [3, 3] and versions.read(spark, root)[0].count() == 5
    assert [(r["version"], r["parent"], r["images"], r["note"]) for r in versions.versions(spark, root).orderBy("version").collect()] == [(1, None, 3, "first"), (2, 1, 5, "")]
    assert {r["uid"]: r["change"] for r in versions.changes(spark, root, 1, 2).collect()} == {"i1": "changed", "i2": "changed", "i3": "added", "i4": "added"}

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_put", dies)
    with pytest.raises(KeyboardInterrupt):
        versions.commit(*tables(spark, 9), root)
    monkeypatch.undo()
    assert versions.read(spark, root)[0].count() == 5 and versions.versions(spark, root).count() == 2

    known = versions._names
    calls = []

    def late(s, r):  # another writer takes version 3 between the look and the rename
        calls.append(1)
        return known(s, r)[:2] if len(calls) == 1 else known(s, r)

    (tmp_path / "set/_versions/00000003.json").write_text(json.dumps({"version": 3, "id": "x"}))
    monkeypatch.setattr(versions, "_names", late)
    assert versions.commit(*tables(spark, 7), root) == 4 and len(calls) == 2
    monkeypatch.undo()
    assert versions.read(spark, root)[0].count() == 7
    assert not [p for p in (tmp_path / "set/_versions").iterdir() if len(p.name) > 20]  # no drafts are left

    assert versions.verify(spark, root).count() == 0
    own = versions._manifest(spark, versions.qualified(spark, root), 4)["id"]
    part = sorted((tmp_path / f"set/data/{own}/images").glob("*.parquet"))[0]
    part.write_bytes(part.read_bytes()[:-1] + b"!")
    crc = part.parent / f".{part.name}.crc"
    if crc.exists():
        crc.unlink()
    assert [r["problem"] for r in versions.verify(spark, root).collect()] == ["content"]
    part.unlink()
    assert [r["problem"] for r in versions.verify(spark, root).collect()] == ["missing"]
    gone = versions.expire(spark, root, 3)
    assert len(gone) == 2 and known(spark, root) == [2, 3, 4]  # the first version's data, and those of the dead write


def test_formats_as_data_sources(spark, tmp_path):
    datasource.register(spark)
    for split in ("train", "valid"):
        (tmp_path / f"y/{split}/labels").mkdir(parents=True)
        (tmp_path / f"y/{split}/labels/a.txt").write_text("1 0.5 0.5 0.5 0.25\nbad\n7 0.5 0.5 0.1 0.1\n")
    yolo = spark.read.format("yolo").option("names", "cat,dog").load(str(tmp_path / "y"))
    got = [(r["split"], r["image"], r["category"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in yolo.orderBy("split").collect()]
    assert got == [("train", "a", "dog", 0.25, 0.375, 0.75, 0.625), ("val", "a", "dog", 0.25, 0.375, 0.75, 0.625)]
    load = lambda **options: spark.read.format("yolo").options(names="cat,dog", **options).load(str(tmp_path / "y"))
    assert yolo.where("split = 'train'").count() == 1 and yolo.count() == 2 and yolo.rdd.getNumPartitions() == 2
    assert load(split="train").rdd.getNumPartitions() == 1 and load(split="train, val").count() == 2 and load(split="test").count() == 0
    one = load(pushdown="true").where("split = 'train' and category = 'dog'")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1  # the other folder is never read
    assert load(pushdown="true").where("split in ('val', 'test')").rdd.getNumPartitions() == 1
    reader = datasource.PruningReader("yolo", f"file:{tmp_path}/y", {})
    left = list(reader.pushFilters([datasource.EqualTo(("split",), "val"), datasource.EqualTo(("category",), "dog")]))
    assert [f.attribute for f in left] == [("category",)] and [p.split for p in reader.partitions()] == ["val"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "= dog" in plan and "= train" not in plan  # the scan has taken the condition on split; only the rest is filtered after it

    (tmp_path / "c").mkdir()
    for split in ("train", "val"):
        (tmp_path / f"c/instances_{split}2017.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "1.jpg"}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [10, 5, 20, 10]}, {"image_id": 2, "category_id": 3, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 3, "name": "cat"}]}))
    (tmp_path / "c/broken.json").write_text("{")
    coco = spark.read.format("coco").load(str(tmp_path / "c"))
    assert coco.count() == 2 and coco.where("image = '1.jpg' and x2 = 30").count() == 2
    (tmp_path / "v/Annotations").mkdir(parents=True)
    (tmp_path / "v/Annotations/1.xml").write_text("<annotation><filename>1.jpg</filename><object><name>cat</name><bndbox><xmin>10</xmin><ymin>5</ymin><xmax>29</xmax><ymax>14</ymax></bndbox></object><object><name>x</name></object></annotation>")
    assert [(r["image"], r["category"], r["x2"]) for r in spark.read.format("voc").load(str(tmp_path / "v")).collect()] == [("1.jpg", "cat", 29.0)]
    (tmp_path / "l/test").mkdir(parents=True)
    (tmp_path / "l/test/1.json").write_text(json.dumps({"imagePath": "1.jpg", "shapes": [{"label": "cat", "shape_type": "rectangle", "points": [[30, 20], [10, 5]]}, {"label": "dog", "shape_type": "circle", "points": [[20, 20], [30, 20]]}, {"label": "x", "shape_type": "line", "points": [[0, 0], [1, 1]]}]}))
    got = {r["category"]: (r["split"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in spark.read.format("labelme").load(str(tmp_path / "l")).collect()}
    assert got == {"cat": ("test", 10.0, 5.0, 30.0, 20.0), "dog": ("test", 10.0, 10.0, 30.0, 30.0)}
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.json").write_text(json.dumps({"openlabel": {"metadata": {"name": "drive"}, "actions": {"0": {"type": "gaze/road", "frame_intervals": [{"frame_start": 0, "frame_end": 10**12}, {"frame_start": "x"}]}}, "objects": {"7": {"type": "phone", "frame_intervals": [{"frame_start": 2, "frame_end": 2}]}}}}))
    got = [(r["video"], r["label"], r["first"], r["last"]) for r in spark.read.format("openlabel").load(str(tmp_path / "o")).orderBy("label").collect()]
    assert got == [("drive", "gaze/road", 0, 10**12), ("drive", "phone", 2, 2)]


def test_folders_that_a_yaml_names(spark, tmp_path):
    pic = png(__import__("numpy").zeros((48, 64, 3), "uint8"))
    for folder, n in (("pool/one", 1), ("pool/two", 2), ("set/extra", 3)):
        for kind in ("images", "labels"):
            (tmp_path / folder / kind).mkdir(parents=True)
        for k in range(n):
            (tmp_path / folder / f"images/{k}.png").write_bytes(pic)
            (tmp_path / folder / f"labels/{k}.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    (tmp_path / "set/data.yaml").write_text(f"train: ../pool/one/images\nval: {tmp_path}/pool/two/images\ntest: ./x/../extra/images\nnames: [cat]\n")
    got = datasets.load_yolo(spark, str(tmp_path / "set"))
    assert {r["split"]: r["count"] for r in got.images.groupBy("split").count().collect()} == {"train": 1, "val": 2, "test": 3}
    assert got.annotations.count() == 6 and got.orphan_labels.count() == 0
    assert got.images.where("rel_path = '../pool/one/images/0.png'").count() == 1
    assert datasets._labels_of("../images/a/images/x/") == "../images/a/labels/x/" and datasets._labels_of("a/b") == "a/b"
    assert datasets._named_folders("hdfs://n/d/set", {"train": ". , ../y", "val": "hdfs://n/d/set/v/"}) == [("", "train", None), ("../y/", "train", "hdfs://n/d/y"), ("v/", "val", None)]
