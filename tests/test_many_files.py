import json

from visionloom.sources import datasets


def coco(path, k, boxes=True):
    """One image; ids are the same in all files, names are not."""
    path.write_text(json.dumps({"images": [{"id": 1, "file_name": f"{k}.png", "width": 9, "height": 9}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [k, 2, 3, 4]}] if boxes else None, "categories": [{"id": 1, "name": f"c{k}"}]}))


def test_all_annotation_files_are_read(spark, tmp_path):
    for i in range(1005):
        (tmp_path / f"a{i:04}.json").write_text("{}")
    coco(tmp_path / "z one+%.json", 1)
    coco(tmp_path / "z_val.json", 2)
    coco(tmp_path / "z_null.json", 3, boxes=False)
    d = datasets.load_coco(spark, str(tmp_path))
    assert {(r["rel_path"], r["split"]) for r in d.images.collect()} == {("1.png", None), ("2.png", "val"), ("3.png", None)}
    assert sorted((r["category"], r["x1"]) for r in d.annotations.collect()) == [("c1", 1.0), ("c2", 2.0)]


def test_the_known_yaml_is_found_among_many(spark, tmp_path):
    for i in range(130):
        (tmp_path / f"a{i:03}.yaml").write_text("x: 1")
    (tmp_path / "data.yaml").write_text("names: [cat]")
    assert datasets.class_names(datasets.read_yaml(spark, datasets.list_files(spark, str(tmp_path)))) == {0: "cat"}
    (tmp_path / "data.yaml").unlink()
    (tmp_path / "zz.yml").write_text("names: [dog]")
    assert datasets.class_names(datasets.read_yaml(spark, datasets.list_files(spark, str(tmp_path)))) == {0: "dog"}
