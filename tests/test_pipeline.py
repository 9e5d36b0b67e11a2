import json

from test_files import png
from visionloom.__main__ import main
from visionloom.operators import pipeline


def folder(root):
    for i in range(12):
        png(root / "images" / f"{i}.png", 64, 48, shade=i)
        (root / "labels").mkdir(exist_ok=True)
        (root / "labels" / f"{i}.txt").write_text("0 .5 .5 .5 .5\n1 .5 .5 3 .2\n0 .5 .5 .5 .5\n2 .1 .1 .1 .1")
    (root / "data.yaml").write_text("names: [cat, Dog, dog]\n")
    return root


def test_the_command_line_loads_cleans_splits_and_exports(spark, tmp_path, capsys):
    root = folder(tmp_path / "in")
    said = lambda *a: (main([*map(str, a)]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))[1]
    assert said("adapters")[0] == "openlabel" and said("detect", root) == {"format": "yolo"}
    assert said("scan", root)["images"] == 12 and said("scan", root)["sources"][0]["annotations"] == 48
    assert said("taxonomy", root) == [{"key": "dog", "suggested": "dog", "total": 24, "names": "Dog|dog"}]
    found = said("clean", root)
    assert found["label_out_of_bounds"] == 12 and found["label_duplicate"] == 12 and "label_duplicate" not in said("clean", root, "--disable", "label_duplicate")
    assert abs(said("split", root)["train"] - 0.8) < 0.1
    card = said("export", root, "--out", tmp_path / "out", "--map", "Dog=dog", "--clean", "--place", "hard")
    assert card["classes"] == ["cat", "dog"] and sum(card["images_exported"].values()) == 12 and card["boxes"] == 36 and card["clamped"] == 0 and card["files_missing"] == 0
    assert card["findings"]["label_duplicate"] == 12 and set(card["splits"]) == {"train", "val", "test"}
    assert sum(1 for _ in (tmp_path / "out" / "images").rglob("*.png")) == 12
    assert said("export-ir", root, "--out", tmp_path / "ir") and any((tmp_path / "ir" / "images").iterdir())
    assert said("sql", root, "--query", "SELECT category, objects FROM classes ORDER BY category")[0]["category"] == "Dog"
    assert said("sql", root, "--query", "SELECT max(area) a FROM objects WHERE image_width > 0")[0]["a"] > 0
    assert [said("commit", root, "--out", tmp_path / "v", "--note", n)["version"] for n in "ab"] == [1, 2]
    assert said("report", root, "--out", tmp_path / "r.html") and "<svg" in (tmp_path / "r.html").read_text()


def test_lineage_is_kept():
    card = pipeline.attach_lineage({"task": "detection"}, "w.pt", {"images": 3}, {"reviewed": True})
    assert card["task"] == "detection" and card["prelabel"]["weights"] == "w.pt" and card["prelabel"]["review"] == {"reviewed": True}


def test_scoring_review_and_export_in_one_call(spark, tmp_path):
    import pandas as pd

    rows = [(f"i{k}", f"{k}.jpg", "s", 100, 80, None, None, None, k, f"{tmp_path}/{k}.jpg") for k in range(12)]
    for k in range(11):
        (tmp_path / f"{k}.jpg").write_bytes(b"x")
    im = spark.createDataFrame(rows, "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long, path string")

    def score(parts):
        for p in parts:
            hits = [[] if u == "i1" else [{"class_index": int(u[1:]) % 2, "class_name": None, "confidence": 0.9, "bbox": [1.0, 1.0, 31.0, 21.0]}] for u in p["uid"]]
            yield pd.DataFrame({"uid": p["uid"], "ok": p["uid"] != "i0", "error": None, "detections": hits})

    statuses = spark.createDataFrame([("i2", 1, "confirmed")], "uid string, seq long, status string")
    card = pipeline.prelabel_dataset(im, score, ["cat", "dog"], "w.pt", str(tmp_path / "out"), statuses=statuses, files="path")
    told = card["prelabel"]
    assert told["weights"] == "w.pt" and told["report"] == {"images": 12, "scored": 11, "failed": 1, "with_objects": 10, "empty": 1, "objects": 10}
    assert told["review"]["images_confirmed"] == 1 and told["review"]["boxes_total"] == 10
    assert sum(card["images_exported"].values()) == 11 and card["boxes"] == 10 and card["classes"] == ["cat", "dog"]
    assert card["files_missing"] == 1 and card["file_problems"][0]["first"].endswith("11.jpg") and "11.jpg" in card["file_problems"][0]["message"]
