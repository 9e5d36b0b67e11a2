import struct

from visionloom.sources import datasets, images as pictures


def tiff(e, at, big=False, kind=3):
    """A directory at a place, of width 40, height 30 and orientation 6."""
    mark = b"II" if e == "<" else b"MM"
    head = mark + (struct.pack(e + "HHHQ", 43, 8, 0, at) if big else struct.pack(e + "HI", 42, at))
    code, room = {3: "H", 4: "I"}[kind], 8 if big else 4
    tags = [struct.pack(e + "HH" + ("Q" if big else "I"), t, kind, 1) + struct.pack(e + code, v).ljust(room, b"\0") for t, v in ((256, 40), (257, 30), (274, 6))]
    return head.ljust(at, b"\0") + struct.pack(e + ("Q" if big else "H"), 3) + b"".join(tags)


def test_tiff_sizes_and_boxes(spark, tmp_path):
    cases = [("<", 16, False, 3), (">", 16, False, 3), ("<", 200_000, False, 4), (">", 100_000, True, 4)]
    for i, c in enumerate(cases):
        (tmp_path / f"{i}.tif").write_bytes(tiff(*c))
    (tmp_path / "0.txt").write_text("0 .5 .5 .5 .5")
    (tmp_path / "data.yaml").write_text("names: [cat]")
    (tmp_path / "bad.tiff").write_bytes(b"II*\0\xff\xff\xff\x7f")
    probed = pictures.probe(datasets.list_files(spark, str(tmp_path)).where("path like '%.tif'")).collect()
    assert [tuple(r)[1:] for r in probed] == [("tiff", 40, 30, 6)] * 4
    assert pictures.probe(datasets.list_files(spark, str(tmp_path)).where("path like '%.tiff'")).first()["width"] is None
    box = datasets.load_yolo(spark, str(tmp_path)).annotations.first()
    assert (box["x1"], box["y1"], box["x2"], box["y2"]) == (10.0, 7.5, 30.0, 22.5)
