"""Dataset formats as data sources: spark.read.format("yolo").load(root), a partition per folder, pruned by split."""

from __future__ import annotations

import json
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from visionloom.functions.scalar import SPLIT_ALIASES

_BOXES = "file string, split string, image string, category string, kind string, x1 double, y1 double, x2 double, y2 double"
_SPANS = "file string, split string, video string, label string, first long, last long"


@dataclass
class Folder(InputPartition):
    path: str
    split: str | None

    def __post_init__(self):
        super().__init__(self.path)


def split_of(path: str) -> str | None:
    """The split that a part of the path, the last first, or of a file name, cut at _, - and ., names."""
    for part in reversed([p for p in path.split("/") if p]):
        for word in [part, *re.split(r"[_.\-]", part)]:
            if word.lower() in SPLIT_ALIASES:
                return SPLIT_ALIASES[word.lower()]
    return None


def _number(v) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def yolo_rows(text: str, names: dict[int, str]) -> Iterator[tuple]:
    """(image, category, kind, box) of label lines; boxes stay as shares of the image, since a label file has no size."""
    for line in text.splitlines():
        p = [_number(x) for x in line.split()[:5]]
        if len(p) == 5 and None not in p and p[0] == int(p[0]) and (not names or int(p[0]) in names):
            x, y, w, h = p[1:]
            yield None, names.get(int(p[0]), str(int(p[0]))), "bbox", x - w / 2, y - h / 2, x + w / 2, y + h / 2


def coco_rows(text: str) -> Iterator[tuple]:
    doc = json.loads(text)
    names = {c["id"]: str(c.get("name", "")).strip() for c in doc.get("categories", [])}
    images = {i["id"]: i.get("file_name") for i in doc.get("images", [])}
    for a in doc.get("annotations", []):
        if a.get("image_id") in images and a.get("category_id") in names and len(a.get("bbox") or []) == 4:
            x, y, w, h = map(float, a["bbox"])
            yield images[a["image_id"]], names[a["category_id"]], "bbox", x, y, x + w, y + h


def voc_rows(text: str) -> Iterator[tuple]:
    doc = ET.fromstring(text)
    for o in doc.iter("object"):
        box = o.find("bndbox")
        corners = [_number(box.findtext(c)) if box is not None else None for c in ("xmin", "ymin", "xmax", "ymax")]
        if None not in corners:
            yield doc.findtext("filename"), (o.findtext("name") or "").strip(), "bbox", *corners


def labelme_rows(text: str) -> Iterator[tuple]:
    doc = json.loads(text)
    for s in doc.get("shapes", []):
        points = s.get("points") or []
        kind = s.get("shape_type", "polygon")
        if len(points) < (3 if kind == "polygon" else 2) or kind not in ("rectangle", "polygon", "circle"):
            continue
        xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
        if kind == "circle":
            r = ((xs[1] - xs[0]) ** 2 + (ys[1] - ys[0]) ** 2) ** 0.5
            xs, ys = [xs[0] - r, xs[0] + r], [ys[0] - r, ys[0] + r]
        yield doc.get("imagePath"), str(s.get("label", "")).strip(), "bbox", min(xs), min(ys), max(xs), max(ys)


def openlabel_rows(text: str) -> Iterator[tuple]:
    doc = json.loads(text)["openlabel"]
    video = (doc.get("metadata") or {}).get("name")
    for kind in ("actions", "objects"):
        for a in (doc.get(kind) or {}).values():
            for i in a.get("frame_intervals") or []:
                first, last = _number(i.get("frame_start")), _number(i.get("frame_end"))
                if first is not None and last is not None and a.get("type"):
                    yield video, a["type"], int(first), int(last)


class FolderReader(DataSourceReader):
    """Reads the annotation files of one format. Partitions are folders, or single files where one file holds a split; those
    of other splits than the wanted ones are left out before any task starts."""

    def __init__(self, kind: str, root: str, names: dict[int, str], splits: set[str] | None = None):
        self.kind, self.root, self.names, self.splits = kind, root, names, splits

    def _only(self, wanted: set) -> None:
        self.splits = wanted if self.splits is None else self.splits & wanted

    def _store(self):
        from visionloom.sources.listing import store_of

        return store_of(self.root)

    def partitions(self):
        from pyarrow import fs

        held, top, _ = self._store()
        ending = {"yolo": ".txt", "voc": ".xml"}.get(self.kind, ".json")
        per_file = self.kind == "coco"
        found = held.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        paths = sorted({f.path if per_file else posixpath.dirname(f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ending)})
        parts = [Folder(p, split_of(p[len(top) :])) for p in paths]
        return [p for p in parts if self.splits is None or p.split in self.splits]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # what Spark reads where there are no partitions
            return
        held, top, prefix = self._store()
        ending = {"yolo": ".txt", "voc": ".xml"}.get(self.kind, ".json")
        info = held.get_file_info(partition.path)
        files = [info] if info.type == fs.FileType.File else held.get_file_info(fs.FileSelector(partition.path))
        for f in sorted(files, key=lambda f: f.path):
            name = posixpath.basename(f.path)
            if f.type != fs.FileType.File or not name.lower().endswith(ending) or name in ("classes.txt", "README.txt"):
                continue
            with held.open_input_file(f.path) as stream:
                text = stream.read().decode("utf-8", "replace")
            try:
                rows = list(self._rows(text))
            except (ValueError, KeyError, TypeError, AttributeError, ET.ParseError):
                continue  # no file of this format
            stem = name.rsplit(".", 1)[0]
            for image, *rest in rows:
                yield (prefix + f.path, partition.split, image or stem, *rest)

    def _rows(self, text: str) -> Iterator[tuple]:
        if self.kind == "yolo":
            return yolo_rows(text, self.names)
        return {"coco": coco_rows, "voc": voc_rows, "labelme": labelme_rows, "openlabel": openlabel_rows}[self.kind](text)


class PruningReader(FolderReader):
    """The same, told its splits by the conditions of the query."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("split",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("split",):
                self._only(set(f.value))
            else:
                yield f


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return _SPANS if self.kind == "openlabel" else _BOXES

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("a folder is needed: load(root)")
        names = dict(enumerate(n.strip() for n in self.options["names"].split(","))) if self.options.get("names") else {}
        root = self.options["path"]
        splits = {x.strip() for x in self.options["split"].split(",")} if self.options.get("split") else None
        reader = PruningReader if self.options.get("pushdown", "").lower() == "true" else FolderReader
        return reader(self.kind, root if re.match("[a-z0-9]+:", root) else "file:" + root, names, splits)


class Yolo(_Source):
    kind = "yolo"


class Coco(_Source):
    kind = "coco"


class Voc(_Source):
    kind = "voc"


class LabelMe(_Source):
    kind = "labelme"


class OpenLabel(_Source):
    kind = "openlabel"


def register(spark: SparkSession) -> None:
    """From now on the session reads yolo, coco, voc, labelme and openlabel as formats.

    Rows are (file, split, image, category, kind, x1, y1, x2, y2), of openlabel (file, split, video, label, first, last).
    Boxes are in pixels, those of yolo in shares of the image; option names="cat,dog" names the classes of yolo and leaves
    others out. The split is that which a folder, or a file of coco, is named after, null without one. Files that are not
    of the format give no rows; the largest file must fit a task, of coco as a whole.

    Option split="train,val" reads the folders of these splits only. With pushdown="true" conditions on split do that, but
    Spark keeps the pruned list with the table: use a table loaded so under one condition only, and load again for another."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Yolo, Coco, Voc, LabelMe, OpenLabel):
        spark.dataSource.register(source)
