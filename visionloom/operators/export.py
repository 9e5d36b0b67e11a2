"""Export as YOLO folders: task, classes, file names, label files, image files, data.yaml and the dataset card.

File names, lines and counters are DataFrames; label and image files are written by the tasks, each file whole and by its own
name, so a repeated task writes the same file again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from visionloom.functions.scalar import SPLITS, slug
from visionloom.sources.formats import STEM

SIDES = {"x1": "width", "y1": "height", "x2": "width", "y2": "height"}


def detect_task(annotations: DataFrame) -> str:
    """detection for boxes, classification for image labels; ValueError for both or none."""
    seen = annotations.agg(F.bool_or(F.col("kind") == "bbox").alias("box"), F.bool_or(F.col("kind") == "image").alias("image")).first()
    if bool(seen["box"]) == bool(seen["image"]):
        raise ValueError("boxes or image labels are needed, not both" if seen["box"] else "there are no annotations")
    return "detection" if seen["box"] else "classification"


def resolve_classes(annotations: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(category, index): the given order, unused names included, which must hold every name; else the sorted names."""
    spark, names = annotations.sparkSession, annotations.where("category is not null").select("category").distinct()
    if order is None:
        ranked = names.agg(F.array_sort(F.collect_set("category")).alias("a"))  # classes, not rows of data
        return ranked.select(F.posexplode("a").alias("index", "category")).select("category", "index")
    table = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "category string, index int")
    lacking = [r["category"] for r in names.join(F.broadcast(table), "category", "left_anti").orderBy("category").limit(20).collect()]
    if lacking:
        raise ValueError(f"the class order lacks {lacking}")
    return table


def target_stems(images: DataFrame, style: str = "auto") -> DataFrame:
    """(uid, split, stem): file names without extension, unique in their split; unassigned images are train.

    auto: of images of one stem the first (assigned ones, then order) keeps it; of the others the first of each
    source_stem that is still free gets that; the rest add 8 digits of the uid, all of it where those repeat. source
    starts at the second step, uid takes the uid. Firsts are partial minima, so a hot name is never sorted in one task.
    """
    split = F.coalesce("split", F.lit("train"))
    own = F.regexp_extract("rel_path", STEM, 1)
    first = F.struct(F.col("split").isNull().cast("int").alias("late"), F.col("ord"), F.col("uid"))
    rows = images.select("uid", split.alias("split"), own.alias("own"), F.concat_ws("_", slug(F.col("source_id")), own).alias("sourced"), first.alias("__first"))
    if style == "uid":
        return rows.select("uid", "split", F.col("uid").alias("stem"))
    holders = rows.groupBy("split", "own").agg(F.min("__first").alias("f")).select("split", "own", F.col("f.uid").alias("holder"))
    rows = rows.join(holders, ["split", "own"]).withColumn("kept", (F.col("uid") == F.col("holder")) if style == "auto" else F.lit(False)).drop("holder")
    taken = rows.where("kept").select("split", F.col("own").alias("sourced"), F.lit(True).alias("taken"))
    second = rows.where("not kept").join(taken, ["split", "sourced"], "left_anti").groupBy("split", "sourced").agg(F.min("__first").alias("f")).select("split", "sourced", F.col("f.uid").alias("holder"))
    rows = rows.join(second, ["split", "sourced"], "left").withColumn("again", ~F.col("kept") & F.coalesce(F.col("uid") == F.col("holder"), F.lit(False)))
    short = F.concat_ws("_", "sourced", F.left("uid", F.lit(8)))
    rest = rows.where("not kept and not again").withColumn("short", short)
    twins = rest.groupBy("split", "short").agg((F.count(F.lit(1)) > 1).alias("twin"))
    rest = rest.join(twins, ["split", "short"]).select("uid", "split", F.when(F.col("twin"), F.concat_ws("_", "sourced", "uid")).otherwise(F.col("short")).alias("stem"))
    named = rows.where("kept or again").select("uid", "split", F.when(F.col("kept"), F.col("own")).otherwise(F.col("sourced")).alias("stem"))
    return named.unionByName(rest)


def _outside(c: str) -> Column:
    return (F.col(c) < -1e-3) | (F.col(c) > F.col(SIDES[c]) + 1e-3)


def detection_labels(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, lines, boxes, clamped, dropped, reason) per image: sorted label lines of its boxes, clamped to it.

    boxes counts all boxes, dropped those without area after clamping, clamped those that reached outside. reason is
    null where the image is exported: an image of unknown size or with a box of an unknown class is not.
    """
    boxes = annotations.where("kind = 'bbox' and x1 is not null").join(classes, "category", "left")
    rows = boxes.join(images.select("uid", "width", "height"), F.expr("image_uid = uid"))
    clip = {c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(s).cast("double"))) for c, s in SIDES.items()}
    rows = rows.withColumn("out", _outside("x1") | _outside("y1") | _outside("x2") | _outside("y2")).withColumns(clip)
    area = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "index", F.expr("(x1 + x2) / 2 / nullif(width, 0)"), F.expr("(y1 + y2) / 2 / nullif(height, 0)"), F.expr("(x2 - x1) / nullif(width, 0)"), F.expr("(y2 - y1) / nullif(height, 0)"))
    per = rows.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list(F.when(area & F.col("index").isNotNull(), line))), "\n").alias("lines"), F.count(F.lit(1)).alias("boxes"), F.count_if("out").alias("clamped"), F.count_if(~area).alias("dropped"), F.count_if(F.col("index").isNull()).alias("unknown"))
    reason = F.when((F.col("width") <= 0) | (F.col("height") <= 0) | F.col("width").isNull() | F.col("height").isNull(), "unknown size").when(F.col("unknown") > 0, "unknown class")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("boxes", "clamped", "dropped")]
    return images.join(per, "uid", "left").select("uid", F.coalesce("lines", F.lit("")).alias("lines"), *zero, reason.alias("reason"))


def classification_targets(images: DataFrame, annotations: DataFrame, classes: DataFrame, several: str = "first") -> DataFrame:
    """(uid, category, reason): a row per file to place, or one with a reason and no category for an image left out.

    An image of several labels gives its first by name (first), none (skip) or a file for each (duplicate).
    """
    if several not in ("first", "skip", "duplicate"):
        raise ValueError(f"unknown policy {several}")
    per = annotations.where("kind = 'image'").join(classes, "category", "left").groupBy("image_uid").agg(F.array_sort(F.collect_set("category")).alias("labels"), F.count_if(F.col("index").isNull()).alias("unknown"))
    many = F.size("labels") > 1
    reason = F.when(F.col("labels").isNull(), "no label").when(F.col("unknown") > 0, "unknown class")
    reason = reason.when(many, "several labels") if several == "skip" else reason
    rows = images.select("uid").join(per, F.expr("uid = image_uid"), "left").withColumn("reason", reason)
    chosen = F.when(F.col("reason").isNull(), F.slice("labels", 1, 1) if several == "first" else F.col("labels"))
    return rows.select("uid", F.explode_outer(chosen).alias("category"), "reason")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_text_files(rows: DataFrame, out: str, path: str = "path", text: str = "text") -> None:
    """One file below out per row."""

    def write(part: Iterator[Row]) -> None:
        files, base = _filesystem(out)
        made = set()
        for r in part:
            to = f"{base}/{r[path]}"
            folder = to.rsplit("/", 1)[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(to) as f:
                f.write(r[text].encode())

    rows.select(path, text).foreachPartition(write)


def place_files(rows: DataFrame, out: str, source: str = "source", path: str = "path", how: str = "copy") -> DataFrame:
    """rows with problem: puts each source file at its path below out; null where it is there, else why not.

    how is copy, hard or symbolic; a link that can't be made (other disk, other store) becomes a copy, and a file that is
    there already is fine. The result is lazy and places files when it is computed: write it, don't count it twice.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    if how not in ("copy", "hard", "symbolic"):
        raise ValueError(f"unknown way to place a file: {how}")
    schema = T.StructType(rows.schema.fields + [T.StructField("problem", T.StringType())])

    def link(a: str, b: str) -> bool:
        import os

        if not os.path.isfile(a):
            return False
        try:
            os.link(a, b) if how == "hard" else os.symlink(a, b)
        except FileExistsError:
            return True
        except OSError:
            return False
        return True

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, base = _filesystem(out)
        for b in batches:
            problems = []
            for a, c in zip(b.column(source).to_pylist(), b.column(path).to_pylist()):
                try:
                    held, at = _filesystem(a.replace("file:/", "/", 1) if a.startswith("file:/") and not a.startswith("file://") else a)
                    to.create_dir(f"{base}/{c}".rsplit("/", 1)[0], recursive=True)
                    local = isinstance(held, fs.LocalFileSystem) and isinstance(to, fs.LocalFileSystem)
                    if how == "copy" or not local or not link(at, f"{base}/{c}"):
                        fs.copy_files(at, f"{base}/{c}", source_filesystem=held, destination_filesystem=to)
                    problems.append(None)
                except (OSError, AttributeError) as e:
                    problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(problems, pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(place, schema)


def data_yaml(out: str, task: str, classes: list[str]) -> str:
    import yaml

    folder = "images/{}" if task == "detection" else "{}"
    doc = {"path": out, **{s: folder.format(s) for s in SPLITS}, "nc": len(classes), "names": dict(enumerate(classes))}
    return yaml.safe_dump(doc, allow_unicode=True, sort_keys=False)


def export_yolo(images: DataFrame, annotations: DataFrame, out: str, order: list[str] | None = None, several: str = "first", style: str = "auto", include_unlabeled: bool = True, overwrite: bool = False, files: str | None = None, lineage: dict | None = None, how: str = "copy") -> dict:
    """Writes the export below out and returns its card. files names the column of images that holds the image's path; null
    places no image files; how is copy, hard or symbolic. A folder that is not empty is refused unless overwrite is set. Only class names, counters and
    the card pass through the driver."""
    from pyarrow import fs as pafs

    to, base = _filesystem(out)
    if not overwrite and to.get_file_info(base).type != pafs.FileType.NotFound and to.get_file_info(pafs.FileSelector(base)):
        raise FileExistsError(out)
    task, table = detect_task(annotations), resolve_classes(annotations, order)
    classes = [r["category"] for r in table.orderBy("index").collect()]
    stems = target_stems(images, style)
    extension = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1)).alias("ext")
    names = stems.join(images.select("uid", extension, *([F.col(files).alias("source")] if files else [])), "uid")
    if task == "detection":
        made = names.join(detection_labels(images, annotations, table), "uid").withColumn("reason", F.when((F.col("boxes") == 0) & F.lit(not include_unlabeled), "no label").otherwise(F.col("reason")))
        made = made.persist(StorageLevel.DISK_ONLY)  # written, counted and placed from one computation
        good = made.where("reason is null")
        write_text_files(good.select(F.concat_ws("/", F.lit("labels"), "split", F.concat("stem", F.lit(".txt"))).alias("path"), F.col("lines").alias("text")), out)
        targets = F.concat_ws("/", F.lit("images"), "split", F.concat("stem", "ext"))
        counts = made.agg(*[F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col(c))), F.lit(0)).alias(c) for c in ("boxes", "clamped", "dropped")]).first().asDict()
    else:
        made = names.join(classification_targets(images, annotations, table, several), "uid").persist(StorageLevel.DISK_ONLY)
        good, targets, counts = made.where("reason is null"), F.concat_ws("/", "split", "category", F.concat("stem", "ext")), {}
    if files:
        placed = place_files(good.select("source", targets.alias("path")), out, how=how)
        why = F.regexp_extract("problem", "^[A-Za-z]*", 0)
        failed = placed.where("problem is not null").groupBy(why.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source", "problem")).alias("first")).collect()  # a row for each kind of error
        counts["files_missing"] = sum(r["n"] for r in failed)
        counts["file_problems"] = [{"kind": r["kind"], "files": r["n"], "first": r["first"]["source"], "message": r["first"]["problem"]} for r in sorted(failed, key=lambda r: r["kind"])]
    skipped = {r["reason"]: r["n"] for r in made.where("reason is not null").groupBy("reason").agg(F.count_distinct("uid").alias("n")).collect()}
    exported = {r["split"]: r["n"] for r in good.groupBy("split").agg(F.count_distinct("uid").alias("n")).collect()}
    made.unpersist()
    card = {
        "created_at": datetime.now().isoformat(timespec="seconds"),
        "task": task,
        "classes": classes,
        "num_classes": len(classes),
        "images_exported": {s: exported.get(s, 0) for s in SPLITS},
        "images_skipped": sum(skipped.values()),
        "skipped_by_reason": skipped,
        "unassigned_to_train": images.where("split is null").count(),
        **counts,
        "prelabel": (lineage or {}).get("prelabel"),
        "warnings": [f"{s} has no images" for s in ("val", "test") if not exported.get(s)],
    }
    for name, text in (("data.yaml", data_yaml(out, task, classes)), ("dataset_card.json", json.dumps(card, ensure_ascii=False, indent=2))):
        to.create_dir(base, recursive=True)
        with to.open_output_stream(f"{base}/{name}") as f:
            f.write(text.encode())
    return card
