"""Pseudo-labels and their human review as an edit log; artifact manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def frame_annotations(frames: DataFrame, names: list[str], least: float = 0.0) -> DataFrame:
    """Annotations of frames(uid, ok, detections array<struct<class_index, class_name, confidence, bbox>>): boxes without
    four finite numbers are left out, unnamed classes are class_<index>; failed frames give none."""
    d = frames.where("ok").select("uid", F.posexplode("detections").alias("i", "d"))
    good = d.where((F.size("d.bbox") == 4) & F.forall("d.bbox", lambda v: v.isNotNull() & ~F.isnan(v))).where(F.coalesce("d.confidence", F.lit(0.0)) >= least)
    index = F.coalesce("d.class_index", F.lit(-1))
    name = F.coalesce("d.class_name", F.when(index >= 0, F.get(F.array(*map(F.lit, names)), index)) if names else F.lit(None).cast("string"), F.concat(F.lit("class_"), index))
    return good.select(F.col("uid").alias("image_uid"), name.alias("category"), F.lit("bbox").alias("kind"), *[F.round(F.get("d.bbox", F.lit(k)), 4).alias(c) for k, c in enumerate(BOX)], F.col("d.confidence").alias("score"), F.left(F.sha1(F.concat_ws("\x1f", F.lit("ann"), "uid", "i")), F.lit(16)).alias("box_id"))


def apply_edits(model: DataFrame, edits: DataFrame) -> DataFrame:
    """Boxes after the log (box_id, seq, op add|update|remove, image_uid, category, x1..y2): the last edit of a box counts;
    a model box keeps its first shape as model_bbox."""
    last = edits.groupBy("box_id").agg(F.max_by(F.struct("op", "image_uid", "category", *BOX), "seq").alias("e"), F.max(F.col("op") == "add").alias("added"))
    rows = model.select("box_id", F.struct("image_uid", "category", *BOX).alias("m")).join(last, "box_id", "full")
    rows = rows.where("e is null or e.op <> 'remove'").where("m is not null or added")
    pick = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(f"m.{c}")).alias(c)
    return rows.select("box_id", pick("image_uid"), pick("category"), *map(pick, BOX), F.when(F.col("m").isNull(), "human_review").otherwise("model").alias("source"), F.when(F.col("m").isNull(), "added").when(F.col("e").isNotNull(), "edited").otherwise("pending").alias("review"), F.when(F.col("m").isNotNull() & F.col("e").isNotNull(), F.struct(*[F.col(f"m.{c}").alias(c) for c in BOX])).alias("model_bbox"))


#: What a scorer gives for each image.
FRAMES = "uid string, ok boolean, error string, detections array<struct<class_index:int,class_name:string,confidence:double,bbox:array<double>>>"
STATUSES = ["pending", "confirmed"]  # fixed values


def image_statuses(images: DataFrame, log: DataFrame) -> DataFrame:
    """images with review_status: the last one set in log(uid, seq, status), trimmed and in lower case; pending where none
    was. Entries of no image or no known status change nothing."""
    known = log.select("uid", "seq", F.lower(F.trim("status")).alias("status")).where(F.col("status").isin(STATUSES))
    last = known.groupBy("uid").agg(F.max_by("status", "seq").alias("__s"))
    kept = [c for c in images.columns if c != "review_status"]
    return images.select(*kept).join(last, "uid", "left").select(*kept, F.coalesce("__s", F.lit("pending")).alias("review_status"))


def review_summary(boxes: DataFrame, images: DataFrame, removed: int | DataFrame = 0) -> DataFrame:
    """One row of counters over boxes(source, review) and images(review_status, touched); a box without a source is the
    model's. removed is the number of boxes taken away, or a log(op) to count it in."""
    human = F.coalesce(F.col("source") == "human_review", F.lit(False))
    b = boxes.agg(F.count(F.lit(1)).alias("boxes_total"), F.count_if(~human).alias("boxes_model"), F.count_if(human).alias("boxes_human_added"), F.count_if(F.col("review") == "edited").alias("boxes_edited"))
    done = F.coalesce(F.col("review_status"), F.lit("pending")) == "confirmed"
    touched = F.col("touched") if "touched" in images.columns else F.lit(False)
    i = images.agg(F.count(F.lit(1)).alias("images_total"), F.count_if(done).alias("images_confirmed"), F.count_if(~done).alias("images_pending"), F.count_if(F.coalesce(touched, F.lit(False))).alias("images_touched"))
    gone = F.lit(removed).cast("bigint") if isinstance(removed, int) else None
    row = b.crossJoin(F.broadcast(i))  # one row each
    row = row.withColumn("boxes_removed", gone) if gone is not None else row.crossJoin(F.broadcast(removed.agg(F.count_if(F.col("op") == "remove").alias("boxes_removed"))))
    return row.withColumn("reviewed", (F.col("images_total") > 0) & (F.col("images_confirmed") == F.col("images_total")))


def find_annotations(boxes: DataFrame, images: DataFrame, wanted: DataFrame) -> DataFrame:
    """(box_id, uid, category, ...) of wanted(box_id): boxes of known images, with the image's path."""
    return boxes.join(wanted.where("coalesce(box_id, '') <> ''").select("box_id").distinct(), "box_id", "left_semi").join(images.select(F.col("uid").alias("image_uid"), "rel_path"), "image_uid")


def annotate(images: DataFrame, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], names: list[str], least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(annotations, report) of a scorer that mapInPandas runs over images(uid, path): it gives (uid, ok, error, detections).

    A failed image is counted, never taken as empty. The scorer runs once if the caller materialises the images' result."""
    frames = images.select("uid", "rel_path").mapInPandas(score, FRAMES)
    return frame_annotations(frames, names, least), prelabel_report(frames)


def prelabel_report(frames: DataFrame) -> DataFrame:
    """Counters of frames(uid, ok, error, detections)."""
    n = F.coalesce(F.size("detections"), F.lit(0))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return frames.agg(F.count(F.lit(1)).alias("images"), F.count_if(ok).alias("scored"), F.count_if(~ok).alias("failed"), F.count_if(ok & (n > 0)).alias("with_objects"), F.count_if(ok & (n <= 0)).alias("empty"), F.coalesce(F.sum(F.when(ok & (n > 0), n)), F.lit(0)).alias("objects"))


def verify_manifest(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """First problem of each artifact(path, size, sha256) against files(path, size, sha256); size 0 and '' are not checked."""
    files = listing.select("path", F.col("size").alias("__s"), F.col("sha256").alias("__h"))
    rows = manifest.join(files, "path", "left")
    problem = F.when(F.col("__s").isNull(), "missing").when((F.col("size") > 0) & (F.col("size") != F.col("__s")), "size").when((F.coalesce("sha256", F.lit("")) != "") & (F.col("sha256") != F.col("__h")), "hash")
    return rows.select("path", problem.alias("problem"))


def filter_images(images: DataFrame, boxes: DataFrame, name: str = "all") -> DataFrame:
    """images(uid, review_status, touched) by pending, confirmed, edited, with_boxes or empty; any other name keeps all."""
    done = F.coalesce(F.col("review_status") == "confirmed", F.lit(False))
    if name in ("pending", "confirmed", "edited"):
        return images.where({"pending": ~done, "confirmed": done, "edited": F.coalesce("touched", F.lit(False))}[name])
    if name in ("with_boxes", "empty"):
        return images.join(boxes, F.expr("uid = image_uid"), "left_semi" if name == "with_boxes" else "left_anti")
    return images


def validate_box(rows: DataFrame) -> DataFrame:
    """rows(x1..y2, category, width, height) clamped to the image, with problem: no_area, blank_category or null."""
    clip = {c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col("width" if c[0] == "x" else "height").cast("double"))) for c in BOX}
    problem = F.when(~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False)), "no_area").when(F.trim(F.coalesce("category", F.lit(""))) == "", "blank_category")
    return rows.withColumns(clip).withColumn("problem", problem)


def top_hits(frames: DataFrame, scores: str = "scores", k: int = 5) -> DataFrame:
    """frames with hits: the k highest scores of each as (class_index, confidence), the lower index first at a tie."""
    pairs = F.transform(scores, lambda s, i: F.struct(i.alias("class_index"), s.alias("confidence")))
    by = lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(a["class_index"] - b["class_index"])
    return frames.withColumn("hits", F.slice(F.array_sort(F.filter(pairs, lambda p: p["confidence"].isNotNull()), by), 1, k))
