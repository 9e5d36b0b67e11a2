"""Images with their annotations: columns of boxes, lookups, nested samples and pages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visionloom.functions.scalar import box_area
from visionloom.operators.analytics import after, check_page
from visionloom.operators.review import filter_images

OBJECT = ["category", "kind", "x1", "y1", "x2", "y2", "score"]


def box_columns(annotations: DataFrame) -> DataFrame:
    """annotations with is_bbox, box_width, box_height, area (never negative) and xywh (x, y, width, height; null without a box)."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    xywh = F.when(F.col("x1").isNotNull(), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("w"), h.alias("h")))
    return annotations.withColumns({"is_bbox": (F.col("kind") == "bbox") & F.col("x1").isNotNull(), "box_width": w, "box_height": h, "area": box_area(), "xywh": xywh})


def from_xywh(xywh: Column) -> Column:
    return F.struct(xywh["x"].alias("x1"), xywh["y"].alias("y1"), (xywh["x"] + xywh["w"]).alias("x2"), (xywh["y"] + xywh["h"]).alias("y2"))


def images_of_split(images: DataFrame, split: str | None) -> DataFrame:
    return images.where(F.col("split").eqNullSafe(F.lit(split)))


def annotations_of(annotations: DataFrame, uids: DataFrame) -> DataFrame:
    """The annotations of the images in uids(uid)."""
    return annotations.join(uids.select(F.col("uid").alias("image_uid")).distinct(), "image_uid", "left_semi")


def nested(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """images with objects: an array of their annotations by order (by class and box where annotations have no ord),
    empty for images without any."""
    order = ["ord"] if "ord" in annotations.columns else []
    item = F.struct(*order, *OBJECT)
    per = annotations.groupBy("image_uid").agg(F.array_sort(F.collect_list(item)).alias("objects"))
    kind = F.array().cast(per.schema["objects"].dataType)
    return images.join(per, F.expr("uid = image_uid"), "left").drop("image_uid").withColumn("objects", F.coalesce("objects", kind))


def page(images: DataFrame, annotations: DataFrame, review: str = "all", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of nested samples by rel_path and uid, filtered by review state; annotations are joined to the page alone."""
    check_page(offset, limit)
    rows = filter_images(images, annotations, review).orderBy("rel_path", "uid").offset(offset).limit(limit)
    return nested(rows, annotations.join(F.broadcast(rows.select(F.col("uid").alias("image_uid"))), "image_uid", "left_semi"))


def page_after(images: DataFrame, annotations: DataFrame, cursor: tuple[str, str] | None = None, review: str = "all", limit: int = 50) -> DataFrame:
    """The page after the cursor (rel_path, uid) of the last sample seen, None for the first: what page gives at that
    offset, without sorting what lies before. The last row's rel_path and uid are the next cursor."""
    check_page(0, limit)
    rows = filter_images(after(images, cursor), annotations, review).orderBy("rel_path", "uid").limit(limit)
    return nested(rows, annotations.join(F.broadcast(rows.select(F.col("uid").alias("image_uid"))), "image_uid", "left_semi"))


def only_classes(frames: DataFrame, classes: list[int], column: str = "detections") -> DataFrame:
    """frames whose detections are those of the class indexes."""
    return frames.withColumn(column, F.filter(column, lambda d: d["class_index"].isin(list(classes))))


def category_order(annotations: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """(category, ord): registered(category, ord) names by their order, then the others by the first annotation that has
    them; gapless from 0."""
    seen = annotations.groupBy("category").agg(F.min(F.struct("image_uid", *(["ord"] if "ord" in annotations.columns else []))).alias("first"))
    rows = seen.select("category", F.lit(1).alias("late"), F.lit(None).cast("bigint").alias("at"), "first")
    if registered is not None:
        known = registered.select("category", F.lit(0).alias("late"), F.col("ord").cast("bigint").alias("at"))
        rows = known.join(seen, "category", "left").select("category", "late", "at", "first").unionByName(rows.join(registered, "category", "left_anti"))
    names = rows.agg(F.array_sort(F.collect_list(F.struct("late", "at", "first", "category"))).alias("a"))  # classes, not rows of data
    return names.select(F.posexplode("a").alias("ord", "x")).select("x.category", "ord")


def dataset_kind(annotations: DataFrame) -> DataFrame:
    """(kind): bbox, image, mixed or unknown, by what annotations there are."""
    box, image = F.coalesce(F.bool_or((F.col("kind") == "bbox") & F.col("x1").isNotNull()), F.lit(False)), F.coalesce(F.bool_or(F.col("kind") == "image"), F.lit(False))
    return annotations.agg(F.when(box & image, "mixed").when(box, "bbox").when(image, "image").otherwise("unknown").alias("kind"))
