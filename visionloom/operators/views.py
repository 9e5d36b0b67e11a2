"""Datasets for SQL: temporary views of the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visionloom.operators.samples import box_columns


def register_views(images: DataFrame, annotations: DataFrame, prefix: str = "") -> list[str]:
    """Views <prefix>images, <prefix>annotations (with is_bbox, box_width, box_height, area and xywh), <prefix>objects
    (annotations with the columns of their image, named image_<column>) and <prefix>classes (category, images, objects).
    They are plans, not copies: a query over a view is pruned and pushed down as one over its tables. Gives their names."""
    named = images.select(*[F.col(c).alias(c if c == "image_uid" else f"image_{c}") for c in images.columns if c != "image_uid"])
    views = {
        "images": images,
        "annotations": box_columns(annotations),
        "objects": box_columns(annotations).join(named, "image_uid"),
        "classes": annotations.groupBy("category").agg(F.count_distinct("image_uid").alias("images"), F.count(F.lit(1)).alias("objects")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
