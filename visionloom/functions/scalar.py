"""Scalar column functions of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ["train", "val", "test"]
#: Spellings of splits.
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def make_uid(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by unit separators; null parts count as empty."""
    return F.left(F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), F.lit(16))


def normalize_split(s: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(s)))


def normalize_category(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def category_key(s: Column) -> Column:
    """Comparison key: lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(s), "[^0-9a-z]+", "")


def sanitize_class_name(s: Column) -> Column:
    clean = F.left(F.trim(F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"\s+", " ")), F.lit(100))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("class"))


def slug(s: Column, default: str = "src") -> Column:
    return F.coalesce(F.nullif(F.left(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", ""), F.lit(32)), F.lit("")), F.lit(default))


def box_area(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    return F.greatest(F.lit(0.0), F.col(x2) - F.col(x1)) * F.greatest(F.lit(0.0), F.col(y2) - F.col(y1))


def yolo_to_xyxy(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    cx, cy, bw, bh = xc * width, yc * height, w * width, h * height
    return F.struct((cx - bw / 2).alias("x1"), (cy - bh / 2).alias("y1"), (cx + bw / 2).alias("x2"), (cy + bh / 2).alias("y2"))


def parse_number(s: Column) -> Column:
    """Double, or null where blank, not a number or NaN."""
    return F.nullif(F.trim(s).try_cast("double"), F.lit(float("nan")))


def bucket(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bucket among ascending edges; values outside go to the first or last."""
    at = sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(value.isNotNull(), at)
