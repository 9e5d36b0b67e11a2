"""Quality rules over images and annotations. Each gives findings (rule, severity, action, image_uid, category, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visionloom.functions.scalar import SPLITS, box_area, category_key
from visionloom.operators.hamming import expand_pairs, near_duplicate_pairs, representative_pairs, representatives

EPS = 1e-3


def _finding(df: DataFrame, rule: str, severity: str, action: str, uid: str | None = "uid", category: str | None = None, n: str = "1") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), (F.col(uid) if uid else F.lit(None).cast("string")).alias("image_uid"), (F.col(category) if category else F.lit(None).cast("string")).alias("category"), F.expr(n).cast("bigint").alias("n"))


def invalid_size(images: DataFrame) -> DataFrame:
    return _finding(images.where("width <= 0 or height <= 0"), "image_invalid_size", "error", "remove_image")


def too_small(images: DataFrame, least: int = 32) -> DataFrame:
    return _finding(images.where("width > 0 and height > 0").where((F.col("width") < least) | (F.col("height") < least)), "image_too_small", "warning", "report")


def extreme_aspect(images: DataFrame, most: float = 20.0) -> DataFrame:
    ok = images.where("width > 0 and height > 0")
    return _finding(ok.where(F.greatest("width", "height") > F.least("width", "height") * F.lit(most)), "image_extreme_aspect", "info", "report")


def exact_duplicates(images: DataFrame) -> DataFrame:
    """All but the best copy (train, val, test, none; then uid) of equal content; a leak where copies' splits differ.

    Splits of a group come from a partial aggregate; the rank window holds thin rows only."""
    rank = F.expr("CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 9 END")
    seen = F.expr("CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 4 ELSE 0 END")
    thin = images.where("sha1 is not null").select("uid", "sha1", "split")
    groups = thin.groupBy("sha1").agg(F.min(F.struct(rank, "uid")).alias("best"), F.bit_or(seen).alias("seen"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = thin.join(groups, "sha1").where("uid <> best.uid")
    leak = F.bit_count("seen") > 1
    return copies.select(F.when(leak, "leak_duplicate_across_splits").otherwise("image_duplicate_exact").alias("rule"), F.when(leak, "error").otherwise("warning").alias("severity"), F.lit("remove_image").alias("action"), F.col("uid").alias("image_uid"), F.lit(None).cast("string").alias("category"), "n")


def near_duplicates(images: DataFrame, prints: DataFrame, distance: int = 6) -> DataFrame:
    """Findings on the second image by order of every close pair of prints(id, fp); a leak where both have a split and the
    splits differ.

    Images are joined with fingerprints, of which there is one an image, and not with pairs, of which there are many."""
    known = prints.join(images.select(F.col("uid").alias("id"), "split", "ord"), "id").select(F.struct("ord", F.col("id").alias("uid"), "split").alias("id"), "fp")
    pairs = expand_pairs(prints, representative_pairs(representatives(prints).select("fp"), distance), known).where("a.uid <> b.uid")
    leak = F.coalesce(F.col("a.split").isin(SPLITS) & F.col("b.split").isin(SPLITS) & (F.col("a.split") != F.col("b.split")), F.lit(False))
    return pairs.select(F.when(leak, "leak_near_duplicate_across_splits").otherwise("image_duplicate_near").alias("rule"), F.when(leak, "error").otherwise("info").alias("severity"), F.lit("report").alias("action"), F.col("b.uid").alias("image_uid"), F.lit(None).cast("string").alias("category"), F.col("distance").alias("n"))


def file_findings(images: DataFrame, probed: DataFrame, unreadable: DataFrame, orphans: DataFrame) -> DataFrame:
    """Findings of files: images(uid, path), probed(path, orientation), unreadable(path), orphans(rel)."""
    bad = _finding(images.join(unreadable, "path", "left_semi"), "image_unreadable", "error", "remove_image")
    turned = images.join(probed.where("orientation is not null and orientation not in (0, 1)").select("path", "orientation"), "path")
    lonely = _finding(orphans, "label_orphan", "warning", "report", None, "rel")
    return bad.unionByName(_finding(turned, "image_exif_orientation", "warning", "report", n="orientation")).unionByName(lonely)


def group_leaks(images: DataFrame) -> DataFrame:
    rows = images.where("grp is not null").where(F.col("split").isin(SPLITS)).groupBy("grp").agg(F.countDistinct("split").alias("s")).where("s > 1")
    return _finding(rows, "leak_group_across_splits", "error", "report", None, "grp", "s")


def _boxes(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return annotations.where("kind = 'bbox' and x1 is not null").join(images.select("uid", "width", "height"), F.expr("image_uid = uid"))


def out_of_bounds(images: DataFrame, annotations: DataFrame) -> DataFrame:
    rows = _boxes(images, annotations).where("width > 0 and height > 0").where((F.col("x1") < -EPS) | (F.col("y1") < -EPS) | (F.col("x2") > F.col("width") + EPS) | (F.col("y2") > F.col("height") + EPS))
    return _finding(rows, "label_out_of_bounds", "warning", "clamp", "image_uid", "category")


def label_invalid_size(images: DataFrame, annotations: DataFrame) -> DataFrame:
    rows = annotations.where("kind = 'bbox'").where((F.col("x2") - F.col("x1") <= EPS) | (F.col("y2") - F.col("y1") <= EPS))
    return _finding(rows, "label_invalid_size", "error", "remove_annotation", "image_uid", "category")


def box_areas(images: DataFrame, annotations: DataFrame, most: float = 0.95, least: float = 0.0) -> DataFrame:
    rows = _boxes(images, annotations).where("width > 0 and height > 0").withColumn("r", box_area() / (F.col("width") * F.col("height")))
    big = _finding(rows.where(F.col("r") > most), "label_box_too_large", "warning", "report", "image_uid", "category")
    small = _finding(rows.where((F.col("r") > 0) & (F.col("r") < least)), "label_box_too_small", "info", "report", "image_uid", "category")
    return big.unionByName(small) if least > 0 else big


def duplicate_labels(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One finding per repeat beyond the first of equal (image, category, box to 3 decimals), counted, not ranked."""
    keys = ["image_uid", "category", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")]]
    rows = annotations.where("kind = 'bbox' and x1 is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return _finding(rows, "label_duplicate", "warning", "remove_annotation", "image_uid", "category", "c - 1")


def without_annotation(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return _finding(images.join(annotations, F.expr("uid = image_uid"), "left_anti"), "image_without_annotation", "info", "report")


def name_variants(images: DataFrame, annotations: DataFrame) -> DataFrame:
    names = annotations.groupBy("category").count().groupBy(category_key(F.col("category")).alias("key")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return _finding(names, "category_name_variants", "warning", "report", None, "key", "c")


def few_instances(images: DataFrame, annotations: DataFrame, least: int = 5) -> DataFrame:
    return _finding(annotations.groupBy("category").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < least), "class_too_few", "warning", "report", None, "category", "c")


#: The rules in the order they run: (name, severity, action).
RULES = [
    ("image_unreadable", "error", "remove_image"),
    ("image_invalid_size", "error", "remove_image"),
    ("image_too_small", "warning", "report"),
    ("image_extreme_aspect", "info", "report"),
    ("image_exif_orientation", "warning", "report"),
    ("image_duplicate_exact", "warning", "remove_image"),
    ("image_duplicate_near", "info", "report"),
    ("leak_group_across_splits", "error", "report"),
    ("label_out_of_bounds", "warning", "clamp"),
    ("label_invalid_size", "error", "remove_annotation"),
    ("label_box_area", "warning", "report"),
    ("label_duplicate", "warning", "remove_annotation"),
    ("image_without_annotation", "info", "report"),
    ("category_name_variants", "warning", "report"),
    ("class_too_few", "warning", "report"),
    ("label_orphan", "warning", "report"),
]


#: Findings that have another name than the rule that gives them.
GIVEN_BY = {
    "leak_duplicate_across_splits": "image_duplicate_exact",
    "leak_near_duplicate_across_splits": "image_duplicate_near",
    "label_box_too_large": "label_box_area",
    "label_box_too_small": "label_box_area",
}


def list_rules(found: DataFrame) -> DataFrame:
    """(ord, rule, severity, action, findings) of every rule, with how many of the findings it gave."""
    rules = found.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "ord int, rule string, severity string, action string")
    names = F.create_map(*[F.lit(x) for pair in GIVEN_BY.items() for x in pair])
    counts = found.groupBy(F.coalesce(F.try_element_at(names, F.col("rule")), F.col("rule")).alias("rule")).agg(F.count(F.lit(1)).alias("findings"))
    return rules.join(counts, "rule", "left").select("ord", "rule", "severity", "action", F.coalesce("findings", F.lit(0)).alias("findings"))


def _flags(rules: list[tuple[str, Column, str | None]], disabled: tuple[str, ...]) -> Column:
    """Those of the rules (finding, when, category) that fire on a row, by their registered severity and action."""
    known = {r: (s, a) for r, s, a in RULES} | {"label_box_too_large": ("warning", "report"), "label_box_too_small": ("info", "report")}
    on = [F.when(when, F.struct(F.lit(r).alias("rule"), F.lit(known[r][0]).alias("severity"), F.lit(known[r][1]).alias("action"))) for r, when, _ in rules if r not in disabled and not (r.startswith("label_box_too") and "label_box_area" in disabled)]
    kind = "array<struct<rule:string,severity:string,action:string>>"
    return F.filter(F.array(*on), lambda x: x.isNotNull()) if on else F.array().cast(kind)


def _oob() -> Column:
    return (F.col("x1") < -EPS) | (F.col("y1") < -EPS) | (F.col("x2") > F.col("width") + EPS) | (F.col("y2") > F.col("height") + EPS)


def _thin() -> Column:
    return (F.col("x2") - F.col("x1") <= EPS) | (F.col("y2") - F.col("y1") <= EPS)


def findings(images: DataFrame, annotations: DataFrame, disabled: tuple[str, ...] = (), least_edge: int = 32, most_aspect: float = 20.0, most_area: float = 0.95, least_area: float = 0.0, least_instances: int = 5) -> DataFrame:
    """Findings of all rules but those named in disabled. Rules of one row are flags of one pass over images and one over
    boxes joined with them; a limit of 0 or less turns its rule off."""
    big, small = F.greatest("width", "height"), F.least("width", "height")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    one = _flags([("image_invalid_size", ~sized, None), ("image_too_small", sized & (small < least_edge), None), ("image_extreme_aspect", sized & F.lit(most_aspect > 0) & (big > small * F.lit(most_aspect)), None)], disabled)
    none = F.lit(None).cast("string")
    parts = [images.select("uid", F.inline(one)).select("rule", "severity", "action", F.col("uid").alias("image_uid"), none.alias("category"), F.lit(1).cast("bigint").alias("n"))]
    box = F.col("x1").isNotNull()
    share = F.try_divide(box_area(), F.col("width") * F.col("height"))
    flags = _flags([("label_out_of_bounds", box & sized & _oob(), None), ("label_invalid_size", _thin(), None), ("label_box_too_large", box & sized & (share > most_area), None), ("label_box_too_small", box & sized & F.lit(least_area > 0) & (share > 0) & (share < least_area), None)], disabled)
    rows = annotations.where("kind = 'bbox'").join(images.select("uid", "width", "height"), F.expr("image_uid = uid"), "left")
    parts.append(rows.select("image_uid", "category", F.inline(flags)).select("rule", "severity", "action", "image_uid", "category", F.lit(1).cast("bigint").alias("n")))
    rest = {
        "image_duplicate_exact": lambda: exact_duplicates(images),
        "leak_group_across_splits": lambda: group_leaks(images),
        "label_duplicate": lambda: duplicate_labels(images, annotations),
        "image_without_annotation": lambda: without_annotation(images, annotations),
        "category_name_variants": lambda: name_variants(images, annotations),
        "class_too_few": lambda: few_instances(images, annotations, least_instances),
    }
    return reduce(DataFrame.unionByName, parts + [f() for name, f in rest.items() if name not in disabled])


def summarize(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).cast("bigint").alias("findings"), F.sum("n").cast("bigint").alias("total"))


def cap(found: DataFrame, most: int) -> DataFrame:
    """The first findings of each rule, for display only; actions use all."""
    w = Window.partitionBy("rule").orderBy("image_uid", "category", "n")
    return found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def apply(images: DataFrame, annotations: DataFrame, disabled: tuple[str, ...] = (), unreadable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) after the actions of the rules that are not disabled, all found before any is taken.

    Boxes that reach outside are clamped, those left without area go; thin boxes and repeats (equal image, category and
    box to 3 decimals, one stays) go; images of invalid size, unreadable(path) ones and exact copies go with their
    annotations, as do annotations of no image."""
    on = lambda r: r not in disabled
    gone = [exact_duplicates(images).select("image_uid")] if on("image_duplicate_exact") else []
    if unreadable is not None and on("image_unreadable"):
        gone.append(images.join(unreadable, "path", "left_semi").select(F.col("uid").alias("image_uid")))
    sized = images.where(~F.coalesce(F.expr("width <= 0 or height <= 0"), F.lit(False))) if on("image_invalid_size") else images
    kept = sized.join(reduce(DataFrame.unionByName, gone), F.expr("uid = image_uid"), "left_anti") if gone else sized
    rows = annotations.join(kept.select("uid", "width", "height"), F.expr("image_uid = uid"))
    boxes = rows.where("kind = 'bbox'")
    if on("label_invalid_size"):
        boxes = boxes.where(~F.coalesce(_thin(), F.lit(False)))
    if on("label_duplicate"):
        keys = {f"__{c}": F.round(c, 3) for c in ("x1", "y1", "x2", "y2")}
        boxes = boxes.withColumns(keys).dropDuplicates(["image_uid", "category", *keys]).drop(*keys)
    if on("label_out_of_bounds"):
        out = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & _oob(), F.lit(False))
        boxes = boxes.withColumn("__out", out)
        clamp = lambda c: F.when(F.col("__out"), F.greatest(F.lit(0.0), F.least(F.col(c), F.col("width" if c[0] == "x" else "height").cast("double")))).otherwise(F.col(c))
        boxes = boxes.withColumns({c: clamp(c) for c in ("x1", "y1", "x2", "y2")}).where("not __out or (x2 - x1 > 1e-6 and y2 - y1 > 1e-6)")
    return kept, boxes.select(*annotations.columns).unionByName(rows.where("kind <> 'bbox'").select(*annotations.columns))


def emptied(images: DataFrame, annotations: DataFrame) -> int:
    """How many images have no annotation."""
    return images.join(annotations, F.expr("uid = image_uid"), "left_anti").count()
