"""Distributions of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visionloom.functions.scalar import SPLITS, box_area, bucket

OBJECT_EDGES = [0, 1, 2, 3, 5, 10, 20, 50, 100]  # fixed values
AREA_EDGES = [0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0]


def stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    i = images.agg(F.count(F.lit(1)).alias("images"), F.count_distinct("grp").alias("groups"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    a = annotations.agg(F.count(F.lit(1)).alias("annotations"), F.count_if(F.col("kind") == "bbox").alias("boxes"), F.count_distinct("category").alias("categories"))
    return i.crossJoin(a)  # one row each


def class_distribution(annotations: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(category, count, share) of the registered classes(category), those without instances too, and of other names seen."""
    rows = annotations.select("category", F.lit(1).alias("c"))
    if classes is not None:
        rows = rows.unionByName(classes.select("category", F.lit(0).alias("c")))
    counts = rows.groupBy("category").agg(F.sum("c").alias("count"))
    total = counts.agg(F.greatest(F.sum("count"), F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "count", F.round(F.col("count") / F.col("total"), 6).alias("share"))


def class_by_split(images: DataFrame, annotations: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(category, train, val, test, unassigned): zero-filled for registered classes; annotations of no image don't count."""
    rows = annotations.join(images.select("uid", F.coalesce("split", F.lit("unassigned")).alias("split")), F.expr("image_uid = uid")).select("category", "split")
    if classes is not None:
        rows = rows.unionByName(classes.select("category", F.lit(None).cast("string").alias("split")))
    return rows.groupBy("category").agg(*[F.count_if(F.col("split") == s).alias(s) for s in [*SPLITS, "unassigned"]])


def size_categories(annotations: DataFrame) -> DataFrame:
    area = box_area()
    size = F.when(area < 1024, "small").when(area <= 9216, "medium").otherwise("large")
    counts = annotations.where("kind = 'bbox' and x1 is not null").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c"))
    names = annotations.sparkSession.createDataFrame([("small",), ("medium",), ("large",)], "size string")
    return names.join(F.broadcast(counts), "size", "left").select("size", F.coalesce("c", F.lit(0)).alias("count"))


def objects_per_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    per = annotations.groupBy("image_uid").agg(F.count(F.lit(1)).alias("c"))
    n = images.join(per, F.expr("uid = image_uid"), "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    return n.groupBy(bucket(F.col("c"), OBJECT_EDGES).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("images"))


def area_ratios(images: DataFrame, annotations: DataFrame) -> DataFrame:
    rows = annotations.where("x1 is not null").join(images.where("width > 0 and height > 0").select("uid", "width", "height"), F.expr("image_uid = uid"))
    return rows.groupBy(bucket(box_area() / (F.col("width") * F.col("height")), AREA_EDGES).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("boxes"))


def image_sizes(images: DataFrame, top: int = 12) -> DataFrame:
    sizes = images.groupBy("width", "height").agg(F.count(F.lit(1)).alias("images"), F.min("ord").alias("first"))
    return sizes.orderBy(F.desc("images"), "first").limit(top).select("width", "height", "images")


def split_summary(images: DataFrame, annotations: DataFrame) -> DataFrame:
    i = images.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count(F.lit(1)).alias("images"))
    rows = annotations.join(images.select("uid", "split"), F.expr("image_uid = uid"))
    a = rows.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count(F.lit(1)).alias("annotations"), F.count_if(F.col("kind") == "bbox").alias("boxes"), F.count_distinct("category").alias("classes"))
    return i.join(a, "split", "left").na.fill(0)


def imbalance(annotations: DataFrame, under: int = 20) -> DataFrame:
    counts = annotations.groupBy("category").agg(F.count(F.lit(1)).alias("c"))
    row = counts.agg(F.max_by("category", F.struct("c", "category")).alias("max_class"), F.max("c").alias("max_count"), F.min_by("category", F.struct("c", "category")).alias("min_class"), F.min("c").alias("min_count"), F.count_if(F.col("c") < under).alias("underrepresented"))
    return row.withColumn("ratio", F.round(F.try_divide("max_count", "min_count"), 4))


def distribution_shift(images: DataFrame, annotations: DataFrame, least: float = 0.1, top: int = 4) -> DataFrame:
    """Classes whose share in val or test differs from their share overall by `least` or more, the largest first."""
    rows = annotations.join(images.select("uid", "split"), F.expr("image_uid = uid"))
    counts = rows.groupBy("split", "category").agg(F.count(F.lit(1)).alias("c"))
    of = lambda n: F.coalesce(F.sum(F.when(F.col("split") == n, F.col("c"))), F.lit(0)).alias(n)
    per = counts.groupBy("category").agg(F.sum("c").alias("all"), of("val"), of("test"))  # a class without rows in a split has share 0
    totals = F.broadcast(per.agg(*[F.sum(c).alias(f"{c}_total") for c in ("all", "val", "test")]))  # one row
    each = F.array(*[F.when(F.col(f"{n}_total") > 0, F.struct(F.lit(n).alias("split"), (F.col(n) / F.nullif(f"{n}_total", F.lit(0))).alias("share"))) for n in ("val", "test")])
    wide = per.crossJoin(totals).select("category", (F.col("all") / F.col("all_total")).alias("base"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("s"))
    diff = wide.select("s.split", "category", F.round(F.col("s.share") - F.col("base"), 6).alias("shift"))
    return diff.where(F.abs("shift") >= least).orderBy(F.desc(F.abs("shift")), "split", "category").limit(top).select("split", "category", "shift")


def round_robin(images: DataFrame, annotations: DataFrame, limit: int = 24) -> DataFrame:
    """A sample of images, one of each class in turn by order, classes by name; then images without annotations by order.

    An image belongs to the class of its first annotation by `ord` (its smallest class where annotations have none)."""
    if limit <= 0:
        return images.limit(0).select("uid", F.lit(None).cast("string").alias("category"), F.lit(0).cast("bigint").alias("turn"))
    by = "ord" if "ord" in annotations.columns else "category"
    first = annotations.groupBy("image_uid").agg(F.min_by("category", F.struct(by, "category")).alias("category"))
    rows = images.select("uid", "ord").join(first, F.expr("uid = image_uid"), "left").select("uid", "ord", "category")
    w = Window.partitionBy("category").orderBy("ord", "uid")  # of each class only the first `limit` leave a task
    turn = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return turn.orderBy(F.col("category").isNull(), "turn", "category").limit(limit).select("uid", "category", F.col("turn").cast("bigint").alias("turn"))


def check_page(offset: int, limit: int, most: int = 200) -> None:
    if offset < 0 or not 1 <= limit <= most:
        raise ValueError(f"offset must be 0 or more and limit 1 to {most}")


def browse(images: DataFrame, annotations: DataFrame, split: str | None = None, source: str | None = None, search: str = "", category: str | None = None, min_edge: int = 0, max_edge: int | None = None, min_objects: int = 0, offset: int = 0, limit: int = 50) -> DataFrame:
    check_page(offset, limit)
    rows = _browsed(images, annotations, split, source, search, category, min_edge, max_edge, min_objects)
    return rows.orderBy("rel_path", "uid").offset(offset).limit(limit).select("uid", "rel_path", "objects")


def after(rows: DataFrame, cursor: tuple[str, str] | None) -> DataFrame:
    """Rows behind the cursor (rel_path, uid), in that order: a range of rel_path that the scan can prune, then ties by uid."""
    if cursor is None:
        return rows
    path, uid = F.lit(cursor[0]), F.lit(cursor[1])
    return rows.where(F.col("rel_path") >= path).where((F.col("rel_path") > path) | (F.col("uid") > uid))


def browse_after(images: DataFrame, annotations: DataFrame, cursor: tuple[str, str] | None = None, limit: int = 50, split: str | None = None, source: str | None = None, search: str = "", category: str | None = None, min_edge: int = 0, max_edge: int | None = None, min_objects: int = 0) -> DataFrame:
    """The page of browse that comes after the cursor, the rel_path and uid of the last row of the page before; None: the first.

    Nothing before the cursor is sorted or counted: rows are pruned by range, and where min_objects asks nothing of them,
    the page is taken before its objects are counted. A page costs the same wherever it is."""
    check_page(0, limit)
    if min_objects > 0:
        rows = _browsed(after(images, cursor), annotations, split, source, search, category, min_edge, max_edge, min_objects)
        return rows.orderBy("rel_path", "uid").limit(limit).select("uid", "rel_path", "objects")
    page = _filtered(after(images, cursor), annotations, split, source, search, category, min_edge, max_edge).orderBy("rel_path", "uid").limit(limit).select("uid", "rel_path")
    per = annotations.join(F.broadcast(page.select(F.col("uid").alias("image_uid"))), "image_uid", "left_semi").groupBy("image_uid").agg(F.count(F.lit(1)).alias("objects"))  # a page of at most 200 rows
    return page.join(per, F.expr("uid = image_uid"), "left").select("uid", "rel_path", F.coalesce("objects", F.lit(0)).alias("objects"))


def _filtered(images: DataFrame, annotations: DataFrame, split: str | None, source: str | None, search: str, category: str | None, min_edge: int, max_edge: int | None) -> DataFrame:
    edge = F.greatest("width", "height")
    rows = images.where(edge >= min_edge)
    rows = rows.where(edge <= max_edge) if max_edge is not None else rows
    rows = rows.where(F.col("split") == split) if split else rows
    rows = rows.where(F.col("source_id") == source) if source else rows
    rows = rows.where(F.lower("rel_path").contains(search.lower())) if search else rows
    return rows.join(annotations.where(F.col("category") == category), F.expr("uid = image_uid"), "left_semi") if category else rows


def _browsed(images: DataFrame, annotations: DataFrame, split: str | None, source: str | None, search: str, category: str | None, min_edge: int, max_edge: int | None, min_objects: int) -> DataFrame:
    rows = _filtered(images, annotations, split, source, search, category, min_edge, max_edge)
    per = annotations.groupBy("image_uid").agg(F.count(F.lit(1)).alias("objects"))
    return rows.join(per, F.expr("uid = image_uid"), "left").withColumn("objects", F.coalesce("objects", F.lit(0))).where(F.col("objects") >= min_objects)


def concentration(annotations: DataFrame, share: float = 0.2) -> DataFrame:
    """(classes, top, top_share): the share of the annotations that the largest `share` of the classes hold, one at least."""
    counts = annotations.groupBy("category").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.agg(F.sort_array(F.collect_list("c"), asc=False).alias("a"))  # a number a class, not rows of data
    top = F.greatest(F.lit(1), F.floor(F.size("a") * share).cast("int"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    rows = sizes.where(F.size("a") > 0).select(F.size("a").cast("bigint").alias("classes"), top.cast("bigint").alias("top"), F.round(add(F.slice("a", F.lit(1), top)) / add(F.col("a")), 4).alias("top_share"))
    return rows


def findings(images: DataFrame, annotations: DataFrame, under: int = 20) -> DataFrame:
    """(code, level, value) of what the distributions show; level is error, warning, info or advice.

    few_instances: classes below `under`. imbalanced: largest to smallest class, from 10. mostly_small and mostly_large:
    share of boxes, over a half and over 0.8. unlabeled: images without annotation, an error where all annotations are
    image labels. unassigned: images without split; where there are none, missing_in_val and missing_in_test: classes.
    shifted: classes whose share in val or test is 0.1 or more off. mixed_sizes: share of the commonest size, below 0.8.
    one_size: all images alike. healthy: none of the advice applies. All from grouped counts, joined as single rows.
    """
    area, box = box_area(), F.col("kind") == "bbox"
    one = annotations.join(images.select("uid", "split"), F.expr("image_uid = uid"), "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("uid").isNotNull()).alias("held"), *[F.count_if(F.col("split") == s).alias(s) for s in ("val", "test")],
        F.count_if(box).alias("boxes"), F.count_if(F.col("kind") == "image").alias("labels"), F.count_if(box & (area < 1024)).alias("small"), F.count_if(box & (area > 9216)).alias("large"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("boxes", "labels", "small", "large")]
    fields = ("c", "held", "val", "test")
    per = one.agg(F.collect_list(F.struct(*fields)).alias("a"), *sums)  # a row a class, not rows of data
    add = lambda f: F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x[f])
    per = per.withColumns({f"all_{f}": add(f) for f in fields})
    far = lambda x, s: (F.col(f"all_{s}") > 0) & (F.abs(F.round(F.try_divide(x[s], F.col(f"all_{s}")) - F.try_divide(x["held"], F.col("all_held")), 6)) >= 0.1)
    size = lambda f: F.size(F.filter("a", f))
    per = per.select(
        "boxes", "labels", "small", "large", size(lambda x: x["c"] < under).alias("few"),
        F.try_divide(F.array_max(F.transform("a", lambda x: x["c"])), F.array_min(F.transform("a", lambda x: x["c"]))).alias("ratio"),
        size(lambda x: (x["held"] > 0) & (x["val"] == 0)).alias("no_val"), size(lambda x: (x["held"] > 0) & (x["test"] == 0)).alias("no_test"),
        (size(lambda x: (x["held"] > 0) & far(x, "val")) + size(lambda x: (x["held"] > 0) & far(x, "test"))).alias("shifted"),
    )
    bare = images.join(annotations, F.expr("uid = image_uid"), "left_anti").agg(F.count(F.lit(1)).alias("bare"))
    loose = F.count_if(~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)))
    sizes = images.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"), loose.alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("images"), F.coalesce(F.sum("l"), F.lit(0)).alias("loose"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("commonest"))
    row = per.crossJoin(F.broadcast(bare)).crossJoin(F.broadcast(sizes))  # one row each
    total = F.greatest("boxes", F.lit(1))
    all_split = F.col("loose") == 0
    only_labels = (F.col("labels") > 0) & (F.col("boxes") == 0)
    common = F.try_divide("commonest", "images")

    def rule(when: Column, code: str, level: str | Column, value: Column) -> Column:
        level = F.lit(level) if isinstance(level, str) else level
        return F.when(when, F.struct(F.lit(code).alias("code"), level.alias("level"), F.round(value.cast("double"), 4).alias("value")))

    c = F.col
    advice = [
        rule(c("few") > 0, "few_instances", "warning", c("few")),
        rule(c("ratio") >= 10, "imbalanced", "advice", c("ratio")),
        rule(c("small") / total > 0.5, "mostly_small", "advice", c("small") / total),
        rule(c("large") / total > 0.8, "mostly_large", "advice", c("large") / total),
        rule(c("bare") > 0, "unlabeled", F.when(only_labels, "error").otherwise("info"), c("bare")),
        rule(~all_split, "unassigned", "info", c("loose")),
        rule(all_split & (c("no_val") > 0), "missing_in_val", "warning", c("no_val")),
        rule(all_split & (c("no_test") > 0), "missing_in_test", "warning", c("no_test")),
        rule(c("shifted") > 0, "shifted", "warning", c("shifted")),
        rule((c("kinds") > 1) & (common < 0.8), "mixed_sizes", "info", common),
    ]
    some = F.filter(F.array(*advice), lambda x: x.isNotNull())
    alike = rule(c("kinds") == 1, "one_size", "info", common)
    healthy = rule(F.size(some) == 0, "healthy", "info", F.lit(None))
    return row.select(F.inline(F.concat(some, F.filter(F.array(alike, healthy), lambda x: x.isNotNull()))))
