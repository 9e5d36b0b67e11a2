"""Class names: variants, validation, mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visionloom.functions.scalar import category_key


def suggest_merges(annotations: DataFrame) -> DataFrame:
    """Per key with two names or more: the name to keep (most used, then shortest, then last) and the total."""
    counts = annotations.groupBy("category").agg(F.count(F.lit(1)).alias("c"))
    groups = counts.groupBy(category_key(F.col("category")).alias("key")).agg(
        F.max_by("category", F.struct(F.col("c"), -F.length("category"), F.col("category"))).alias("suggested"),
        F.sum("c").alias("total"),
        F.array_join(F.array_sort(F.collect_list("category")), "|").alias("names"),
        F.count(F.lit(1)).alias("n"),
    )
    return groups.where("n > 1").select("key", "suggested", "total", "names")


def validate_names(names: DataFrame, column: str = "category") -> DataFrame:
    """(name, issue, severity) rows."""
    n, key = F.col(column), category_key(F.col(column))
    shared = names.select(n.alias("name"), key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and k <> ''")
    issues = F.filter(
        F.array(
            F.when(F.trim(n) == "", F.struct(F.lit("blank").alias("issue"), F.lit("error").alias("severity"))),
            F.when((F.trim(n) != "") & (F.trim(n) != n), F.struct(F.lit("padded").alias("issue"), F.lit("warning").alias("severity"))),
            F.when(n.rlike(r'[\\/:*?"<>|\x00-\x1f]'), F.struct(F.lit("illegal_character").alias("issue"), F.lit("error").alias("severity"))),
            F.when(n.isin(".", ".."), F.struct(F.lit("reserved").alias("issue"), F.lit("error").alias("severity"))),
            F.when(F.length(n) > 100, F.struct(F.lit("too_long").alias("issue"), F.lit("warning").alias("severity"))),
        ),
        lambda x: x.isNotNull(),
    )
    own = names.select(n.alias("name"), F.inline(issues))
    twins = names.select(n.alias("name"), key.alias("k")).join(shared, "k").select("name", F.lit("duplicate_key").alias("issue"), F.lit("warning").alias("severity"))
    return own.unionByName(twins)


def apply_mapping(images: DataFrame, annotations: DataFrame, mapping: DataFrame | None = None, kind: str | None = None, keep: list[str] | None = None, drop: list[str] = (), drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """Kind filter, then mapping(source, target), then the keep and drop lists on the mapped names; then images left
    without annotations go, if any annotation went. The mapping joins by its own size, so Spark decides on a broadcast."""
    rows = annotations.where(F.col("kind") == kind) if kind else annotations
    if mapping is not None:
        rows = rows.join(mapping.select(F.col("source").alias("category"), "target"), "category", "left").withColumn("category", F.coalesce("target", "category")).select(*annotations.columns)
    rows = rows.where(F.col("category").isin(list(keep))) if keep is not None else rows
    rows = rows.where(~F.col("category").isin(list(drop))) if drop else rows
    if drop_empty and (kind or keep is not None or drop):
        images = images.join(rows, F.expr("uid = image_uid"), "left_semi")
    return images, rows


def class_table(annotations: DataFrame, order: list[str] = ()) -> DataFrame:
    """(category, index): the given order first, then other names by first place in the sorted names."""
    names = annotations.select("category").distinct()
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))]), F.col("category")), F.lit(len(order))) if order else F.lit(0)
    rows = names.agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "category"))).alias("a"))  # classes, not rows of data
    return rows.select(F.posexplode("a").alias("index", "x")).select("x.category", "index")
