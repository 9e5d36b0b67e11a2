"""Evaluation results, comparison, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, predicted: str, true: str) -> DataFrame:
    """Dense (predicted, true, n) over all classes seen on either side; classes are few, rows are pre-aggregated."""
    counts = rows.groupBy(F.col(predicted).alias("predicted"), F.col(true).alias("true")).agg(F.count(F.lit(1)).alias("c"))
    names = counts.select(F.explode(F.array("predicted", "true")).alias("k")).where("k is not null").distinct()
    grid = names.select(F.col("k").alias("predicted")).crossJoin(F.broadcast(names.select(F.col("k").alias("true"))))
    return grid.join(counts, ["predicted", "true"], "left").select("predicted", "true", F.coalesce("c", F.lit(0)).alias("n"))


def normalize_labels(labels: str, background: str = "background"):
    """Moves a leading background label to the end, unless one is there already; the matrix stays."""
    a = F.col(labels)
    wrong = (F.get(a, F.lit(0)) == background) & (F.get(a, F.size(a) - 1) != background)
    return F.when(wrong, F.concat(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1))).otherwise(a)


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class from a dense confusion table."""
    hit = matrix.where(F.col("predicted") == F.col("true")).select(F.col("true").alias("name"), F.col("n").alias("tp"))
    p = matrix.groupBy(F.col("predicted").alias("name")).agg(F.sum("n").alias("pred"))
    t = matrix.groupBy(F.col("true").alias("name")).agg(F.sum("n").alias("instances"))
    rows = hit.join(p, "name").join(t, "name").withColumns({"precision": F.round(F.try_divide("tp", "pred"), 6), "recall": F.round(F.try_divide("tp", "instances"), 6)})
    return rows.select("name", "instances", "precision", "recall", F.round(F.try_divide(2 * F.col("tp"), F.col("pred") + F.col("instances")), 6).alias("f1"))


def compare(per_class: DataFrame, models: list[str]) -> DataFrame:
    """Class table of (model, name, ap): a row per class, a column per model, null where missing."""
    return per_class.groupBy("name").pivot("model", models).agg(F.max("ap"))


def best_by(rows: DataFrame, metric: str, label: str = "label", order: str = "ord", mode: str = "max") -> DataFrame:
    v = F.col(metric) if mode == "max" else -F.col(metric)
    return rows.where(F.col(metric).isNotNull()).agg(F.max_by(label, F.struct(v, -F.col(order))).alias("best"))


def latest(evals: DataFrame, by: list[str]) -> DataFrame:
    """The newest row of each key, by created_at then eval_id."""
    return evals.groupBy(*by).agg(F.max_by(F.struct(*evals.columns), F.struct("created_at", "eval_id")).alias("e")).select("e.*")


def upsert(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return registry.join(new, key, "left_anti").unionByName(new)


#: Metrics in the order of columns.
METRIC_ORDER = ["mAP50-95", "mAP50", "precision", "recall", "f1", "top1", "top5"]
#: Names of overall results.
OVERALL = {"metrics/precision(B)": "precision", "metrics/recall(B)": "recall", "metrics/mAP50(B)": "mAP50", "metrics/mAP50-95(B)": "mAP50-95", "fitness": "fitness", "metrics/accuracy_top1": "top1", "metrics/accuracy_top5": "top5"}


def overall(results: DataFrame, per_class: DataFrame) -> DataFrame:
    """(eval_id, metric, value) of results(eval_id, key, value): known keys renamed, nulls and NaN left out, 6 digits; f1
    is the mean of the classes' f1 where it is not given."""
    names = F.create_map(*[F.lit(x) for kv in (OVERALL | {"f1": "f1"}).items() for x in kv])
    known = results.select("eval_id", F.try_element_at(names, F.col("key")).alias("metric"), F.round(F.nullif("value", F.lit(float("nan"))), 6).alias("value")).where("metric is not null and value is not null")
    mean = per_class.groupBy("eval_id").agg(F.round(F.avg("f1"), 6).alias("value")).where("value is not null")
    lacking = mean.join(known.where("metric = 'f1'"), "eval_id", "left_anti")
    return known.unionByName(lacking.select("eval_id", F.lit("f1").alias("metric"), "value"))


def per_class_rows(payloads: DataFrame) -> DataFrame:
    """A row per class of payloads(eval_id, names map, ap_class_index, p, r, f1, ap50, ap, nt_per_class arrays): the arrays
    go by the place of the class in ap_class_index, instances by its number; short arrays give nulls, no count 0."""
    rows = payloads.select("*", F.posexplode("ap_class_index").alias("at", "index"))
    at = lambda c: F.nullif(F.get(c, F.col("at")), F.lit(float("nan")))
    name = F.coalesce(F.try_element_at("names", F.col("index")), F.concat(F.lit("class_"), "index"))
    return rows.select("eval_id", "index", name.alias("name"), F.coalesce(F.get("nt_per_class", F.col("index")), F.lit(0)).cast("bigint").alias("instances"), at("p").alias("precision"), at("r").alias("recall"), at("f1").alias("f1"), at("ap50").alias("ap50"), at("ap").alias("ap50_95"))


def comparison_notes(evals: DataFrame, per_class: DataFrame) -> DataFrame:
    """(note, detail): several_splits, different_classes and failed over evals(label, eval_id, split, ok)."""
    split = evals.where("split <> ''").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("detail"), F.count_distinct("split").alias("n"))
    sets = per_class.join(F.broadcast(evals.select("eval_id")), "eval_id", "left_semi").groupBy("eval_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "\x1f").alias("s"))
    seen = evals.select("eval_id").join(sets, "eval_id", "left").agg(F.count_distinct(F.coalesce("s", F.lit(""))).alias("n"))
    bad = evals.where("not ok").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("detail"), F.count(F.lit(1)).alias("n"))
    note = lambda df, name, least, detail: df.where(F.col("n") >= least).select(F.lit(name).alias("note"), detail.alias("detail"))
    return note(split, "several_splits", 2, F.col("detail")).unionByName(note(seen, "different_classes", 2, F.col("n").cast("string"))).unionByName(note(bad, "failed", 1, F.col("detail")))


def attach(cards: DataFrame, new: DataFrame, key: str = "model_id", items: str = "evals", item: str = "eval_id", order: str = "created_at") -> DataFrame:
    """cards with the struct column `item_row` of new(key, item_row) put in the array `items`: one of the same id is
    replaced, the array stays in order of time."""
    rows = cards.join(new.select(key, "item_row"), key, "left")
    others = F.filter(F.coalesce(items, F.array().cast(cards.schema[items].dataType)), lambda e: e[item] != F.col("item_row")[item])
    by = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    return rows.withColumn(items, F.when(F.col("item_row").isNull(), F.col(items)).otherwise(F.array_sort(F.concat(others, F.array("item_row")), by))).select(*cards.columns)
