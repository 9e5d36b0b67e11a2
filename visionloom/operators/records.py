"""Documents as tables: cards, jobs and registry entries read back and written, models registered, runs resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visionloom.functions.display import name_slug

_IMAGES = "uid string, rel_path string, source_id string, width int, height int, split string, grp string, sha1 string, ord long"
_ANNOTATIONS = "image_uid string, category string, kind string, x1 double, y1 double, x2 double, y2 double, score double"


def parse_documents(rows: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """rows with the fields of their JSON document; rows whose text is no JSON object are left out, unknown keys ignored."""
    doc = F.from_json(text, T.StructType.fromDDL(schema), {"mode": "PERMISSIVE"})
    whole = F.trim(text).startswith("{") & F.json_object_keys(text).isNotNull()
    return rows.where(whole).withColumn("__doc", doc).select(*[c for c in rows.columns if c != text], "__doc.*")


def scan_documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The documents of one file name anywhere below root, with their path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return parse_documents(raw.select(F.input_file_name().alias("path"), "value"), schema)


def newest_first(rows: DataFrame, time: str = "created_at", key: str = "id", limit: int | None = None) -> DataFrame:
    """By time, as text, then key, the latest first."""
    out = rows.orderBy(F.desc(F.coalesce(time, F.lit(""))), F.desc(key))
    return out if limit is None else out.limit(limit)


def write_documents(rows: DataFrame, out: str, key: str) -> None:
    """One JSON file, named by the key, for each row; a repeated task writes the same file again."""
    from visionloom.operators.export import write_text_files

    write_text_files(rows.select(F.concat(F.col(key).cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(*rows.columns)).alias("text")), out)


def save_snapshot(images: DataFrame, annotations: DataFrame, out: str, fmt: str = "json") -> None:
    """A dataset as tables of JSON lines or Parquet below out."""
    for name, df in (("images", images), ("annotations", annotations)):
        df.write.mode("overwrite").format(fmt).save(f"{out}/{name}")


def load_snapshot(spark: SparkSession, root: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """The tables of a snapshot; columns that it lacks are null, others are ignored."""
    return tuple(spark.read.schema(s).format(fmt).load(f"{root}/{name}") for name, s in (("images", _IMAGES), ("annotations", _ANNOTATIONS)))


def with_dataset(runs: DataFrame, cards: DataFrame) -> DataFrame:
    """runs(..., data_yaml) with the card(folder, ...) of the folder that holds their data.yaml; runs without one stay."""
    own = cards.select(F.regexp_replace("folder", "/+$", "").alias("__folder"), *[c for c in cards.columns if c != "folder"])
    return runs.withColumn("__folder", F.regexp_extract("data_yaml", "^(.*)/[^/]+$", 1)).join(own, "__folder", "left").drop("__folder")


def model_metric(cards: DataFrame, metric: str, split: str | None = None) -> DataFrame:
    """cards(model_id, evals array<struct<split, created_at, overall map>>, best map) with `value`: of the newest evaluation
    (of the split, if one is named), else of the best epoch of training; null where neither has it."""
    mine = F.filter("evals", lambda e: e["split"] == split) if split else F.col("evals")
    last = F.array_max(F.transform(mine, lambda e: F.struct(e["created_at"].alias("at"), F.try_element_at(e["overall"], F.lit(metric)).alias("v"))))
    return cards.withColumn("value", F.coalesce(last["v"], F.try_element_at("best", F.lit(metric))))


def register_external(registry: DataFrame, candidates: DataFrame, files: DataFrame, datasets: DataFrame | None = None, tasks: tuple[str, ...] = ("detect", "classify")) -> DataFrame:
    """(ord, weights, model_id, problem, is_new, name, task, classes, note) of candidates(ord, weights, name, task, data_yaml,
    model_id, classes array<string>, at timestamp) against registry(model_id, weights), files(path) and the class names
    of datasets(data_yaml, classes).

    problem: missing_weights, format, missing_yaml, task, bad_id or taken_id, in this order; such rows get no id. A weight
    that is registered already, whatever the case, keeps that card. Of candidates with one weight the first without one of
    the first four problems claims it, and the others share its outcome. A told id becomes a slug and is refused where the
    registry or an earlier claim has it; without one the id is ext_<slug>_<time>, with hex digits behind it where that is
    taken. Classes are those told, else those of the yaml. Sets decide, not one candidate after another: ids are unique."""
    there = files.select("path").distinct()
    rows = candidates.join(there.select(F.col("path").alias("weights"), F.lit(True).alias("__w")), "weights", "left").join(there.select(F.col("path").alias("data_yaml"), F.lit(True).alias("__y")), "data_yaml", "left")
    given = F.coalesce("data_yaml", F.lit("")) != ""
    problem = F.when(F.col("__w").isNull(), "missing_weights").when(~F.lower("weights").endswith(".pt"), "format").when(given & F.col("__y").isNull(), "missing_yaml").when(~F.coalesce(F.col("task").isin(*tasks), F.lit(False)), "task")
    stem = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.regexp_extract("weights", r"([^/]+?)(\.[^./]*)?$", 1))
    rows = rows.withColumns({"problem": problem, "key": F.lower("weights"), "name": stem})
    known = registry.groupBy(F.lower("weights").alias("key")).agg(F.min("model_id").alias("known"))
    first = rows.where("problem is null").groupBy("key").agg(F.min(F.struct("ord", F.coalesce("model_id", F.lit("")).alias("told"), "name", "at")).alias("c")).select("key", "c.*").join(known, "key", "left")
    told, slug = name_slug(F.col("told"), 64), F.coalesce(F.nullif(name_slug(F.col("name")), F.lit("")), F.lit("model"))
    auto = F.concat_ws("_", F.lit("ext"), slug, F.date_format("at", "yyyyMMdd_HHmmss"))
    first = first.withColumn("id", F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("told") == "", auto).otherwise(told)).withColumn("auto", F.col("known").isNull() & (F.col("told") == ""))
    taken = registry.select(F.col("model_id").alias("id"), F.lit(True).alias("held")).distinct()
    fresh = first.where("known is null")
    firsts = fresh.groupBy("id", "auto").agg(F.min("ord").alias("o"))  # at an id the first claim counts, told ones before automatic ones
    told_first, auto_first = firsts.where("not auto").select("id", F.col("o").alias("told_o")), firsts.where("auto").select("id", F.col("o").alias("auto_o"))
    judged = fresh.join(taken, "id", "left").join(told_first, "id", "left").join(auto_first, "id", "left")
    free = F.col("held").isNull() & F.when(F.col("auto"), F.col("told_o").isNull() & (F.col("auto_o") == F.col("ord"))).otherwise(F.col("told_o") == F.col("ord"))
    longer = F.concat_ws("_", "id", F.left(F.md5(F.col("key").cast("binary")), F.lit(12)))
    ids = judged.select("key", F.when((F.col("id") == "") & ~F.col("auto"), "bad_id").when(~F.col("auto") & ~free, "taken_id").alias("why"), F.when(free, F.col("id")).when(F.col("auto"), longer).alias("new_id"), F.col("ord").alias("claim"))
    out = rows.join(first.where("known is not null").select("key", "known"), "key", "left").join(ids, "key", "left")
    if datasets is not None:
        out = out.join(datasets.groupBy("data_yaml").agg(F.first("classes").alias("__classes")), "data_yaml", "left")
    else:
        out = out.withColumn("__classes", F.lit(None).cast("array<string>"))
    why = F.coalesce("problem", "why")
    none = F.array().cast("array<string>")
    classes = F.when(F.size(F.coalesce("classes", none)) > 0, F.col("classes")).otherwise(F.coalesce("__classes", none))
    new = why.isNull() & F.col("known").isNull() & (F.col("claim") == F.col("ord"))
    return out.select("ord", "weights", F.when(why.isNull(), F.coalesce("known", "new_id")).alias("model_id"), why.alias("problem"), F.coalesce(new, F.lit(False)).alias("is_new"), "name", "task", classes.alias("classes"), F.when(new, F.when(given, "external weights").otherwise("external weights; an evaluation needs a data.yaml")).alias("note"))


def find_by_weight(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(weights) with the model_id of the registry entry of the same path, whatever the case; null where none."""
    known = registry.groupBy(F.lower("weights").alias("__key")).agg(F.min("model_id").alias("model_id"))
    return wanted.join(known, F.lower("weights") == F.col("__key"), "left").drop("__key")


def model_for_job(files: DataFrame) -> DataFrame:
    """(run, weights, is_best) of files(run, path): the run's best.pt, else its last.pt."""
    rank = F.when(F.col("path").rlike(r"(^|/)best\.pt$"), 0).when(F.col("path").rlike(r"(^|/)last\.pt$"), 1)
    return files.where(rank.isNotNull()).groupBy("run").agg(F.min(F.struct(rank.alias("r"), "path")).alias("w")).select("run", F.col("w.path").alias("weights"), (F.col("w.r") == 0).alias("is_best"))


def auto_evals(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Evaluation settings (run, weights, data_yaml, split, task, tag) of finished jobs(run, data_yaml, test, task) that
    have a data.yaml and weights."""
    from visionloom.functions.display import pick_split

    rows = jobs.where("coalesce(data_yaml, '') <> ''").join(model_for_job(files), "run").withColumn("split", pick_split(F.col("test")))
    return rows.select("run", "weights", "data_yaml", "split", F.coalesce("task", F.lit("detect")).alias("task"), F.concat_ws("_", "run", "split").alias("tag"))


def discover_weights(registry: DataFrame, deploys: DataFrame, files: DataFrame) -> DataFrame:
    """(path, label, origin): weights of the registry(label, weights), then good artifacts of deploys(label, artifacts
    array<struct<path, ok>>), those that are in files(path), each path once whatever its case."""
    own = registry.select(F.col("weights").alias("path"), "label", F.lit(0).alias("rank"))
    made = deploys.select("label", F.inline("artifacts")).where("ok").select("path", "label", F.lit(1).alias("rank"))
    rows = own.unionByName(made).join(files.select("path").distinct(), "path", "left_semi")
    first = rows.groupBy(F.lower("path").alias("key")).agg(F.min(F.struct("rank", "label", "path")).alias("w"))
    return first.select("w.path", "w.label", F.when(F.col("w.rank") == 0, "registry").otherwise("deploy").alias("origin"))


def resume(attempts: DataFrame) -> DataFrame:
    """One series of the attempts (run_id, attempt, epoch, metric, value): of an epoch that was run again the last attempt
    that has it, whole."""
    last = attempts.groupBy("run_id", "epoch").agg(F.max("attempt").alias("attempt"))
    return attempts.join(last, ["run_id", "epoch", "attempt"], "left_semi").select("run_id", "epoch", "metric", "value")


def merge_logs(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """held(run_id, seq, line) with the incoming lines above its last number."""
    last = held.groupBy("run_id").agg(F.max("seq").alias("__last"))
    more = incoming.join(last, "run_id", "left").where(F.col("seq") > F.coalesce("__last", F.lit(-1))).select(*held.columns)
    return held.unionByName(more)


def merge_metrics(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """held(run_id, epoch, value) with the incoming epochs that it lacks: what is shown first stays."""
    return held.unionByName(incoming.join(held, ["run_id", "epoch"], "left_anti").select(*held.columns))


def flush_logs(lines: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines from each run's cursor on, the cursors after them) of lines(run_id, seq, line) and cursors(run_id, next)."""
    rows = lines.join(cursors, "run_id", "left").where(F.col("seq") >= F.coalesce("next", F.lit(0))).select(*lines.columns)
    ends = rows.groupBy("run_id").agg((F.max("seq") + 1).alias("end"))
    after = cursors.join(ends, "run_id", "full").select("run_id", F.coalesce("end", "next").alias("next"))
    return rows, after


def finalize(jobs: DataFrame, metrics: DataFrame, kind: str = "train") -> DataFrame:
    """jobs(run_id, stopped, code, ok) that have ended, with their status and the state of their series at that point."""
    from visionloom.operators.jobs import end_status

    series = metrics.groupBy("run_id").agg(F.count_distinct("epoch").alias("epochs"), F.max("epoch").alias("last_epoch"))
    status = end_status(kind, F.col("stopped"), F.col("code"), F.col("ok"))
    return jobs.join(series, "run_id", "left").select("run_id", status.alias("status"), F.coalesce("epochs", F.lit(0)).alias("epochs"), "last_epoch")


def describe_artifacts(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, is_dir, size, sha256) of artifacts(path) over files(path, size, sha256): a folder's size is the sum below it
    and it has no digest; a path that is not there has size 0 and no digest."""
    own = artifacts.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.select(F.explode(above).alias("path"), "size", F.col("path").alias("file")).where("path <> file").join(own, "path", "left_semi").groupBy("path").agg(F.sum("size").alias("total"))
    rows = own.join(files, "path", "left").join(folders, "path", "left")
    is_dir = F.col("total").isNotNull()
    return rows.select("path", is_dir.alias("is_dir"), F.coalesce("total", "size", F.lit(0)).cast("bigint").alias("size"), F.when(is_dir, "").otherwise(F.coalesce("sha256", F.lit(""))).alias("sha256"))


def split_artifacts(manifest: DataFrame) -> DataFrame:
    """(deploy_id, succeeded, failed): how many artifacts of manifest(deploy_id, ok) are there and how many failed."""
    return manifest.groupBy("deploy_id").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))


def class_hit(hit: Column, names: Column) -> Column:
    """A classification hit (class_index, class_name, confidence) with a name: its own, else by index, else class_<index>;
    null without an index."""
    i = hit["class_index"]
    name = F.coalesce(F.nullif(hit["class_name"], F.lit("")), F.when(i >= 0, F.get(names, i)), F.concat(F.lit("class_"), i.cast("string")))
    return F.when(i.isNotNull(), F.struct(i.alias("class_index"), name.alias("class_name"), hit["confidence"].alias("confidence")))


def resolve_names(own: Column, told: Column) -> Column:
    """Names by index: those told, by place, over the model's own, also beyond its number of classes."""
    over = F.map_from_entries(F.transform(told, lambda n, i: F.struct(i.alias("key"), n.alias("value"))))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(over, k)), over)
