"""Whole datasets: which format a folder holds, and its images and annotations in the relational model."""

from __future__ import annotations

import logging
import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visionloom.functions.scalar import SPLIT_ALIASES, make_uid, normalize_split, yolo_to_xyxy
from visionloom.operators.merge import merge
from visionloom.plans.ir import ANNOTATIONS, IMAGES
from visionloom.sources import formats, images as pictures
from visionloom.sources.listing import as_listed, exists, list_files, qualified

FORMATS = ["openlabel", "coco", "voc", "labelme", "yolo"]  # in the order they are tried
MOST_YAMLS = 200
_SPLIT_NAME = "|".join(sorted(SPLIT_ALIASES, key=len, reverse=True))


@dataclass
class Dataset:
    images: DataFrame
    annotations: DataFrame
    classes: list[str] | None = None
    orphan_labels: DataFrame | None = None
    skipped: DataFrame | None = None
    warnings: DataFrame | None = None
    sources: list[dict] | None = None


def _local(path: str | Column) -> Column:
    """A path with local files written one way."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _extension(rel: str = "rel") -> Column:
    return F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1))


def _without_extension(rel: Column) -> Column:
    return F.regexp_replace(rel, r"\.[^./]+$", "")


def _globs(files: DataFrame, ext: str) -> list[str]:
    """A pattern for every folder that holds files of the extension: folders, not files, reach the driver."""
    rows = files.where(_extension() == ext).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("dir")).distinct().orderBy("dir").collect()
    return [f"{r['dir']}/*.{ext}" for r in rows]


def split_from_text(s: Column) -> Column:
    """The first split name anywhere in a text, also within a word."""
    return normalize_split(F.regexp_extract(F.lower(s), "(train|validation|valid|val|test)", 1))


def group_from(rel: Column, by: str | None) -> Column:
    """Group of an image by its place below its images folder: none, parent, stem (without last digits), regex:<pattern>
    (its first group, else the match; null where it can't match)."""
    stem = F.regexp_extract(rel, formats.STEM, 1)
    if not by or by == "none":
        return F.lit(None).cast("string")
    if by == "parent":
        return F.nullif(F.regexp_replace(F.regexp_extract(rel, "^(.*)/[^/]+$", 1), rf"^((?:images/)?(?:{_SPLIT_NAME})(?:/images)?|images)(/|$)", ""), F.lit(""))
    if by == "stem":
        return F.regexp_replace(stem, r"\d+$", "")
    if by.startswith("regex:"):
        import re

        try:
            some = re.compile(by[6:]).groups > 0
        except re.error:
            return F.lit(None).cast("string")
        return F.when(stem.rlike(by[6:]), F.regexp_extract(stem, by[6:], 1 if some else 0))
    raise ValueError(f"unknown grouping {by}")


def formats_of(spark: SparkSession, root: str) -> list[str]:
    """The formats whose files are there: by the keys of JSON files, XML files, or label texts beside images."""
    files = list_files(spark, root)
    ext, deep = _extension(), F.size(F.split("rel", "/")) - 1
    seen = files.agg(F.bool_or(ext == "json").alias("json"), F.bool_or(ext == "xml").alias("xml"), F.bool_or(ext == "txt").alias("txt"), F.bool_or(ext.isin("yaml", "yml") & (deep == 0)).alias("yaml"), F.bool_or(ext.isin(formats.IMAGE_SUFFIXES)).alias("image")).first()
    if seen["json"]:
        docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
        has = lambda *keys: F.bool_or(reduce(Column.__and__, [F.get_json_object("value", f"$.{k}").isNotNull() for k in keys]))
        keys = docs.agg(has("openlabel").alias("openlabel"), has("images", "annotations", "categories").alias("coco"), has("shapes").alias("labelme")).first()
    told = {"voc": seen["xml"], "yolo": (seen["yaml"] or seen["txt"]) and seen["image"], **(keys.asDict() if seen["json"] else {})}
    return [name for name in FORMATS if told.get(name)]


def read_yaml(spark: SparkSession, files: DataFrame) -> dict:
    """The dataset's yaml: data, dataset, else the first by name that has names; {} where there is none. All candidates
    at the top of the folder, MOST_YAMLS at most, are read in one job."""
    import yaml

    known = ["data.yaml", "dataset.yaml", "data.yml", "dataset.yml"]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), F.col("rel")), F.lit(0)), F.lit(len(known) + 1))
    rows = files.where(_extension().isin("yaml", "yml") & ~F.col("rel").contains("/") & (F.col("size") > 0)).select("path", "rel").orderBy(rank, "rel").limit(MOST_YAMLS).collect()
    if not rows:
        return {}
    texts = {r["path"]: r["value"] for r in spark.read.text([r["path"] for r in rows], wholetext=True).select(as_listed(F.input_file_name()).alias("path"), "value").collect()}
    for r in rows:
        try:
            doc = yaml.safe_load(texts.get(r["path"]) or "") or {}
        except yaml.YAMLError:
            continue
        if isinstance(doc, dict) and (doc.get("names") or r["rel"] in known):
            return doc
    return {}


def class_names(doc: dict) -> dict[int, str]:
    """Class number to name of a list or a map; keys that are no numbers are left out."""
    names = doc.get("names") or {}
    pairs = enumerate(names) if isinstance(names, list) else names.items()
    return {int(k): str(v).strip() for k, v in sorted((p for p in pairs if str(p[0]).lstrip("-").isdigit()), key=lambda p: int(p[0]))}


def _model(rows: DataFrame, source_id: str) -> DataFrame:
    """rows with the columns of images, those it lacks as nulls; ord is a hash-free order by path."""
    have = {"source_id": F.lit(source_id), "sha1": F.lit(None).cast("string"), "ord": F.xxhash64("rel_path")}
    return rows.select(*[F.col(c) if c in rows.columns else have.get(c, F.lit(None).cast("string")).alias(c) for c in IMAGES])


def _boxes(rows: DataFrame) -> DataFrame:
    have = {"kind": F.lit("bbox"), "score": F.lit(None).cast("double")}
    return rows.select(*[F.col(c) if c in rows.columns else have.get(c, F.lit(None).cast("double")).alias(c) for c in ANNOTATIONS])


def _image_files(files: DataFrame, root: str, source_id: str) -> DataFrame:
    found = files.where(_extension().isin(formats.IMAGE_SUFFIXES))
    sizes = pictures.probe(found).select("path", "width", "height")
    return found.join(sizes, "path").select(make_uid(F.lit(source_id), F.lit(root), F.col("rel")).alias("uid"), F.col("rel").alias("rel_path"), "path", "width", "height")


def _pool(ims: DataFrame, told: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(which images count, their split): those of the folders that the yaml names, if any holds images; else of
    <split>/images and images/<split>; else all below images, or at the top. Of a folder named twice the first counts."""
    rel = F.col("rel_path")
    by_name = F.regexp_extract(F.lower(rel), rf"^(?:images/)?({_SPLIT_NAME})/", 1)
    nested = rel.rlike(rf"(?i)^(?:({_SPLIT_NAME})/images/|images/({_SPLIT_NAME})/)")
    flat = rel.startswith("images/")
    seen = ims.agg(F.bool_or(nested).alias("nested"), F.bool_or(flat).alias("flat"), *[F.bool_or(rel.startswith(p)).alias(f"told{i}") for i, (p, _) in enumerate(told)]).first()
    told = [t for i, t in enumerate(told) if seen[f"told{i}"]]
    if told:
        return reduce(Column.__or__, [rel.startswith(p) for p, _ in told]), F.coalesce(*[F.when(rel.startswith(p), normalize_split(F.lit(k))) for p, k in told])
    if seen["nested"]:
        return nested, normalize_split(by_name)
    return (flat if seen["flat"] else ~rel.contains("/")), F.lit(None).cast("string")


def _named_folders(root: str, doc: dict) -> list[tuple[str, str, str | None]]:
    """(prefix of rel_path, split, folder if it lies outside) of the folders that the yaml names: relative ones from the
    root, with . and .. resolved, absolute ones as they are. A folder named twice comes twice."""
    scheme, top = re.match(r"^([a-z0-9]+:(?://[^/]*)?)?(/.*)$", root).groups()
    out = []
    for k in ("train", "val", "valid", "test"):
        for v in doc[k].split(",") if isinstance(doc.get(k), str) else []:
            if v.strip():
                rel = posixpath.relpath(posixpath.join(top, re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", v.strip())), top)
                outside = rel == ".." or rel.startswith("../")
                out.append(("" if rel == "." else rel + "/", k, (scheme or "") + posixpath.normpath(posixpath.join(top, rel)) if outside else None))
    return out


def _labels_of(folder: str) -> str:
    """The folder of labels that mirrors one of images."""
    return re.sub(r"(^|/)images(/?)((?:(?!(?:^|/)images(?:/|$)).)*)$", r"\1labels\2\3", folder)


def load_yolo(spark: SparkSession, root: str, source_id: str = "src", group_by: str | None = None) -> Dataset:
    """Splits come from the yaml's folders, inside the root or not (then rel_path starts with ..), else from <split>/images or images/<split>, else there are none; a label file
    is looked for in the labels folder that mirrors the images folder, then beside the image. Lines of unknown classes are
    left out."""
    files = list_files(spark, root)
    doc = read_yaml(spark, files)
    names = class_names(doc)
    named, read_below = _named_folders(qualified(spark, root), doc), [root]
    told = [(prefix, split) for prefix, split, _ in named]
    for prefix, folder in dict.fromkeys(x for own, _, outside in named if outside for x in ((own, outside), (_labels_of(own), _labels_of(outside)))):
        files = files.unionByName(list_files(spark, folder).withColumn("rel", F.concat(F.lit(prefix), "rel")))
        read_below += [folder] if exists(spark, folder) else []
    ims = _image_files(files, root, source_id)
    which, split = _pool(ims, told)
    ims = ims.where(which).withColumn("split", split).withColumn("grp", group_from(F.col("rel_path"), group_by))
    own = _without_extension(F.col("rel_path"))
    mirror = F.regexp_replace(own, r"^(.*/)?images/(?!.*\bimages/)", "$1labels/")
    wanted = ims.select("uid", "width", "height", F.posexplode(F.array_distinct(F.array(mirror, own))).alias("rank", "key"))
    texts = files.where(_extension() == "txt").select("path", _without_extension(F.col("rel")).alias("key"), F.col("rel"))
    chosen = wanted.join(texts, "key").groupBy("uid", "width", "height").agg(F.min_by("path", "rank").alias("path"))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(read_below, wholetext=True)
    lines = raw.select(F.regexp_replace(F.input_file_name(), "^file:/+", "file:/").alias("path"), F.explode(F.split("value", r"\r?\n")).alias("s"))
    p = F.split(F.trim("s"), r"\s+")
    num = [F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("k", "xc", "yc", "w", "h"))]
    rows = lines.where(F.size(p) >= 5).select("path", *num).na.drop()
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.expr("map(-1, '')")
    rows = rows.withColumn("category", F.try_element_at(table, F.col("k").cast("int"))).where("category is not null")
    boxes = rows.join(chosen.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path")
    box = yolo_to_xyxy(*[F.col(c) for c in ("xc", "yc", "w", "h", "width", "height")])
    boxes = boxes.select(F.col("uid").alias("image_uid"), "category", box.alias("b")).select("image_uid", "category", "b.*")
    labels = texts.where(~F.regexp_extract("rel", r"([^/]+)$", 1).isin("classes.txt", "README.txt"))
    orphans = labels.join(wanted.select("key").distinct(), "key", "left_anti").select("rel")
    return Dataset(_model(ims, source_id), _boxes(boxes), list(names.values()), orphans)


def load_coco(spark: SparkSession, root: str, source_id: str = "src") -> Dataset:
    """All three-array JSON files at most one folder down; a file's name tells the split where the image's path doesn't."""
    files = list_files(spark, root).where((_extension() == "json") & (F.size(F.split("rel", "/")) <= 2)).select(_local("path").alias("file"), "rel")
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(root, wholetext=True)
    keys = F.json_object_keys(F.regexp_replace("value", "^\ufeff", ""))
    three = F.size(F.array_intersect(keys, F.array(*map(F.lit, ("images", "annotations", "categories"))))) == 3
    found = docs.where(three).select(as_listed(F.input_file_name()).alias("file")).join(files, "file").select("file", "rel")
    paths = [r["file"] for r in found.orderBy("rel").collect()]
    if not paths:
        raise ValueError(f"no annotation file below {root}")
    im, an = formats.coco_files(spark, paths, source_id)
    im = im.withColumn("file", as_listed(F.col("file"))).join(F.broadcast(found), "file")
    split = F.coalesce(split_from_text(F.col("rel")), split_from_text(F.col("rel_path")))
    first = im.withColumn("split", split).groupBy("uid").agg(F.min_by(F.struct("rel_path", "width", "height", "grp", "split", "rel"), "rel").alias("i")).select("uid", "i.*")
    bare = first.where("coalesce(width, 0) <= 0 or coalesce(height, 0) <= 0").select("uid", F.col("rel").alias("rel_file"), F.col("rel_path").alias("file_name"))
    pictured = list_files(spark, root).where(_extension().isin(formats.IMAGE_SUFFIXES))
    here, name = _folder(F.col("rel_file")), _name(F.col("file_name"))
    at = _resolve(bare, pictured.select(F.col("rel").alias("rel_path"), "path"), [_below(here, F.col("file_name")), F.col("file_name"), _below(F.lit("images"), F.col("file_name")), _below(here, name), _below(F.lit("images"), name)], [])
    sizes = at.join(pictures.probe(at.select("path").distinct()), "path").select("uid", F.col("width").alias("w"), F.col("height").alias("h"))
    done = first.join(sizes, "uid", "left").withColumns({"width": F.coalesce(F.nullif(F.greatest("width", F.lit(0)), F.lit(0)), "w"), "height": F.coalesce(F.nullif(F.greatest("height", F.lit(0)), F.lit(0)), "h")})
    return Dataset(_model(done, source_id), _boxes(an))


def _folder(rel: Column) -> Column:
    return F.regexp_extract(rel, "^(.*)/[^/]+$", 1)


def _name(rel: Column) -> Column:
    return F.regexp_extract(rel, "([^/]+)$", 1)


def _below(folder: Column, rel: Column) -> Column:
    return F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace(rel, r"^(\./)+", ""))


def _resolve(rows: DataFrame, ims: DataFrame, exact: list[Column], any_extension: list[Column]) -> DataFrame:
    """rows(rel_file, file_name, ...) with the columns of ims(rel_path, ...) of the first candidate path that there is:
    the exact ones in turn, then those that are without extension."""
    keys = F.concat(F.array(*exact), F.transform(F.array(*any_extension), lambda p: F.concat(p, F.lit(".*"))) if any_extension else F.array().cast("array<string>"))
    asked = rows.select("rel_file", "file_name").distinct().select("rel_file", "file_name", F.posexplode(keys).alias("__rank", "__key"))
    known = ims.withColumn("__key", F.explode(F.array("rel_path", F.concat(_without_extension(F.col("rel_path")), F.lit(".*")))))
    names = [c for c in ims.columns if c not in rows.columns]
    found = asked.join(known, "__key").groupBy("rel_file", "file_name").agg(F.min_by(F.struct(*names), F.struct("__rank", "rel_path")).alias("__i"))
    return rows.join(found, ["rel_file", "file_name"]).select(*rows.columns, *[F.col(f"__i.{c}") for c in names])


def _rel_of(uri: Column, root: str) -> Column:
    """A read file's path below root."""
    base = "/" + root.split("://")[-1].strip("/") + "/"
    at = as_listed(uri)
    return F.regexp_replace(at, r"^.*?\Q" + base + r"\E", "")


def image_sets(spark: SparkSession, root: str) -> DataFrame:
    """(stem, split) of train.txt, val.txt and test.txt below ImageSets; of repeated names the first file by name counts."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root)
    file = F.input_file_name()
    rows = raw.where(file.contains("/ImageSets/")).select(F.regexp_extract(F.trim("value"), r"^(\S+)", 1).alias("stem"), normalize_split(F.regexp_extract(file, formats.STEM, 1)).alias("split"), file.alias("file"))
    return rows.where("stem <> '' and split is not null").groupBy("stem").agg(F.min_by("split", "file").alias("split"))


def _parent(rel: str = "rel_path") -> Column:
    return F.nullif(F.regexp_extract(rel, "^(?:.*/)?([^/]+)/[^/]+$", 1), F.lit(""))


def load_voc(spark: SparkSession, root: str, source_id: str = "src", one_based: bool = False) -> Dataset:
    files = list_files(spark, root)
    ims = _image_files(files, root, source_id).withColumn("grp", _parent())
    if files.where((_extension() == "txt") & F.concat(F.lit("/"), "rel").contains("/ImageSets/")).limit(1).count():
        ims = ims.withColumn("stem", F.regexp_extract("rel_path", formats.STEM, 1)).join(image_sets(spark, root), "stem", "left")
    rows = formats.voc(spark, _globs(files, "xml"), one_based).where("category is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    rows = rows.withColumn("rel_file", _rel_of(F.col("file"), root))
    here, named = _folder(F.col("rel_file")), F.col("file_name")
    up, name, stem = _folder(here), _name(named), _without_extension(_name(named))
    folders = [F.lit("JPEGImages"), _below(up, F.lit("JPEGImages")), _below(up, F.lit("images")), F.lit("")]
    exact = [_below(x, named) for x in folders[:3]] + [_below(x, name) for x in folders[:3]] + [_below(F.lit(""), named), _below(here, named), _below(here, name)]
    boxes = _resolve(rows, ims.select("uid", "rel_path"), exact, [_below(x, stem) for x in [*folders, here]])
    return Dataset(_model(ims, source_id), _boxes(boxes.withColumn("image_uid", F.col("uid"))))


def load_labelme(spark: SparkSession, root: str, source_id: str = "src") -> Dataset:
    """skipped counts the shapes of unsupported types."""
    files = list_files(spark, root)
    ims = _image_files(files, root, source_id).withColumn("grp", _parent()).withColumn("split", split_from_text(F.col("rel_path")))
    docs = spark.read.schema("shapes array<struct<shape_type:string>>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    skipped = docs.select(F.explode("shapes.shape_type").alias("shape_type")).where("shape_type not in ('rectangle', 'polygon', 'circle')").groupBy("shape_type").agg(F.count(F.lit(1)).alias("n"))
    rows = formats.labelme(spark, _globs(files, "json")).withColumn("rel_file", _rel_of(F.col("file"), root))
    here, named, stem = _folder(F.col("rel_file")), F.col("file_name"), _without_extension(_name(F.col("rel_file")))
    exact = [_below(here, named), _below(here, _name(named)), _below(F.lit(""), named), _name(named)]
    boxes = _resolve(rows, ims.select("uid", "rel_path"), exact, [_below(here, stem), stem, _below(_below(_folder(here), F.lit("images")), stem)])
    return Dataset(_model(ims, source_id), _boxes(boxes.withColumn("image_uid", F.col("uid"))), skipped=skipped)


def frame_index(rel: Column) -> Column:
    """The last run of digits of a file's name."""
    return F.regexp_extract(F.regexp_extract(rel, formats.STEM, 1), r"(\d+)(?!.*\d)", 1).try_cast("bigint")


def load_openlabel(spark: SparkSession, root: str, source_id: str = "src", level: str | None = None, frames_dir: str | None = None, include_objects: bool = False) -> Dataset:
    """Interval labels on the frame images below root, or below its folder frames_dir; the video's name is the group, of
    several files that of the last. Of frames of one number the last by path counts. Frames outside every interval stay
    without labels; warnings names frames beyond what a file declares (file, frame)."""
    files = list_files(spark, root)
    paths = _globs(files, "json")
    spans = formats.openlabel_intervals(spark, paths, level, include_objects).withColumn("all", F.lit(1))
    held = files if frames_dir is None else files.where(F.col("rel").startswith(frames_dir.strip("/") + "/"))
    frames = _image_files(held, root, source_id).withColumn("frame", frame_index(F.col("rel_path"))).where("frame is not null")
    frames = frames.groupBy("frame").agg(F.max_by(F.struct("uid", "rel_path", "width", "height"), "rel_path").alias("f")).select("frame", "f.*").withColumn("all", F.lit(1))
    labels = formats.frame_labels(frames, spans, "all").select(F.col("uid").alias("image_uid"), F.col("label").alias("category"), F.lit("image").alias("kind"))
    videos = formats.openlabel_videos(spark, paths)
    group = videos.agg(F.max_by("video", "file")).first()[0]
    beyond = frames.select("frame").crossJoin(F.broadcast(videos.where("total_frames is not null"))).where("frame >= total_frames").select("file", "frame")  # videos are a few files
    return Dataset(_model(frames.withColumn("grp", F.lit(group)), source_id), _boxes(labels), warnings=beyond)


@dataclass
class Adapter:
    """A format: how a folder of it is told, and how it is read. detect(spark, root); load(spark, root, **options)."""

    name: str
    detect: Callable[[SparkSession, str], bool]
    load: Callable[..., Dataset]


LOADERS = {"openlabel": load_openlabel, "coco": load_coco, "voc": load_voc, "labelme": load_labelme, "yolo": load_yolo}
_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter, before: str | None = None) -> None:
    """Adds a format, tried last, or before another one; one of the same name is replaced."""
    others = [a for a in _ADAPTERS.values() if a.name != adapter.name]
    at = next((i for i, a in enumerate(others) if a.name == before), len(others))
    _ADAPTERS.clear()
    _ADAPTERS.update({a.name: a for a in [*others[:at], adapter, *others[at:]]})


def available_adapters() -> list[str]:
    """Names in the order they are tried."""
    return list(_ADAPTERS)


def get_adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise ValueError(f"unknown format {name}")
    return _ADAPTERS[name]


for _name_of, _load in LOADERS.items():
    register(Adapter(_name_of, lambda spark, root, own=_name_of: own in formats_of(spark, root), _load))


def detect_format(spark: SparkSession, root: str) -> str | None:
    """The first adapter that tells the folder as its own; one that fails doesn't."""
    known = formats_of(spark, root)
    for name, adapter in _ADAPTERS.items():
        try:
            if (name in known) if adapter.load is LOADERS.get(name) else adapter.detect(spark, root):
                return name
        except (ValueError, KeyError, TypeError, AttributeError, OSError) as e:  # the adapter's own fault means no
            logging.getLogger(__name__).warning("detector of %s failed on %s: %r", name, root, e)
    return None


def load_dataset(spark: SparkSession, root: str, fmt: str | None = None, **options) -> Dataset:
    found = fmt or detect_format(spark, root)
    if found not in _ADAPTERS:
        raise ValueError(f"no known format below {root}")
    return _ADAPTERS[found].load(spark, root, **options)


def load_and_merge(spark: SparkSession, specs: list[dict]) -> Dataset:
    """Loads each of root, fmt and options, and merges them from the left. sources describes each as it was loaded; orphan
    labels, skipped shapes and warnings of all are kept."""
    loaded = [load_dataset(spark, **s) for s in specs]
    im, an = reduce(lambda a, b: merge(a, b)[:2], [(d.images, d.annotations) for d in loaded])
    both = lambda name: reduce(lambda a, b: a.unionByName(b), held) if (held := [x for d in loaded if (x := getattr(d, name)) is not None]) else None
    sources = [{"source_id": s.get("source_id", "src"), "root": s["root"], "format": s.get("fmt"), "images": d.images.count(), "annotations": d.annotations.count()} for s, d in zip(specs, loaded)]
    return Dataset(im, an, list(dict.fromkeys(c for d in loaded for c in d.classes or [])) or None, both("orphan_labels"), both("skipped"), both("warnings"), sources)
