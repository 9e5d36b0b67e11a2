"""Versioned snapshots of datasets: data are written aside, and a version is there from the moment its manifest gets its name."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visionloom.operators.records import load_snapshot, save_snapshot
from visionloom.sources.listing import qualified

_MANIFEST = "version long, id string, created_at string, note string, parent long, images long, annotations long, digest string"
_FILES = "rel string, size long, sha256 string"


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions, in order: file names of one folder."""
    fs, at = _fs(spark, f"{root}/_versions")
    found = fs.listStatus(at) if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in found) if n[:-5].isdigit() and n.endswith(".json"))


def _put(spark: SparkSession, root: str, version: int, text: str) -> bool:
    """Gives the manifest its name in one step; False where another writer has that version already."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, draft = _fs(spark, f"{root}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails where the name is taken
    try:
        files.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{version:08d}.json"), plain)
        return True
    except Exception as e:  # noqa: BLE001  of the JVM; only one of its kinds is expected
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def _file_list(spark: SparkSession, folder: str) -> DataFrame:
    """(rel, size, sha256) of the data files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return raw.select(F.regexp_extract("path", r"/((?:images|annotations)/[^/]+)$", 1).alias("rel"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def commit(images: DataFrame, annotations: DataFrame, root: str, note: str = "") -> int:
    """Writes both tables as a new version of the snapshots below root and gives its number.

    Data and the list of their files with digests are written to a folder of their own, then a manifest with the digest of
    that list is renamed into place. Until that one step readers see the version before; a write that dies leaves a folder
    that no manifest names (see expire). Two writers get two numbers."""
    spark = images.sparkSession
    root = qualified(spark, root)
    own = uuid.uuid4().hex
    folder = f"{root}/data/{own}"
    save_snapshot(images, annotations, folder, "parquet")
    _file_list(spark, folder).write.json(f"{folder}/_files")
    held = spark.read.schema(_FILES).json(f"{folder}/_files")
    digest = held.agg(F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "rel", "size", "sha256"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")).first()[0] or "0"
    tables = load_snapshot(spark, folder, "parquet")
    doc = {"id": own, "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "note": note, "images": tables[0].count(), "annotations": tables[1].count(), "digest": digest}
    while True:
        last = (_names(spark, root) or [0])[-1]
        if _put(spark, root, last + 1, json.dumps({"version": last + 1, "parent": last or None, **doc}, ensure_ascii=False)):
            return last + 1


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, id, created_at, note, parent, images, annotations, digest) of every version, none where there is no snapshot."""
    root = qualified(spark, root)
    paths = [f"{root}/_versions/{v:08d}.json" for v in _names(spark, root)]
    return spark.read.schema(_MANIFEST).json(paths) if paths else spark.createDataFrame([], _MANIFEST)


def _manifest(spark: SparkSession, root: str, version: int | None) -> dict:
    known = _names(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version if version is not None else ''} below {root}".replace("  ", " "))
    return spark.read.schema(_MANIFEST).json(f"{root}/_versions/{known[-1] if version is None else version:08d}.json").first().asDict()


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of a version, the newest by default."""
    root = qualified(spark, root)
    return load_snapshot(spark, f"{root}/data/{_manifest(spark, root, version)['id']}", "parquet")


def verify(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(rel, problem) of a version's files that are missing, or whose size or content differs from what was committed."""
    root = qualified(spark, root)
    folder = f"{root}/data/{_manifest(spark, root, version)['id']}"
    there = _file_list(spark, folder).toDF("rel", "s", "h")
    rows = spark.read.schema(_FILES).json(f"{folder}/_files").join(there, "rel", "left")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("s") != F.col("size"), "size").when(F.col("h") != F.col("sha256"), "content")
    return rows.select("rel", problem.alias("problem")).where("problem is not null")


def changes(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """(uid, change) of images that are added, removed or changed (any column, or any of their annotations) between versions."""
    one = []
    for v in (old, new):
        im, an = read(spark, root, v)
        boxes = an.groupBy("image_uid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*an.columns).cast("decimal(38,0)")).alias("s"))
        rows = im.join(boxes, F.expr("uid = image_uid"), "left").select("uid", F.xxhash64(*im.columns, F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))).alias(f"h{len(one)}"))
        one.append(rows)
    both = one[0].join(one[1], "uid", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select("uid", change.alias("change")).where("change is not null")


def expire(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Removes all but the newest `keep` versions, then the data that no manifest names, those of broken writes too. Not to be
    run beside a writer. Gives the ids of the data that went."""
    root = qualified(spark, root)
    for v in _names(spark, root)[:-keep] if keep > 0 else []:
        fs, at = _fs(spark, f"{root}/_versions/{v:08d}.json")
        fs.delete(at, False)
    named = {r["id"] for r in versions(spark, root).select("id").collect()}  # one a version
    fs, at = _fs(spark, f"{root}/data")
    gone = [n for n in (f.getPath().getName() for f in (fs.listStatus(at) if fs.exists(at) else [])) if n not in named]
    for n in gone:
        fs.delete(_fs(spark, f"{root}/data/{n}")[1], True)
    return gone
