"""Files below a root, empty ones too, listed folder by folder in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, rel string, size long"
#: Folders are split into their subfolders until there are so many, and not beyond the most.
ENOUGH, MOST, LEVELS = 64, 10_000, 4


def qualified(spark: SparkSession, root: str) -> str:
    """The root with the scheme and host that the session's settings give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def as_listed(uri: str | Column) -> Column:
    """The path in list_files of what file scans give as an encoded address."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def store_of(uri: str):
    """(file system, path in it, prefix of paths as file scans write them) of a qualified root."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/").rstrip("/"), "file:"
    held, at = fs.FileSystem.from_uri(uri.rstrip("/"))
    return held, at, uri.rstrip("/")[: len(uri.rstrip("/")) - len(at)]


def _children(rows: DataFrame, root: str) -> DataFrame:
    """(path, rel, size) in the folders of rows(dir, deep): all files below, or of those that are not deep the folders only
    (size -1) or the files, as rows say."""
    n_root = len(store_of(root)[1].rstrip("/")) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held, _, prefix = store_of(root)
        for b in batches:
            for folder, what in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = held.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=what == "all"))
                kind = fs.FileType.Directory if what == "folders" else fs.FileType.File
                found = [f for f in found if f.type == kind and not f.base_name.startswith((".", "_"))]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    paths = [f.path for f in part]
                    yield pa.RecordBatch.from_arrays([pa.array([prefix + p for p in paths], pa.string()), pa.array([p[n_root:] for p in paths], pa.string()), pa.array([f.size or 0 if kind == fs.FileType.File else -1 for f in part], pa.int64())], names=["path", "rel", "size"])

    return rows.mapInArrow(run, _SCHEMA)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size) of every file below root, empty ones included; contents are not read, names that start with a dot
    or an underscore are left out.

    The first levels are split until there are ENOUGH folders (their names reach the driver, MOST at most); then each is
    listed whole by a task. Where the workers' file systems don't know the scheme, a file scan lists instead: it leaves
    empty files out."""
    root = qualified(spark, root)
    try:
        _, top, _ = store_of(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
        base = "/" + root.split("://")[-1].strip("/") + "/"
        return raw.select("path", F.expr(f"substring(path, locate({base!r}, path) + {len(base)})").alias("rel"), "size")
    folders = lambda rows: spark.createDataFrame(rows, "dir string, what string").repartition(min(len(rows), 1000))
    shallow, dirs = [], [top]
    for _ in range(LEVELS):
        if len(dirs) >= ENOUGH:
            break
        below = [r["rel"] for r in _children(folders([(d, "folders") for d in dirs]), root).select("rel").limit(MOST + 1).collect()]
        if not below or len(below) > MOST:
            break
        shallow, dirs = shallow + dirs, [f"{top.rstrip('/')}/{r}" for r in below]
    return _children(folders([(d, "files") for d in shallow] + [(d, "all") for d in dirs]), root)
