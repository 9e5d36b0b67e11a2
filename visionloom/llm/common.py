"""Helpers shared by the training-data operators: tables, shared storage, Arrow column appending, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_shared: dict[str, tempfile.TemporaryDirectory] = {}
#: Bytes of input columns that one call of a column function gets, a longer text alone.
SLICE_BYTES = 2_000_000
#: Rows of an Arrow batch of whole texts where the session keeps Spark's 10 000: those make buffers of tens of MB a task.
BATCH_ROWS, BATCH_SETTING = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir. Where that is unset, a temporary one if the master is one local
    machine; on a cluster each executor would write to its own disk, so there it is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        told = "file://" + _own_shared.setdefault(app, tempfile.TemporaryDirectory(prefix="llm-shared-")).name
    return f"{told.rstrip('/')}/llm-{app}"


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and where: cuts lineage, survives lost executors, gives true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is materialised inside is removed at the end, but for tables written by the function that this gives."""
    _scopes.append([])

    def outlive(df: DataFrame, tag: str) -> DataFrame:
        out, path = written(df, tag)
        _scopes[-1].remove(path)
        if len(_scopes) > 1:
            _scopes[-2].append(path)
        return out

    try:
        yield outlive
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Remove what the operators of this application left in the shared folder. Call after the last result is written."""
    remove(spark, shared_dir(spark))


def unused(names: list[str], stem: str) -> str:
    """A column name that none of names has."""
    taken, name = {n.lower() for n in names}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about SLICE_BYTES in the columns."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, sum(batch.column(i).nbytes for i in columns), 1))
    at = 0
    while at < batch.num_rows:
        n = min(step, batch.num_rows - at)
        while n > 1 and sum(batch.column(i).slice(at, n).nbytes for i in columns) > 2 * SLICE_BYTES:
            n //= 2
        yield batch.slice(at, n)
        at += n


def give_back() -> None:
    """At a task's end a worker, which stays for later tasks, returns free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows, unless it has set a number itself."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    fn: Callable[..., dict[str, list | pa.Array]],
    inputs: list[str],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """df with the columns that fn computes from parts of Arrow batches, streamed; no shuffle.

    fn(*lists of the input columns[, state]) returns a list per new field. setup() runs once per task and its value is
    fn's last argument. Existing columns with a new column's name are replaced, whatever their case.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    hidden = []
    for _ in inputs:
        hidden.append(unused([*df.columns, *hidden], "in"))
    src = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(h) for c, h in zip(inputs, hidden)])
    schema = T.StructType([f for f in df.schema.fields if f.name in set(kept)] + fields)
    names, n_kept, n_in = [f.name for f in fields], len(kept), len(hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        state = setup() if setup else None
        try:
            for whole in batches:
                for b in slices(whole, list(range(n_kept, n_kept + n_in))):
                    cols = [b.column(n_kept + i).to_pylist() for i in range(n_in)]
                    out = fn(*cols, state) if setup else fn(*cols)
                    arrays = [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], k) for n, k in zip(names, kinds)]
                    yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_kept)] + arrays, names=kept + names)
        finally:
            state = None
            give_back()

    return src.mapInArrow(run, schema)


def keys_bitmap(keys: DataFrame, key: str, most_bits: int = 1 << 26) -> np.ndarray | None:
    """A bit for each remainder of a distinct bigint key, 16 bits or more a key, so about one in 16 other keys has its bit
    set too; None where that takes over most_bits (8 MB). It thins a table before a join, which stays exact without it."""
    n = keys.count()
    bits = 1 << max(10, (16 * n - 1).bit_length())
    if bits > most_bits:
        return None
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    rows = keys.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(31)).cast("int"))).alias("b")).toArrow()
    words = np.zeros(bits // 32, np.uint32)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return words


def only_keys(df: DataFrame, key: str, words: np.ndarray | None) -> DataFrame:
    """Rows of df whose key has its bit in the words of keys_bitmap; all of them without words. No shuffle."""
    if words is None:
        return df
    small_batches(df.sparkSession)
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(at).to_numpy() & (32 * len(words) - 1)
            yield b.filter(pa.array((words[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)))
        give_back()

    return df.mapInArrow(run, df.schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that the contracts name. Null ids are of fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """A row of each of the `limit` keys with the smallest hashes, so any input size trains on as much; nulls are no keys.

    Of a key's rows the one with the smallest hash stays, so repeated keys and the order of rows change nothing. A count of
    distinct keys gives a bound on the hash that lets about 1.3 limit keys through, and only those are sorted.
    """
    known = rows.where(F.col(key).isNotNull())
    n = known.agg(F.approx_count_distinct(key)).first()[0]
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))
    bound = min((1 << 62) - 1, int((1.3 * limit + 100) / max(1, n) * (1 << 62)))
    near = known.where(place <= bound)
    keys = near.select(key).distinct().orderBy(place, key).limit(limit)
    one = near.join(F.broadcast(keys), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.xxhash64(*rows.columns)).alias("r"))
    return one.select(key, "r.*").select(*rows.columns)
