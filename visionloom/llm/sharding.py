"""Sharding by jump consistent hashing (Lamping and Veach), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The published generator and the 2^31 of the published step.
MULTIPLIER, STEP = 2862933555777941757, float(1 << 31)
_U64 = "18446744073709551616BD"


def jump_bucket(key: Column, shards: int) -> Column:
    """Bucket in [0, shards) of a 64-bit key (null: as 0). Growing to shards + 1 moves keys into the new bucket only.

    The loop is a fold of `shards` steps at most (a step always raises the bucket); Decimal(38) holds the 64-bit product
    exactly, which wraps without Spark's ANSI overflow error.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    key = F.when(key < 0, key + F.expr(_U64)).otherwise(key).cast("decimal(20,0)")
    start = F.struct(key.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.expr(_U64)).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(20,0)")).cast("double") + F.lit(1.0)
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(STEP) / high)).cast("bigint")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j")))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return last["b"].cast("int")


def jump_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """df with the jump bucket of a bigint key; a column named `out` is replaced. No shuffle."""
    return df.withColumn(out, jump_bucket(F.col(key), shards))


def number_slots(df: DataFrame, shard: str, key: str, tie: list[str], out: str = "slot") -> DataFrame:
    """df with a number per row, gapless from 0 in its shard, ordered by a digest of the key and `tie`, then these.

    A shard at scale exceeds a task, so rows are numbered inside 4096 digest buckets per shard, and the buckets' counts
    (at most 4096 a shard) give each bucket's start. Since `tie` is in the digest, the rows of one key, or without a key,
    spread over the buckets as far as they differ. Repeated rows get distinct slots.
    """
    bucket = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), *[F.col(c).cast("string") for c in tie]).cast("binary")), 1, 3)
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy(shard, "__b").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__b", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(shard, "__b").orderBy(F.col(key), *[F.col(c) for c in tie])
    numbered = rows.withColumn("__r", F.row_number().over(inner) - F.lit(1))
    joined = numbered.join(starts, [shard, "__b"])
    return joined.withColumn(out, (F.col("__start") + F.col("__r")).cast("bigint")).drop("__b", "__r", "__start")


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Layout of documents over shards by law `key`: one row per document, without its text.

    Null text: size 8 and checksum 0. Null id: the shard of key 0. Repeated ids share a shard and get distinct slots.
    Other columns of docs are ignored. An empty table gives an empty layout.
    """
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(data) + 8).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_bucket(F.col(doc_id), shards).alias("shard"),
        jump_bucket(F.col(doc_id), shards + 1).alias("grown_shard"),
    )
    done = number_slots(rows, "shard", "doc_id", ["size", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
