"""Near copies of similarity 0.8 or more by five-word shingles: SimHash candidates, verified, and an exact prefix join for
the rest, since pairs at that similarity differ in about ten of 64 bits, too many for blocks alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_sample, give_back, keys_bitmap, materialise, only_keys, scratch, slices, small_batches, unused, utf8
from .simhash import _LOWER, _SLICE, block_keys, components, majority, pivot_links, with_links

#: Shingles that go last in the order are looked for in so many documents and are those of so many of them; at most
#: MOST_COMMON are sent to the tasks. Any choice gives the same pairs, a poor one only more candidates.
SAMPLE, COMMON, MOST_COMMON = 4000, 4, 100_000
#: Columns of 64 bits that tell for each value of the low bits whether a set has an odd number of members with it.
ODD = [f"odd{i}" for i in range(8)]
_FIELDS = [T.StructField("n", T.IntegerType()), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType()), *[T.StructField(c, T.LongType()) for c in ODD]]
_HELD = 2_000_000  # shingles in the sets that a task keeps while it compares texts


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words that of none."""
    words = utf8(text).translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle])) for i in range(n)), np.uint64, n).view(np.int64))


def least_shared(n: int) -> int:
    """The least number of members that a set of n shares with one of similarity 0.8."""
    return (4 * n + 4) // 5


def with_prefix(docs: DataFrame, text: str = "text", shingle: int = 5, last: np.ndarray | None = None) -> DataFrame:
    """docs with n, the size of the shingle set, first, its first n - least_shared(n) + 1 members by the order in which
    those of the sorted array `last` come at the end, fp, the SimHash fingerprint of the set, and ODD. Null and empty texts
    have the one shingle of no words. No shuffle."""

    def fn(texts: list) -> dict:
        sizes, sets, prints, odd = [], [], [], []
        for t in texts:
            h = shingle_set(t, shingle)
            v = majority(h[at : at + _SLICE].astype(">i8") for at in range(0, len(h), _SLICE))
            prints.append(v - (v >> 63 << 64))
            keep = len(h) - least_shared(len(h)) + 1
            sizes.append(len(h))
            odd.append(np.packbits(np.bincount(h & (64 * len(ODD) - 1), minlength=64 * len(ODD)) % 2 == 1))
            if last is not None and len(last):
                common = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                rare = h[~common]
                h = rare if len(rare) >= keep else np.concatenate([rare, h[common]])
            sets.append(h[:keep].copy())
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        words = np.array(odd, np.uint8).reshape(-1, 8 * len(ODD)).view(np.int64)
        return {"n": sizes, "fp": prints, **{c: words[:, i].copy() for i, c in enumerate(ODD)}, "first": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))}

    return append_columns(docs, _FIELDS, fn, [text])


def common_shingles(docs: DataFrame, shingle: int = 5) -> np.ndarray:
    """Sorted shingles that are frequent in a bounded sample of docs(doc_id, text): ties by value; texts that repeat count once,
    nulls as empty texts, rows without an id not at all; none of an empty table."""
    sets = append_columns(bounded_sample(docs.select("doc_id", "text"), "doc_id", SAMPLE).select("text").distinct(), [T.StructField("sh", T.ArrayType(T.LongType()))], lambda texts: {"sh": [shingle_set(t, shingle) for t in texts]}, ["text"])
    rows = sets.select(F.explode("sh").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in rows.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], np.int64))


def _may_be_similar(an: str, bn: str, shared: str) -> Column:
    """Whether sets of an and bn members that share so many of their first ones can have a similarity of 0.8: past the
    earlier end of the two beginnings they share no more than what is left of that set."""
    left = F.greatest(F.floor((4 * F.col(an) + 4) / 5), F.floor((4 * F.col(bn) + 4) / 5)) - 1
    return (5 * F.least(an, bn) >= 4 * F.greatest(an, bn)) & (9 * (F.col(shared) + left) >= 4 * (F.col(an) + F.col(bn)))


def _odd_enough(x: str, y: str, an: str, bn: str) -> Column:
    """Whether sets of an and bn members can have a similarity of 0.8 by the bits of ODD in which they differ. Each member
    that only one of them has turns one bit, and at 0.8 there are (an + bn) / 9 such members or fewer, so no pair is lost."""
    off = reduce(Column.__add__, [F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in ODD])
    return 9 * off <= F.col(an) + F.col(bn)


def _counted(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, an, b, bn), one per shared shingle, that may be similar."""
    return pairs.groupBy("a", "an", "b", "bn").agg(F.count(F.lit(1)).alias("shared")).where(_may_be_similar("an", "bn", "shared")).select("a", "b")


def held_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the distinct texts of docs(key, text) whose key is in keys(key), written once. Keys are rows of their
    own in a join; while a bitmap of them is small (keys_bitmap), the rest never leaves the task that reads it. Repeated
    rows leave one, nulls are texts as any other, and an empty side gives no rows."""
    keys = materialise(keys.distinct(), "wanted")
    texts = only_keys(docs, "key", keys_bitmap(keys, "key"))
    return materialise(texts.dropDuplicates(["key"]).join(keys, "key", "left_semi"), "texts")


def similar(pairs: DataFrame, held: DataFrame, shingle: int = 5) -> DataFrame:
    """Those pairs (a, b) of keys whose texts in held (key, text, a row a key) have a Jaccard similarity of 0.8 or more, by
    their whole sets. Null and empty texts have the set of the empty shingle. Repeated pairs are told alike; no pairs give
    no rows, and pairs of keys that held lacks are left out."""
    pairs = materialise(pairs, "pairs")
    both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")
    small_batches(both.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0

        def of(key: int, text: str | None) -> np.ndarray:
            nonlocal size
            if size > _HELD:
                known.clear()
                size = 0
            if key not in known:
                known[key] = shingle_set(text, shingle)
                size += len(known[key]) + 16
            return known[key]

        try:
            for whole in batches:
                for batch in slices(whole, [2, 3]):
                    near = []
                    for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                        p, q = of(a, x), of(b, y)
                        near.append(9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)))
                    yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        finally:
            known.clear()
            give_back()

    return both.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(key, id, component) per distinct text of docs (doc_id, text): key is a 64-bit hash of the text, id its smallest
    doc_id, null if it has none.

    Fingerprints at three bits or fewer, and texts of one fingerprint, are candidates. In one order of all shingles, two
    sets of n and m members of similarity 0.8 share one of their first n - least_shared(n) + 1 and m - least_shared(m) + 1,
    so those that share one are candidates too and no pair is missed. Texts that meet are first held against one of them,
    which joins a large group in linear time; then only texts that are still apart are paired, and of these only such as can
    be similar by their odd bits, which leaves few of a crowd whose texts are a little less similar. Every candidate is
    verified by the whole sets.
    """
    with scratch(docs.sparkSession) as outlive:
        texts = docs.select(text_key().alias("key"), "text")
        prints = with_prefix(docs.select("doc_id", "text", text_key().alias("key")), shingle=shingle, last=common_shingles(docs, shingle))
        nodes = materialise(prints.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("first").alias("first"), *[F.first(c).alias(c) for c in ODD]), "nodes")
        keyed = nodes.select("key", "n", F.explode("first").alias("h"))
        shared = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
        met = materialise(keyed.join(shared, "h", "left_semi"), "met")
        pivot = met.groupBy("h").agg(F.min(F.struct("key", "n")).alias("p"))
        pairs = met.join(pivot, "h").select(F.col("p.key").alias("a"), F.col("p.n").alias("an"), F.col("key").alias("b"), F.col("n").alias("bn"))
        first = _counted(pairs.where("a < b")).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")  # one pivot a text
        links = materialise(_simhash_pairs(nodes).unionByName(first).distinct(), "links")
        held = held_texts(texts, met.select("key").unionByName(links.select(F.explode(F.array("a", "b")).alias("key"))))
        near = materialise(similar(links, held, shingle), "near")
        found = components(near).withColumnRenamed("node", "key")
        part = met.join(found, "key", "left").select("h", "key", "n", F.coalesce("component", "key").alias("c"))
        split = part.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
        part = materialise(part.join(split, "h", "left_semi").join(nodes.select("key", *ODD), "key").select("h", "key", "n", "c", *ODD), "part")
        a, b = part.toDF("h", "a", "an", "ac", *[f"x{c}" for c in ODD]), part.toDF("h", "b", "bn", "bc", *[f"y{c}" for c in ODD])
        apart = a.join(b, "h").where("a < b and ac <> bc and 5 * least(an, bn) >= 4 * greatest(an, bn)").where(_odd_enough("x", "y", "an", "bn")).select("a", "an", "b", "bn")
        more = materialise(similar(_counted(apart), held, shingle), "more")
        if not more.isEmpty():
            found = with_links(found.withColumnRenamed("key", "node"), more).withColumnRenamed("node", "key")
        return outlive(nodes.select("key", "id").join(found, "key", "left").select("key", "id", F.coalesce("component", "key").alias("component")), "groups")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: of each text at most one, with the first text of its fingerprint or, for that one, with the first text
    of the nearest pivot of its fingerprint. Only what makes large groups meet early: the prefixes find the rest."""
    first = materialise(nodes.groupBy("fp").agg(F.min("key").alias("key")), "first")
    same = nodes.select("fp", F.col("key").alias("b")).join(first, "fp").where("key < b").select(F.col("key").alias("a"), "b")
    links = pivot_links(block_keys(first.select(F.col("fp").alias("f"))))
    links = links.groupBy("b").agg(F.min(F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("off"), "a")).alias("p")).select("p.a", "b")
    x, y = first.select(F.col("fp").alias("a"), F.col("key").alias("x")), first.select(F.col("fp").alias("b"), F.col("key").alias("y"))
    return same.unionByName(links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def text_key(text: str = "text") -> Column:
    """64 bits that stand for a text, a null one as an empty one. Two texts of one key would count as one: about three such
    pairs are to be expected at 10^10 texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def first_of_near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near copies (five-word Jaccard 0.8 or more, over any chain): of each group one row stays, one with the
    smallest doc_id of the group, or one without an id if no row has one.

    Rows that repeat id and text leave one, those that repeat an id with other texts are told apart. Null and empty texts
    are copies of each other. Other columns stay as the row has them; an empty table stays empty. Repeated rows, where there
    are any, shrink before their texts are shuffled.
    """
    found = groups(docs, shingle)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "key")).alias("r"))
    key, bare, no = unused(docs.columns, "key"), unused(docs.columns, "bare"), unused(docs.columns, "id")
    best = best.select(F.col("r.key").alias(key), F.coalesce("r.id", F.lit(0)).alias(no), F.col("r.bare").alias(bare))
    rows = docs.withColumns({key: text_key(), no: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), bare: F.col("doc_id").isNull()})
    at = [key, no, bare]
    many = materialise(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*at), "repeated")
    kept = rows.join(best.join(many, at, "left_anti"), at, "left_semi")
    if not many.isEmpty():  # rows that repeat id and text
        kept = kept.unionByName(rows.dropDuplicates(at).join(best.join(many, at, "left_semi"), at, "left_semi"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
