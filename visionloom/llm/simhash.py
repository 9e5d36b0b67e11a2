"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visionloom.operators.hamming import HOT, close_pairs, meets_first, near

from .common import append_columns, materialise, scratch, utf8

_LOWER = bytes(range(256)).lower()
_SLICE = 1 << 15  # shingles whose bits are unpacked at once


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the big-endian 64-bit hashes, which come a slice at a time."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of all word shingles, repeats included; 0 where there are no words."""
    words = utf8(text).translate(_LOWER).split()
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(n, at + _SLICE))], ">u8") for at in range(0, n, _SLICE))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """docs with the fingerprint as a signed bigint. Null and empty texts: 0. No shuffle."""

    def fn(texts: list) -> dict:
        known: dict = {}
        return {out: [known[t] if t in known else known.setdefault(t, (v := fingerprint(t, shingle)) - (v >> 63 << 64)) for t in texts]}

    return append_columns(docs, [T.StructField(out, T.LongType())], fn, [text])


def block_spans(blocks: int) -> list[tuple[int, int]]:
    """(offset, width) of the blocks of 64 bits, wider ones first."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(v: int) -> int:
    return v - (v >> 63 << 64)


def block_sets(distance: int, blocks: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Masks of the blocks, and (number, mask) of every set of blocks - distance blocks."""
    if blocks <= distance:
        raise ValueError("more blocks than the distance are needed")
    masks = [((1 << w) - 1) << o for o, w in block_spans(blocks)]
    return masks, [(sum(1 << i for i in c), sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - distance)]


def block_keys(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(f, s, k, pivot): each fingerprint under each set s of blocks that another one shares the bits k of, with the
    smallest of these.

    Of `blocks` blocks at least blocks - distance agree in a pair at `distance` bits or fewer, so it meets under one such
    set (20 keys of about 32 bits by default: few false candidates even at 10^10 fingerprints). Prints are distinct and not
    null; none give no keys.
    """
    _, sets = block_sets(distance, blocks)
    keys = F.array(*[F.struct(F.lit(s).alias("s"), F.col("f").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("k")) for s, m in sets])
    keyed = prints.select("f", F.explode(keys).alias("e")).select("f", "e.s", "e.k")
    met = keyed.groupBy("s", "k").agg(F.min("f").alias("pivot"), F.max("f").alias("top")).where("pivot < top").drop("top")
    return keyed.join(met, ["s", "k"])


def pivot_links(keyed: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the fingerprints near the smallest one that shares a key: a few per fingerprint, however
    many share the key. Repeated rows leave one pair; no keys give none."""
    return keyed.where("f <> pivot").where(near("f", "pivot", distance)).select(F.col("pivot").alias("a"), F.col("f").alias("b")).distinct()


def apart_links(keyed: DataFrame, found: DataFrame, distance: int = 3, blocks: int = 6, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) at `distance` bits or fewer whose components in found (node, component) differ.

    Keys whose fingerprints are all of one component drop out before the join. A pair is put out only by the first set
    on which it agrees. Keys of more than `hot` fingerprints are divided by the bits that vary in them, so fingerprints
    that share a long stretch by their nature are not paired all with all. Repeated rows of keyed would repeat pairs; no
    keys, or none that are apart, give no pairs; fingerprints that found lacks are components of their own.
    """
    masks, _ = block_sets(distance, blocks)
    part = keyed.join(found.withColumnRenamed("node", "f"), "f", "left").select("s", "k", "f", F.coalesce("component", "f").alias("c"))
    split = part.groupBy("s", "k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s", "k")
    part = materialise(part.join(split, ["s", "k"], "left_semi"), "apart")
    return close_pairs(part, distance, 2, F.expr("x_c <> y_c"), meets_first("s", "a", "b", masks), hot)


def linked(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(node, component) of the fingerprints of the column f that have a partner at `distance` bits or fewer, over any chain.

    Those that share a key are first held against one of them, which joins a large group in linear time; then only
    fingerprints that are still apart are paired, so no link is lost.
    """
    with scratch(prints.sparkSession) as outlive:
        keyed = materialise(block_keys(prints, distance, blocks), "keys")
        links = materialise(pivot_links(keyed, distance), "links")
        found = components(links)
        more = materialise(apart_links(keyed, found, distance, blocks), "more")
        if more.isEmpty():
            return outlive(found, "linked")
        return outlive(with_links(found, more), "linked")


def _state(edges: DataFrame) -> tuple:
    digest: Column = F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def _roots(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, root) of each node with a smaller neighbour: where it gets by going to the smallest neighbour again and again.

    Only nodes that are not yet under a root are joined: of a star, none."""
    parent = materialise(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "parent")
    for _ in range(rounds):
        step = materialise(parent.join(parent.toDF("root", "above"), "root").select("node", F.col("above").alias("root")), "step")
        if step.isEmpty():
            return parent
        parent = materialise(parent.unionByName(step).groupBy("node").agg(F.min("root").alias("root")), "parent")
    raise RuntimeError("parents did not settle")


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, component) of the edges (a, b), a > b, but for the components themselves: alternating large-star and small-star.

    Each round is two grouped minima joined back on the edges (a hot hub is a skewed join, which AQE splits, not a
    collected group), written to the shared folder; rounds grow with the logarithm."""
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialise(small.where("a <> b").distinct(), "edges")
        last, state = state, _state(edges)
        if last == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node it reaches.

    First each node goes up to the root of its smallest neighbours, which settles stars and chains; what links different
    roots, little as a rule, is contracted in rounds (see _stars). Repeated links and links of a node with itself change
    nothing; no links give no rows."""
    with scratch(links.sparkSession) as outlive:
        edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        roots = _roots(edges, rounds)
        several = edges.groupBy("a").agg(F.min("b").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        other = edges.join(several, "a").where("b <> first").select("a", "b")  # the links that no one went up
        top = other.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b", "left").select("x", F.coalesce("y", "b").alias("y")).where("x <> y")
        top = materialise(top.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "top")
        if top.isEmpty():
            named = roots.withColumnRenamed("root", "component")
        else:
            joined = materialise(_stars(top, rounds), "joined").toDF("root", "component")
            under = roots.join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
            named = under.unionByName(joined.withColumnRenamed("root", "node"))
        named = materialise(named, "named")
        return outlive(named.unionByName(named.select(F.col("component").alias("node"), "component").distinct()), "components")


def with_links(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components found(node, component) of earlier links, joined by more links (a, b) between any nodes: only these go
    through components again, as links of components. Links of nodes that found lacks are fine."""
    with scratch(more.sparkSession) as outlive:
        own = more.join(found.toDF("a", "x"), "a", "left").join(found.toDF("b", "y"), "b", "left")
        top = components(own.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
        under = found.join(top.toDF("component", "over"), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
        return outlive(under.unionByName(top.join(found, "node", "left_anti")), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document: texts linked at `distance` bits or fewer, over any chain.

    Copies meet in one fingerprint before any join, so only distinct fingerprints are paired. Null and empty texts have
    fingerprint zero and link like others. Null ids keep their rows, link like others and never name a component (one
    without any id has a null component_id). Repeated ids keep a row each. An empty table gives no rows.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(with_fingerprint(src).select("doc_id", "fp"), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = linked(nodes.select(F.col("fp").alias("f")), distance, blocks).withColumnRenamed("node", "fp")
    grouped = materialise(nodes.join(found, "fp"), "grouped")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    alone = nodes.join(grouped.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    back = prints.join(named.unionByName(alone), "fp")
    return back.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
