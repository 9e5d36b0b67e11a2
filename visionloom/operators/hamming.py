"""Joins of 64-bit fingerprints by Hamming distance: equal ones collapsed, the rest met under sets of agreeing blocks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more fingerprints is divided by the bits that divide its own fingerprints best. Any value gives the same pairs.
HOT, _SAMPLE = 1000, 16
#: Keyed fingerprints of a task. They are few bytes, so partitions by bytes would hold tens of millions of them and their pairs.
ROWS = 1 << 18
#: Ids of one fingerprint that a task joins at most, give or take; more are dealt out.
MANY = 1 << 18
#: Ids of one fingerprint that are paired at once, give or take, where pairs of all ids are made.
COPIES = 1 << 10


def _long(v: int) -> Column:
    return F.lit(v - (v >> 63 << 64)).cast("bigint")


def representatives(prints: DataFrame) -> DataFrame:
    """(fp, rep, copies) of prints(id, fp): the smallest id of each fingerprint and how many have it. Null prints are none."""
    return prints.where("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _by_print(ids: DataFrame, named: DataFrame, reps: DataFrame, many: int) -> DataFrame:
    """ids(fp, ...) joined with named(fp, copies, ...), a row a fingerprint of reps. What more than `many` ids share is a row
    for each `many` of them and its ids are dealt to these rows; so few are known to all tasks."""
    heavy = F.broadcast(reps.where(F.col("copies") > many).select("fp", F.floor(F.col("copies") / many).alias("__lots")))
    dealt = ids.join(heavy, "fp", "left").withColumn("__lot", F.coalesce(F.pmod(F.xxhash64("id"), F.col("__lots") + 1), F.lit(0))).drop("__lots")
    rows = named.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("copies") / many))))
    return dealt.join(rows, ["fp", "__lot"]).drop("__lot")


def membership(prints: DataFrame, many: int = MANY) -> DataFrame:
    """(id, rep): each id with the smallest one of its fingerprint. One row an id; a fingerprint that many have is no group
    that is collected, and its ids go to several tasks."""
    reps = representatives(prints)
    return _by_print(prints.where("fp is not null").select("id", "fp"), reps, reps, many).select("id", "rep")


def block_masks(blocks: int) -> list[int]:
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]


def agreeing(blocks: int, agree: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), agree))


def near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def meets_first(s: str, a: str, b: str, masks: list[int]) -> Column:
    """Whether s, the bits of blocks on which a and b agree, are the first ones on which they do: a pair that meets under many
    sets counts under this one. Up to 16 blocks. Each block is looked at once, so that the test stays small when compiled."""
    diff, upto = F.col(a).bitwiseXOR(F.col(b)), F.col(s)
    agreed = reduce(Column.bitwiseOR, [F.when(diff.bitwiseAND(_long(m)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)])
    for by in (1, 2, 4, 8):
        upto = upto.bitwiseOR(F.shiftright(upto, by))
    return agreed.bitwiseAND(upto) == F.col(s)


def keyed_prints(reps: DataFrame, distance: int, agree: int = 2) -> DataFrame:
    """(s, k, f) of reps(fp): each fingerprint under every set s of `agree` of distance + agree blocks, k its bits there."""
    masks = block_masks(distance + agree)
    keys = F.array(*[F.struct(F.lit(sum(1 << i for i in c)).alias("s"), F.col("fp").bitwiseAND(_long(sum(masks[i] for i in c))).alias("k")) for c in agreeing(distance + agree, agree)])
    return reps.select(F.col("fp").alias("f"), F.explode(keys).alias("e")).select("e.s", "e.k", "f")


def _balanced_masks(rows: DataFrame, blocks: int) -> DataFrame:
    """(s, k, masks): of each key, blocks of the bits dealt out in the order of how evenly they divide its fingerprints."""
    ones = [F.sum(F.shiftrightunsigned("f", i).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{i}") for i in range(64)]
    counts = rows.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n"), *ones)
    bits = F.array_sort(F.array(*[F.struct(F.abs(2 * F.col(f"b{i}") - F.col("n")).alias("off"), F.lit(i).alias("i")) for i in range(64)]))
    dealt = counts.select("s", "k", bits.alias("bits"))
    mask = lambda j: F.aggregate(F.filter("bits", lambda x, at: at % blocks == j), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["i"])))
    return dealt.select("s", "k", F.array(*[mask(j) for j in range(blocks)]).alias("masks"))


def close_pairs(keyed: DataFrame, distance: int, agree: int = 2, only: Column | None = None, first: Column | None = None, hot: int = HOT, divide: bool | None = None, parts: tuple[int, int] | None = None) -> DataFrame:
    """(a, b), a < b, of the fingerprints of keyed(s, k, f, ...) that share a key and differ in `distance` bits or fewer.

    Further columns come as x_name and y_name in `only`, a condition on pairs. Keys of up to `hot` fingerprints are joined
    as they are. Those of more are divided again: of distance + agree blocks of the bits that vary in the key, every set of
    `agree` is a finer key, so what many share by a common stretch is not paired all with all. With `first`, a condition on
    (s, a, b) that holds for one key of a pair, pairs come once; without it they are made distinct. Which keys are divided is
    told by a sixteenth of the fingerprints, since it changes how pairs are found but not which; a small job looks whether
    there are any, for a plan that provides for them takes several times as long where there are none. `parts` gives the
    numbers of partitions to deal keys and finer keys to; they never are broadcast then.
    """
    more = [c for c in keyed.columns if c not in ("s", "k", "f")]
    part = keyed.where(F.pmod(F.xxhash64("f"), F.lit(_SAMPLE)) == 0)
    many = part.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot / _SAMPLE).select("s", "k")
    side = lambda df, at, f, p: df.select(*at, F.col("f").alias(f), *[F.col(c).alias(f"{p}_{c}") for c in more])

    def met(df: DataFrame, at: list[str], n: int = 0) -> DataFrame:
        df = df.repartition(parts[n], *at) if parts else df
        other = side(df, at, "b", "y").hint("merge") if parts else side(df, at, "b", "y")
        pairs = side(df, at, "a", "x").join(other, at).where("a < b").where(near("a", "b", distance))
        pairs = pairs if only is None else pairs.where(only)
        return (pairs if first is None else pairs.where(first)).select("a", "b")

    if many.isEmpty() if divide is None else not divide:
        pairs = met(keyed, ["s", "k"])
        return pairs if first is not None else pairs.distinct()
    cold = met(keyed.join(many, ["s", "k"], "left_anti"), ["s", "k"])
    warm = keyed.join(many, ["s", "k"], "left_semi")
    finer = F.array(*[F.struct(F.lit(n).alias("s2"), F.col("f").bitwiseAND(reduce(Column.bitwiseOR, [F.col("masks")[i] for i in c])).alias("k2")) for n, c in enumerate(agreeing(distance + agree, agree))])
    divided = warm.join(_balanced_masks(warm, distance + agree), ["s", "k"]).select("s", "k", F.explode(finer).alias("e"), "f", *more).select("s", "k", "e.s2", "e.k2", "f", *more)
    again = met(divided, ["s", "k", "s2", "k2"], 1).distinct()
    return cold.unionByName(again) if first is not None else cold.unionByName(again).distinct()


def representative_pairs(reps: DataFrame, distance: int = 6, hot: int = HOT) -> DataFrame:
    """(fa, fb, distance) of different fingerprints of reps(fp) that differ in `distance` bits or fewer, fa < fb.

    A job over a sixteenth of them tells how many there are and whether many share a key of two blocks. If so, such keys are
    divided by their own bits (close_pairs). If not, the more there are the more blocks must agree, from one of 7 (7 keys of
    9 bits a fingerprint, at distance 6) over two of 8 (28 keys of 16 bits) to three of 9 (84 of 21). All give the same pairs."""
    part = keyed_prints(reps.where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLE)) == 0), distance, 2).groupBy("s", "k").agg(F.count(F.lit(1)).alias("n"))
    crowded = F.when(F.col("n") > hot / _SAMPLE, F.col("n"))
    most, rows, many = part.agg(*[F.coalesce(c, F.lit(0)) for c in (F.max("n"), F.sum("n"), F.sum(crowded))]).first()
    n, divide = rows // len(agreeing(distance + 2, 2)) * _SAMPLE, most > hot / _SAMPLE
    agree = 2 if divide else 1 if n <= 1 << 15 else 2 if n <= 1 << 22 else 3
    first = meets_first("s", "a", "b", block_masks(distance + agree))
    parts = tuple(1 + k * _SAMPLE * len(agreeing(distance + agree, agree)) // ROWS for k in (n // _SAMPLE, many))
    pairs = close_pairs(keyed_prints(reps.repartition(parts[0], "fp"), distance, agree), distance, agree, first=first, hot=hot, divide=divide, parts=parts)
    return pairs.select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("bigint").alias("distance"))


def near_representatives(prints: DataFrame, distance: int = 6, hot: int = HOT) -> DataFrame:
    """(a, b, distance), a < b: the smallest ids of different fingerprints that are near. With membership this holds every
    link between ids in as many rows as there are links between different fingerprints, however many copies each has."""
    reps = representatives(prints).select("fp", "rep")
    pairs = representative_pairs(reps, distance, hot)
    named = pairs.join(reps.toDF("fa", "x"), "fa").join(reps.toDF("fb", "y"), "fb")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def expand_pairs(prints: DataFrame, pairs: DataFrame, ids: DataFrame | None = None, many: int = COPIES) -> DataFrame:
    """(a, b, distance), a < b, of all ids: those of the near fingerprints in pairs(fa, fb, distance) and equal ones, on
    request, since copies make as many rows as they have pairs. Where ids carry more, `ids` has them in place of prints: as
    structs, which are compared by their first field first. Pairs of few ids can be many, so they are dealt out by number,
    and of a fingerprint that more than `many` ids have, `many` or so at once."""
    known = (prints if ids is None else ids).where("fp is not null").select("id", "fp").repartition("fp")
    reps = representatives(prints)
    copied = reps.where("copies > 1").select(F.col("fp").alias("fa"), F.col("fp").alias("fb"), F.lit(0).cast("bigint").alias("distance"))
    heavy = F.broadcast(reps.where(F.col("copies") > many).select(F.col("fp").alias("fb"), F.floor(F.col("copies") / many).alias("__lots")))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = pairs.unionByName(copied).join(known.toDF("x", "fa"), "fa").join(heavy, "fb", "left")
    left = left.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__lots", F.lit(0))))).drop("__lots").repartition(parts, "fb", "__lot")
    right = known.toDF("y", "fb").join(heavy, "fb", "left").withColumn("__lot", F.coalesce(F.pmod(F.xxhash64("y"), F.col("__lots") + 1), F.lit(0))).drop("__lots")
    each = left.join(right, ["fb", "__lot"]).where("fa <> fb or x < y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def near_duplicate_pairs(prints: DataFrame, distance: int = 6) -> DataFrame:
    """(a, b, distance) of ids whose fingerprints in prints(id, fp) differ in `distance` bits or fewer; the smaller id first."""
    return expand_pairs(prints, representative_pairs(representatives(prints).select("fp"), distance))


def near_links(prints: DataFrame, distance: int = 6, many: int = MANY) -> DataFrame:
    """(id, rep, copies, links) per id: its representative, how many ids share its fingerprint, itself included, and how many
    ids of other fingerprints are near. In proportion to the ids and the near fingerprints, never to pairs of copies."""
    reps = representatives(prints)
    pairs = representative_pairs(reps.select("fp"), distance)
    sizes = reps.select("fp", "copies")
    side = lambda f, fp: F.struct(F.col(f).alias("f"), F.col(fp).alias("fp"))
    both = pairs.select(F.inline(F.array(side("fa", "fb"), side("fb", "fa"))))
    links = both.join(sizes, "fp").groupBy("f").agg(F.sum("copies").alias("links")).withColumnRenamed("f", "fp")
    named = reps.join(links, "fp", "left").select("fp", "rep", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return _by_print(prints.where("fp is not null").select("id", "fp"), named, reps, many).select("id", "rep", "copies", "links")
