"""Leak-proof grouped and stratified splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visionloom.functions.scalar import SPLITS


def units(images: DataFrame) -> DataFrame:
    """(unit, n, locked): a group or an image alone; locked members decide, train before val before test."""
    rank = F.expr("CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 END")
    rows = images.groupBy(F.coalesce("grp", "uid").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("r"))
    return rows.select("unit", "n", F.try_element_at(F.array(*map(F.lit, SPLITS)), (F.col("r") + 1).cast("int")).alias("locked"))


def _rarest(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(unit, category): the rarest category of the annotated units, by name at a tie."""
    counts = annotations.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    member = images.select("uid", F.coalesce("grp", "uid").alias("unit"))
    pairs = annotations.select("image_uid", "category").join(member, F.expr("image_uid = uid")).select("unit", "category").distinct()
    return pairs.join(counts, "category").groupBy("unit").agg(F.min(F.struct("total", "category")).alias("s")).select("unit", "s.category")


def _stratum() -> Column:
    return F.coalesce("category", F.lit("__unlabeled__")).alias("stratum")


def strata(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(unit, stratum): the rarest category of the unit, by name at a tie; __unlabeled__ without one."""
    members = images.select(F.coalesce("grp", "uid").alias("unit")).distinct()
    return members.join(_rarest(images, annotations), "unit", "left").select("unit", _stratum())


def deal_sizes(counts: dict[int, int], share: list[float]) -> dict[int, list[int]]:
    """How many of the units of each size go to each split if units go one by one, larger first, to the split furthest
    below its share (the first at a tie). Of equal units all but the last few are dealt at once, with the same result."""
    total, fill, out = float(sum(n * c for n, c in counts.items())), [0.0] * len(share), {}
    for n in sorted(counts, reverse=True):
        left, took = counts[n], [0] * len(share)
        gaps = [total * s - f for s, f in zip(share, fill)]
        if n > 0 and left > 8 * len(share):
            order = sorted(gaps, reverse=True)
            level = max((sum(order[:k]) - n * left) / k for k in range(1, len(order) + 1))  # where all units would fill the gaps to
            took = [max(0, int((g - level) // n) - 2) for g in gaps]
            left -= sum(took)
        for _ in range(left):
            k = max(range(len(share)), key=lambda i: (total * share[i] - (fill[i] + n * took[i]), -i))
            took[k] += 1
        fill = [f + n * t for f, t in zip(fill, took)]
        out[n] = took
    return out


def assign(images: DataFrame, annotations: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, respect_existing: bool = True) -> DataFrame:
    """images with a split: every unit whole in one split.

    In each stratum units go, larger first and then by a seeded hash, to the split furthest below its share. Only the
    counts of unit sizes of a stratum are dealt in one place; units are ranked among their equals in 4096 hash buckets, so
    a stratum of any size is no single task, and the rule is the same at every size.
    """
    if len(ratios) != 3 or min(ratios) < 0 or sum(ratios) <= 0:
        raise ValueError("three ratios of a positive sum are needed")
    share = [r / sum(ratios) for r in ratios]
    u = units(images) if respect_existing else units(images).withColumn("locked", F.lit(None).cast("string"))
    digest = F.sha1(F.concat(F.lit(f"{seed}|"), "unit").cast("binary"))
    every = u.join(_rarest(images, annotations), "unit", "left").select("unit", "n", "locked", _stratum(), F.left(digest, F.lit(3)).alias("b"))
    every = every.repartition("stratum", "n", "b")  # one shuffle, which the counts and the ranks below both read
    free = F.count(F.when(F.col("locked").isNull(), F.col("unit")))
    counts = every.groupBy("stratum", "n", "b").agg(free.alias("c"))
    ahead = Window.partitionBy("stratum", "n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stratum", "n", "b", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        out = deal_sizes(dict(zip(rows["n"].tolist(), rows["c"].tolist())), share)
        return pd.DataFrame([(rows["stratum"].iloc[0], n, *took) for n, took in out.items()], columns=["stratum", "n", *SPLITS])

    sizes = counts.groupBy("stratum", "n").agg(F.sum("c").alias("c"))
    dealt = sizes.groupBy("stratum").applyInPandas(deal, "stratum string, n long, train long, val long, test long")
    own = F.row_number().over(Window.partitionBy("stratum", "n", "b").orderBy(F.col("locked").isNotNull(), digest, "unit")) - 1
    ranked = every.withColumn("own", own).join(starts.join(dealt, ["stratum", "n"]), ["stratum", "n", "b"])
    rank = F.col("start") + F.col("own")
    place = F.when(rank < F.col("train"), "train").when(rank < F.col("train") + F.col("val"), "val").otherwise("test")
    named = ranked.select(F.col("unit").alias("__unit"), F.coalesce("locked", place).alias("__dealt"))
    rows = images.withColumn("__unit", F.coalesce("grp", "uid")).join(named, "__unit", "left")
    return rows.withColumn("split", F.col("__dealt")).select(*images.columns)


def report(images: DataFrame) -> DataFrame:
    """(split, images, share) of assigned images."""
    total = F.broadcast(images.agg(F.count(F.lit(1)).alias("total")))
    return images.groupBy("split").agg(F.count(F.lit(1)).alias("images")).crossJoin(total).select("split", "images", F.round(F.col("images") / F.col("total"), 6).alias("share"))


def missing_classes(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(split, category) for classes that val or test lacks."""
    rows = annotations.join(images.select("uid", "split"), F.expr("image_uid = uid")).groupBy("category").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("val", "test")])
    lacking = F.filter(F.array(*[F.when(F.col(s) == 0, F.lit(s)) for s in ("val", "test")]), lambda x: x.isNotNull())
    return rows.select(F.explode(lacking).alias("split"), "category")


def largest_remainder(n: int, ratios: Iterator[float]) -> list[int]:
    shares = [n * r for r in ratios]
    out = [int(s) for s in shares]
    for i in sorted(range(len(shares)), key=lambda i: (out[i] - shares[i], i))[: n - sum(out)]:
        out[i] += 1
    return out


def ensure_minimums(assigned: DataFrame, min_val: int = 0, min_test: int = 0) -> DataFrame:
    """assigned(unit, split, ...) after moving train units to val, then to test, until each has its minimum, one train unit
    always staying. Moved are the first train units by name: at most min_val + min_test rows are ranked, as a top-k."""
    n = assigned.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]).first()
    to_val = max(0, min(min_val - n["val"], n["train"] - 1))
    to_test = max(0, min(min_test - n["test"], n["train"] - to_val - 1))
    if not to_val + to_test:
        return assigned
    first = assigned.where("split = 'train'").select("unit").orderBy("unit").limit(to_val + to_test)
    rank = F.row_number().over(Window.orderBy("unit"))  # over the limit's few rows
    moved = first.select("unit", F.when(rank <= to_val, "val").otherwise("test").alias("__to"))
    return assigned.join(F.broadcast(moved), "unit", "left").withColumn("split", F.coalesce("__to", "split")).select(*assigned.columns)


def ratio_deviation(images: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), most: float = 0.03) -> DataFrame:
    """(split, target, actual, off): shares of the assigned images against the target; off where the worst is over `most`."""
    total = sum(ratios)
    n = images.where(F.col("split").isin(SPLITS)).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    share = [F.round(F.coalesce(F.try_divide(s, "n"), F.lit(0.0)), 4) for s in SPLITS]
    rows = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(round(r / total, 4)).alias("target"), x.alias("actual")) for s, r, x in zip(SPLITS, ratios, share)])
    worst = F.greatest(*[F.abs(x - r / total) for x, r in zip(share, ratios)])
    return n.withColumn("off", (worst > most) & (F.col("n") > 0)).select("off", F.inline(rows)).select("split", "target", "actual", "off")
