"""Line dedup: lines whose normalised key many documents hold stay in one of them only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, give_back, materialise, scratch, slices, small_batches, unused, utf8

_LOWER = bytes(range(256)).lower()
_SPACE = b" \t\n\v\f\r"
_M64 = (1 << 64) - 1


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line: white space off both ends, A-Z lowered."""
    return [k.strip(_SPACE) for k in utf8(text).translate(_LOWER).split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _digests(text: str | None, least: int) -> list[int]:
    """128-bit hashes of the keys of at least `least` code points, -1 for the other lines."""
    digest = xxhash.xxh3_128_intdigest
    return [digest(k) if _long_enough(k, least) else -1 for k in line_keys(text)]


def exploded_keys(docs: DataFrame, row: list[str], text: str, least: int) -> DataFrame:
    """(*row, k1, k2) of every distinct key of a row's text, k1 and k2 the halves of its hash. No shuffle."""
    src = docs.select(*row, text)
    small_batches(docs.sparkSession)
    n = len(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for b in slices(whole, [n]):
                    found = [list({d for d in _digests(t, least) if d >= 0}) for t in b.column(n).to_pylist()]
                    flat = [d for ds in found for d in ds]
                    at = np.repeat(np.arange(len(found)), [len(ds) for ds in found])
                    halves = [np.array(h, np.uint64).view(np.int64) for h in ([d >> 64 for d in flat], [d & _M64 for d in flat])]
                    yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(at)) for i in range(n)] + [pa.array(h) for h in halves], names=[*row, "k1", "k2"])
        finally:
            give_back()

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:n], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]))


def without_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with their texts less the common lines, and how many lines they had and lost.

    Common are keys of at least least_chars code points in at least least_docs documents: they lose all their lines but
    those in the document with the largest id. The rest stay as they were, in order, joined by \\n. Rows that repeat an id
    are one document (their lines all stay or all go); rows without an id are one by text, and come before all ids. A null
    text is one empty line and stays null; an empty table stays empty; columns named n_lines or n_dropped are replaced.

    Keys are 128-bit hashes, counted with partial sums first by document, so a line in most documents meets as few rows.
    What a row loses is listed by (id, hash of the text): never more than its text has lines. Texts are shuffled once.
    """
    names = [c for c in docs.columns if c.lower() not in {n_lines.lower(), n_dropped.lower()}]
    hidden: list[str] = []
    for stem in ("id", "th", "lost"):
        hidden.append(unused([*docs.columns, *hidden, "k1", "k2"], stem))
    no, th, lost = hidden
    rows = docs.withColumns({no: F.col(f"`{doc_id}`"), th: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    with scratch(docs.sparkSession) as outlive:
        keyed = materialise(exploded_keys(rows, [no, th], text, least_chars), "keys")
        who = F.when(F.col(no).isNull(), F.col(th))
        held = keyed.groupBy("k1", "k2").agg(F.count_distinct(F.struct(no, who)).alias("n"), F.max(no).alias("top"), F.max(who).alias("bare"))
        common = held.where(F.col("n") >= least_docs).drop("n")
        stays = F.when(F.col("top").isNull(), F.col(th) == F.col("bare")).otherwise(F.coalesce(F.col(no) == F.col("top"), F.lit(False)))
        drops = keyed.join(common, ["k1", "k2"]).where(~stays).groupBy(no, th).agg(F.collect_set("k1").alias(lost))
        drops = outlive(drops, "lost")
    fresh = drops.select(F.col(no).alias("i"), F.col(th).alias("h"), lost)
    joined = rows.join(fresh, F.col(no).eqNullSafe(F.col("i")) & (F.col(th) == F.col("h")), "left")

    def keep(texts: list, gone: list) -> dict:
        kept, before, off = [], [], []
        for t, ks in zip(texts, gone):
            n = 1 if t is None else t.count("\n") + 1
            before.append(n)
            if ks:
                ks = set(ks)
                lines = [x for x, d in zip(t.split("\n"), _digests(t, least_chars)) if d < 0 or (d >> 64) - (d >> 127 << 64) not in ks]
                t = "\n".join(lines)
                off.append(n - len(lines))
            else:
                off.append(0)
            kept.append(t)
        return {text: kept, n_lines: before, n_dropped: off}

    src = joined.select(*[F.col(f"`{c}`") for c in names], lost)
    fields = [T.StructField(text, T.StringType()), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())]
    return append_columns(src, fields, keep, [text, lost]).select(*[F.col(f"`{c}`") for c in names], n_lines, n_dropped)


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per document: the digest of what is left of a text, of a null one that of no bytes."""
    done = without_common_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
