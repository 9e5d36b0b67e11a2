"""Ranked lexical search: postings are traversed in windows of documents, scores scattered into arrays and harvested into heaps."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, give_back, materialise, scratch, unused
from .decontaminate import words_of

#: Documents of a window: scores of 8 bytes each fit a core's second-level cache.
WINDOW = 8192
#: At most so many words of items are searched for in one pass over the postings.
BLOCK_WORDS = 200_000
_FIELDS = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def share(tf: int, n: int, n_docs: int, total: int) -> int:
    """What a posting adds to a score for each unit of its term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // total))


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(id, sorted terms) of the items, a bounded block at a time; the texts of one id are one item."""
    named = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    block: dict[int | None, set[bytes]] = {}
    size, last = 0, object()
    for r in named.orderBy("i").toLocalIterator():
        if r["i"] != last and size >= block_words:
            yield [(i, sorted(w)) for i, w in block.items()]
            block, size = {}, 0
        last = r["i"]
        own = block.setdefault(last, set())
        size -= len(own)
        own.update(words_of(r["t"]))
        size += len(own)
    if block:
        yield [(i, sorted(w)) for i, w in block.items()]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) per document: its number of words, those terms of the vocabulary that it holds and how often. No shuffle."""

    def fn(texts: list) -> dict:
        sizes, terms, tfs = [], [], []
        for t in texts:
            words = words_of(t)
            sizes.append(len(words))
            found = Counter(filter(vocabulary.__contains__, words))
            terms.append([vocabulary[w] for w in found])
            tfs.append(list(found.values()))
        return {"n": sizes, "terms": terms, "tfs": tfs}

    return append_columns(docs, _FIELDS, fn, [text]).select("doc_id", *[f.name for f in _FIELDS])


class Segment:
    """The best documents of each item in one task, taken in windows of documents in the order of their ids."""

    def __init__(self, queries: list[tuple[int, list[tuple[int, int]]]], n_docs: int, total: int, k: int):
        self.queries, self.n_docs, self.total, self.k = queries, n_docs, total, k
        self.heaps: list[list[tuple[int, int, int, int | None]]] = [[] for _ in queries]
        self.score = np.zeros(WINDOW, np.int64)

    def take(self, ids: list, n: np.ndarray, doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """A window: ids and lengths by slot, and its postings (slot, term, tf)."""
        slack = np.array([8 * (10 + 90 * x * self.n_docs // self.total) for x in n.tolist()], np.int64)
        order = np.argsort(terms, kind="stable")
        doc, terms, tf = doc[order], terms[order], tfs[order].astype(np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + slack[doc])
        names, starts = np.unique(terms, return_index=True)
        bounds = dict(zip(names.tolist(), zip(starts.tolist(), [*starts.tolist()[1:], len(terms)])))
        bits: dict[int, np.ndarray] = {}
        for q, (_, wanted) in enumerate(self.queries):
            occupied = np.zeros(WINDOW // 8, np.uint8)
            for t, w in wanted:
                if t in bounds:
                    a, b = bounds[t]
                    self.score[doc[a:b]] += w * part[a:b]  # a document has one posting of a term
                    if t not in bits:
                        flags = np.zeros(WINDOW, np.uint8)
                        flags[doc[a:b]] = 1
                        bits[t] = np.packbits(flags)
                    occupied |= bits[t]
            slots = np.flatnonzero(np.unpackbits(occupied))
            if len(slots):
                self._harvest(q, slots, ids)
                self.score[slots] = 0

    def _harvest(self, q: int, slots: np.ndarray, ids: list) -> None:
        heap, got = self.heaps[q], self.score[slots]
        least = heap[0][0] if len(heap) == self.k else 1
        if len(got) > self.k:
            least = max(least, int(np.partition(got, len(got) - self.k)[len(got) - self.k]))
        for at in np.flatnonzero(got >= least).tolist():
            i = ids[slots[at]]
            entry = (int(got[at]), i is not None, -(i or 0), i)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def best(self) -> Iterator[tuple[int, int | None, int]]:
        for (name, _), heap in zip(self.queries, self.heaps):
            for s, _, _, i in heap:
                yield name, i, s


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, lengths, slots, terms, tfs) of up to WINDOW rows at a time."""
    held, rows = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            k = min(WINDOW - rows, b.num_rows - at)
            held.append(b.slice(at, k))
            rows, at = rows + k, at + k
            if rows == WINDOW:
                yield _flat(held)
                held, rows = [], 0
    if held:
        yield _flat(held)


def _flat(held: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(held).combine_chunks()
    terms = t.column("terms").combine_chunks() if t.column("terms").num_chunks != 1 else t.column("terms").chunk(0)
    tfs = t.column("tfs").combine_chunks() if t.column("tfs").num_chunks != 1 else t.column("tfs").chunk(0)
    slots = np.repeat(np.arange(t.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
    return t.column("doc_id").to_pylist(), t.column("n").to_numpy(), slots, terms.flatten().to_numpy(), tfs.flatten().to_numpy()


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, ties by ascending doc_id.

    Documents are whole texts; of them only the postings of items' terms are written, a row a document, by the task that
    read it. Each task is a segment: its rows sorted by doc_id are taken in windows of WINDOW documents, whose postings are
    scattered term by term into one score array; the slots that an item's terms occupied are harvested into its heap. No
    postings are shuffled; a task gives at most k rows an item and the last ranking joins those. Items go in blocks of
    about block_words terms, a pass over the texts each, so what tasks hold is bounded and no item is left out.

    Nulls have no terms; rows without a doc_id rank as any other, behind equal scores; repeated rows and ids rank as
    documents of their own. Texts of one item id are one item (those without an id too). No items or documents: no rows.
    """
    schema = "item_id long, rank int, doc_id long, score long"
    out = None
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with scratch(docs.sparkSession) as outlive:
        for block in item_blocks(items, item_id, item_text, block_words):
            found = outlive(_searched(rows, block, k), "ranked")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _searched(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    vocabulary = {w: j for j, w in enumerate(sorted({w for _, ws in block for w in ws}))}
    index = materialise(postings(docs, vocabulary, "text"), "postings")
    n_docs, total = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).toLocalIterator()}  # a row a term of the block
    weights = {t: weight(n_docs, n) for t, n in df.items()}
    names = [i for i, _ in block]
    queries = [(q, [(t, weights[t]) for w in ws if weights.get(t := vocabulary[w], 0) > 0]) for q, (_, ws) in enumerate(block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(queries, n_docs, total, k)
        try:
            for window in _windows(batches):
                segment.take(*window)
            rows = list(segment.best())
            yield pa.RecordBatch.from_arrays([pa.array([names[r[0]] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "q", "doc_id", "score"])
        finally:
            give_back()

    best = index.where("size(terms) > 0").sortWithinPartitions("doc_id").mapInArrow(run, "item_id long, q int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def benchmark_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(docs, benchmark)
