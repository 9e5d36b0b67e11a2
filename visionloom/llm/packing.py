"""Sequence packing by minimum bin slack over a histogram of lengths.

Only the histogram (at most `capacity` rows, whatever the input) reaches the driver. It yields recipes, each a fullest
combination of lengths with the number of bins that repeat it; Spark ranks the pieces of each length and deals them out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise

#: Bytes of each of the two generations of a worker's cache, by a count of 200 a word and its letters and ids.
CACHE_BYTES = 24_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_tokenizers: dict[str, Callable[[list], list[bytes]]] = {}
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_TAIL = ".,;:!?*$%#&|"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable byte stands for itself, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [x for x in range(256) if x not in plain]
    return {x: chr(256 + i) for i, x in enumerate(odd)}


def word_tokenizer(path: str) -> Callable[[list], list[bytes]]:
    """Encodes whole texts to little-endian 32-bit ids, word by word through a cache that a worker keeps across tasks.

    Words part at space and newline only, which this kind of tokenizer (white space dropped, lower case, letters apart
    from signs) never joins, so the ids are those of the whole text; a property test holds it against encode(). New words of
    plain letters and a tail of signs go straight to the tokenizer's merges, any others through all of its steps. The
    cache has two generations, so common words stay.
    """
    if path in _tokenizers:
        return _tokenizers[path]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    merges, letters = tok.model.tokenize, byte_letters()
    young: dict[str, bytes] = {"": b""}
    old: dict[str, bytes] = {}
    held = 0

    def whole(words: list[str]) -> None:
        for w, e in zip(words, tok.encode_batch_fast(words, add_special_tokens=False)):
            young[w] = np.array(e.ids, "<u4").tobytes()

    def learn(words: list[str]) -> None:
        rest = []
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            base = w.rstrip(_TAIL)
            if base and not _LETTERS.fullmatch(base):
                rest.append(w)
                continue
            low, tail = base.lower(), w[len(base) :]
            if low not in young:
                if low in old:
                    young[low] = old[low]
                else:
                    mapped = low if low.isascii() else low.encode().decode("latin-1").translate(letters)
                    young[low] = array("I", [t.id for t in merges(mapped)]).tobytes()
            if tail and tail not in young:
                whole([tail])
            young[w] = young[low] + young[tail]
        whole(rest)

    def encode(texts: list) -> list[bytes]:
        nonlocal young, old, held
        if held > CACHE_BYTES:
            young, old, held = {"": b""}, young, 0
        split = [("" if t is None else t).replace("\n", " ").split(" ") for t in texts]
        fresh = list(set().union(*split).difference(young))
        learn(fresh)
        held += sum(200 + len(w) + len(young[w]) for w in fresh)
        out = [b"".join([young[w] for w in words]) for words in split]
        if held > 8 * CACHE_BYTES:  # one text of very many words
            young, old, held = {"": b""}, {}, 0
        return out

    return _tokenizers.setdefault(path, encode)


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only beyond capacity.

    Null text is empty: one piece that holds the end id. Null and repeated ids are documents of their own. No shuffle.
    """
    path = path or default_vocabulary()
    piece = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    tail = np.array([end_id], "<u4").tobytes()

    def fn(texts: list, encode: Callable) -> dict:
        out = []
        for lo in range(0, len(texts), 256):
            for ids in encode(texts[lo : lo + 256]):
                ids += tail
                step = 4 * capacity
                out.append([{"piece": i, "start": i * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for i, p in enumerate(ids[at : at + step] for at in range(0, len(ids), step))])
        return {"pieces": out}

    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text"))
    cut = append_columns(src, [T.StructField("pieces", T.ArrayType(piece))], fn, ["__text"], setup=lambda: word_tokenizer(path))
    return cut.select("doc_id", F.inline("pieces"))


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Recipes ([(length, copies)], bins): fix the longest length left, then fill the rest of the bin as far as any
    combination can (subset-sum over a bitset, longest first, stopped once the bin is full), as often as counts last.
    No counts, no recipes; a length outside 1..capacity is an error."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("a length is not in 1..capacity")
    recipes = []
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        room = capacity - top
        full = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for n in order:
            if n > room:
                continue
            for _ in range(min(left[n] - (n == top), room // n)):
                grown = (reach | reach << n) & full
                if grown == reach:
                    break
                steps.append((n, reach))
                reach = grown
                if reach >> room & 1:
                    break
            if reach >> room & 1:
                break
        at, used = reach.bit_length() - 1, {top: 1}
        for n, before in reversed(steps):
            if not before >> at & 1:
                used[n] = used.get(n, 0) + 1
                at -= n
        bins = min(left[n] // k for n, k in used.items())
        recipes.append((sorted(used.items(), reverse=True), bins))
        for n, k in used.items():
            left[n] -= k * bins
        order = [n for n in order if left[n]]
    return recipes


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with (sequence_id, offset). Ranks inside a length are counted in
    1024 digest buckets, so a length that holds a third of all pieces (copies, or full pieces) is no single task; the
    digest is of the id, the piece and its checksum. Recipes are bounded by the capacity.
    Null ids and repeated rows are pieces of their own; no pieces, no rows; any other column is kept."""
    rows = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024)).cast("int"))
    counts = materialise(rows.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    lengths, starts, copies, first, offsets = [], [], [], [], []
    seen, bins_before = dict.fromkeys(histogram, 0), 0
    for used, bins in minimum_bin_slack(histogram, capacity):
        offset = 0
        for n, k in used:
            lengths.append(n), starts.append(seen[n]), copies.append(k), first.append(bins_before), offsets.append(offset)
            seen[n] += k * bins
            offset += n * k
        bins_before += bins
    base, total = {}, 0
    for n in sorted(histogram):
        base[n], total = total, total + histogram[n]
    edge = np.array([base[n] + s for n, s in zip(lengths, starts)], np.int64)
    by = np.argsort(edge, kind="stable")
    plan = tuple(np.array(x, np.int64)[by] for x in (edge, lengths, copies, first, offsets))
    starts_of = np.zeros(capacity + 1, np.int64)
    for n, b in base.items():
        starts_of[n] = b

    run = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "__b", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("__r", F.row_number().over(inner) - 1).join(before, ["length", "__b"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")

    def fn(length: list, rank: list) -> dict:
        edge, n_of, k_of, first, offset = plan
        n, r = np.array(length, np.int64), np.array(rank, np.int64)
        pos = starts_of[n] + r
        i = np.searchsorted(edge, pos, "right") - 1
        k = pos - edge[i]
        return {"sequence_id": (first[i] + k // k_of[i]).tolist(), "offset": (offset[i] + k % k_of[i] * n_of[i]).tolist()}

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return append_columns(ranked, fields, fn, ["length", "__rank"]).drop("__rank")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every document.

    Null and empty texts pack as their end id alone; repeated ids pack as documents of their own; an empty table packs
    to no rows; other columns are ignored.
    """
    pieces = materialise(token_pieces(docs, doc_id, text, capacity, path=path), "pieces")
    done = pack(pieces, capacity)
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
