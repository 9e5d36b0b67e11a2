"""Benchmark decontamination: a generalised suffix automaton of the test items, over which training words are streamed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialise, unused, utf8

#: A-Z lowered, digits, letters and non-ASCII bytes kept, all else to spaces.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


def word_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the words of a UTF-8 text, in the order of words_of."""
    spans, at, flat = [], 0, raw.translate(_WORDS)
    for w in flat.split():
        at = flat.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return spans


class Automaton:
    """Suffix automaton over the word sequences of items; each state knows which items its strings occur in.

    states: transitions, suffix link and longest length. `items` is filled only where a window can end: states that
    hold strings of `window` words, and states that end a whole shorter item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: list[list[tuple[int, str]]] = [[]]
        shorter = []
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            if words and len(words) < window:
                shorter.append((name, words))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        occurs: list[set[str]] = [set() for _ in self.next]
        for name, words in items:  # every prefix state, then up the links: the items that hold the state's strings
            s = 0
            for w in words:
                s = self.next[s][w]
                occurs[s].add(name)
        for s in order:
            if self.length[s] >= window:
                occurs[self.link[s]] |= occurs[s] if self.length[self.link[s]] >= window else set()
        self.items = [frozenset(x) if n >= window else frozenset() for x, n in zip(occurs, self.length)]
        for name, words in shorter:
            s = 0
            for w in words:
                s = self.next[s][w]
            self.whole[s].append((len(words), name))
        #: Of each state: the nearest suffix that ends a whole shorter item (0: none), and the shortest of `window` words or more.
        self.ends, self.shortest = [0] * len(self.next), list(range(len(self.next)))
        for s in reversed(order):
            up = self.link[s]
            self.ends[s] = s if self.whole[s] else self.ends[up]
            if self.length[up] >= window:
                self.shortest[s] = self.shortest[up]

    def _state(self, length: int) -> int:
        self.next.append({}), self.link.append(0), self.length.append(length), self.whole.append([])
        return len(self.next) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur, p = self._state(self.length[last] + 1), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (end exclusive, merged) inside occurring windows, and the items whose windows occur."""
        step, link, length, window, ends = self.next, self.link, self.length, self.window, self.ends
        spans: list[list[int]] = []
        names: set[str] = set()
        s = n = 0
        root = step[0]
        for i, w in enumerate(words):
            if w in step[s]:
                s = step[s][w]
                n += 1
            elif w not in root:
                s = n = 0
                continue
            else:
                while w not in step[s]:
                    s = link[s]
                n = length[s] + 1
                s = step[s][w]
            t = ends[s]
            if n < window and not t:
                continue
            best = 0
            while t:  # the whole shorter items that end here, fewer than `window`
                for k, name in self.whole[t]:
                    if k <= n:
                        best = max(best, k)
                        names.add(name)
                t = ends[link[t]]
            if n >= window:
                names |= self.items[self.shortest[s]]
                best = window
            if best:
                if spans and spans[-1][1] >= i + 1 - best:
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], i + 1 - best), i + 1
                else:
                    spans.append([i + 1 - best, i + 1])
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [tuple(x) for x in merged], names


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, a bounded block of words at a time; the name of a null id is None."""
    block, size = [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        n = len(words_of(r[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        if n:
            block.append((r[0], r[1]))
            size += n
    if block:
        yield block


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_BUILT: dict[tuple, Automaton] = {}


def automaton(items: tuple[tuple[str | None, str], ...], window: int) -> Automaton:
    """Built once per worker and block."""
    key = (hashlib.sha1(repr(items).encode()).digest(), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton([(i, words_of(t)) for i, t in items], window)
    return _BUILT[key]


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
#: Called with a text, its number of words, its spans and its items after the last block; gives the values of further columns.
Finish = tuple[list[T.StructField], Callable[[str | None, int, list[tuple[int, int]], list], tuple]]


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, item_id: str = "item_id", item_text: str = "text", block_words: int = 200_000, finish: Finish | None = None) -> DataFrame:
    """docs with n_words, hit_spans (word numbers, end exclusive) and hit_items (ids as strings, sorted; items without an id as one null at the end).

    Whole texts are streamed. A benchmark of more than block_words words is taken in blocks, one pass each over docs
    with an automaton of bounded size, written between passes, so a task holds one automaton; no block is left out.
    With `finish` its columns come in place of the three (one of them may be the text itself). Nulls have no words; an
    empty benchmark hits nothing; columns of docs with these names are replaced. No shuffle.
    """
    extra, make = finish or ([], None)
    hidden: list[str] = []
    for f in _FOUND:
        hidden.append(unused([*docs.columns, *hidden], f.name) if make else f.name)
    between = [T.StructField(n, f.dataType) for n, f in zip(hidden, _FOUND)]

    def one(items: tuple, first: bool, last: bool):
        def fn(texts: list, *before) -> dict:
            (old_spans, old_items), sam = ([], []) if first else before[:2], automaton(items, window)
            rows = []
            for i, t in enumerate(texts):
                words = words_of(t)
                found, who = sam.scan(words)
                if not first:
                    found, who = union_spans(found + [(x["start"], x["end"]) for x in old_spans[i]]), who | set(old_items[i])
                names = sorted(who, key=lambda x: (x is None, x or ""))
                rows.append(make(t, len(words), found, names) if last and make else (len(words), [{"start": a, "end": b} for a, b in found], names))
            fields = extra if last and make else between
            return {f.name: list(c) for f, c in zip(fields, zip(*rows))} if rows else {f.name: [] for f in fields}

        return fn

    def passes() -> Iterator[tuple[list, bool]]:
        held = None
        for items in item_blocks(benchmark, item_id, item_text, block_words):
            if held is not None:
                yield held, False
            held = items
        yield held or [], True

    done, n = docs, 0
    for items, last in passes():
        inputs = [text] if n == 0 else [text, *hidden[1:]]
        items = tuple(sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1])))
        done = append_columns(done, extra if last and make else between, one(items, n == 0, last), inputs)
        n += 1
        if not last:
            done = materialise(done, "windows")
    return done.drop(*hidden) if make else done


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans, each span (from its first word to its last) made one space."""
    if text is None or not spans:
        return text
    raw, at, kept = utf8(text), 0, []
    places = word_spans(raw)
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b" ".join([*kept, raw[at:]]).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, most_coverage: float = 0.8) -> DataFrame:
    """docs without benchmark passages: spans of `window` words or more of an item (or whole shorter items) are cut out,
    and documents of which they cover more than most_coverage go. Clean documents stay as they are, those with null or
    empty texts too; repeated rows are treated alike. Finding and cutting are one pass."""
    names, covered = docs.columns, unused(docs.columns, "covered")

    def cut(t: str | None, n: int, spans: list[tuple[int, int]], _: list) -> tuple:
        hit = sum(b - a for a, b in spans)
        gone = hit > n * most_coverage
        return (None if gone else without_spans(t, spans)), gone

    fields = [T.StructField(text, T.StringType()), T.StructField(covered, T.BooleanType())]
    found = find_windows(docs, benchmark, text, window, finish=(fields, cut))
    return found.where(~F.col(covered)).select(*[F.col(f"`{c}`") for c in names])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document; repeated ids keep a row each.

    An empty benchmark, or items without words, hit nothing; repeated item ids count once. Items without an id count for
    n_hit and contaminated and, all together, as one of n_items, but not in items_sha256."""
    found = find_windows(docs.select("doc_id", "text"), benchmark, window=window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
