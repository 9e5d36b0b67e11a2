"""Periodic runs of words: a suffix automaton whose end positions are merged small to large gives the squares that seed them."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, utf8

_MIX = np.uint64(0x9E3779B97F4A7C15)  # any odd number does: equal words give equal sums
_ROUNDS, _BLOCK = 8, 1024


class Positions:
    """An ordered set of numbers in blocks of bounded size."""

    __slots__ = ("blocks", "highs", "n")

    def __init__(self, first: int):
        self.blocks, self.highs, self.n = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Takes in x, which is new; the members before and after it, -1 where there is none."""
        k = bisect_left(self.highs, x)
        if k == len(self.blocks):
            k -= 1
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.highs[k - 1] if k else -1
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        block.insert(i, x)
        self.highs[k] = block[-1]
        if len(block) > _BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.highs[k : k + 1] = [block[half - 1], block[-1]]
        self.n += 1
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


class Automaton:
    """Suffix automaton of a sequence of small numbers. A state's first transition is in two arrays, further ones in a
    dictionary of the few states that have them, so long periodic texts take some tens of bytes a word."""

    def __init__(self, words: list[int]):
        self.link, self.length, self.end = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for i, w in enumerate(words):
            last = self._extend(last, w, i)

    def _step(self, s: int, w: int) -> int:
        if self.word[s] == w:
            return self.to[s]
        rest = self.more.get(s)
        return rest.get(w, -1) if rest else -1

    def _set(self, s: int, w: int, t: int) -> None:
        if self.word[s] in (w, -1):
            self.word[s], self.to[s] = w, t
        else:
            self.more.setdefault(s, {})[w] = t

    def _state(self, length: int, end: int) -> int:
        self.link.append(0), self.length.append(length), self.end.append(end), self.word.append(-1), self.to.append(-1)
        return len(self.link) - 1

    def _extend(self, last: int, w: int, i: int) -> int:
        cur, p = self._state(self.length[last] + 1, i), last
        while p != -1 and (q := self._step(p, w)) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p == -1:
            return cur
        if self.length[q] == self.length[p] + 1:
            self.link[cur] = q
            return cur
        c = self._state(self.length[p] + 1, -1)
        self.link[c], self.word[c], self.to[c] = self.link[q], self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = self.link[cur] = c
        while p != -1 and self._step(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return cur


def _agree(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many of the words from i and from j on, going by step (1 or -1), are equal; i < j."""
    most = len(w) - j if step > 0 else i + 1
    done, size = 0, 32
    while done < most:
        k = min(size, most - done)
        if step > 0:
            same = w[i + done : i + done + k] == w[j + done : j + done + k]
        else:
            same = (w[i - done - k + 1 : i - done + 1] == w[j - done - k + 1 : j - done + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done += k
        size *= 4
    return done


def seeded_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs: stretches of at least two of their smallest period that no neighbour extends; end exclusive.

    Two neighbours at distance d in the end positions of a state whose longest string has d words or more end a square of
    period d. Squares inside a known run of their period are passed over, the others extended over the words. A distance
    that was no neighbour's in the end may be a multiple of the smallest period: of one stretch the smallest stays.
    """
    sam = Automaton(words.tolist())
    length, link, ends = sam.length, sam.link, sam.end
    held: list[Positions | None] = [Positions(e) if e >= 0 else None for e in ends]
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    best: dict[tuple[int, int], int] = {}

    def seed(end: int, d: int, known: int) -> None:
        """A square of period d ends at `end`; `known` words before the last period repeat it."""
        starts, stops = by_period.setdefault(d, ([], []))
        k = bisect_right(starts, end - 2 * d + 1) - 1
        if k >= 0 and stops[k] > end:
            return
        low = end - d - known + 1
        low -= _agree(words, low - 1, low - 1 + d, -1) if low else 0
        stop = end + 1 + _agree(words, end + 1 - d, end + 1, 1)
        k = bisect_left(starts, low)
        starts.insert(k, low)
        stops.insert(k, stop)
        if best.get((low, stop), d + 1) > d:
            best[low, stop] = d

    for s in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist()[:-1]:
        up, mine = link[s], held[s]
        held[s] = None
        if not up:
            continue  # strings of no words seed nothing
        other = held[up]
        if other is None:
            held[up] = mine
            continue
        if other.n < mine.n:
            mine, other = other, mine
        held[up], n = other, length[up]
        for x in mine:
            before, after = other.add(x)
            if before >= 0 and x - before <= n:
                seed(x, x - before, n)
            if after >= 0 and after - x <= n:
                seed(after, after - x, n)
    return [(a, b, d) for (a, b), d in best.items()]


def repetitive(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches outside which no run of `least` words can be.

    A run of n >= least words and period p <= n / 2 repeats all its strings of n - p >= (least + 1) // 2 words at distance
    p, and these cover it. So only stretches covered by strings of that many words which occur twice in the same stretch
    are left. Strings are compared by sums that are equal for equal strings: a chance hit leaves more words, never less.
    """
    gram = max(1, (least + 1) // 2)
    n = len(words) - gram + 1
    if n < 2:
        return []
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, np.uint64)
    for k in range(gram):
        sums = sums * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    done, todo = [], [(0, len(words))]
    for _ in range(_ROUNDS):
        rest = []
        for a, b in todo:
            if b - a < max(least, 2) or b - a <= gram:
                continue
            part = sums[a : b - gram + 1]
            order = np.argsort(part, kind="stable")
            same = part[order[1:]] == part[order[:-1]]
            if not same.any():
                continue
            twice = np.zeros(len(part), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(b - a + 1, np.int64)
            edge[: len(part)] += twice
            edge[gram:] -= twice
            on = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
            turns = np.flatnonzero(on[1:] != on[:-1])
            found = [(a + int(x), a + int(y)) for x, y in zip(turns[::2], turns[1::2])]
            if found == [(a, b)]:
                done.append((a, b))
            else:
                rest += found
        todo = rest
    return sorted(done + [(a, b) for a, b in todo if b - a >= max(least, 2)])


def word_runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period), by start and period, of the runs of max(least, 2 * period) words or more; period is the
    smallest one, and no neighbouring word extends a run."""
    if len(words) < max(least, 2):
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    out = []
    for a, b in repetitive(ids, least):
        local = np.unique(ids[a:b], return_inverse=True)[1].astype(np.int32)
        out += [(a + s, e - s, d) for s, e, d in seeded_runs(local) if e - s >= max(least, 2 * d)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n, d in runs:
        edge[start + d] += 1
        edge[start + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist())


_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def with_runs(docs: DataFrame, text: str = "text", least: int = 12, out: str = "runs", rest: str = "collapsed") -> DataFrame:
    """docs with the periodic runs of their words (by start, then period) and the text without the repeats of a run.

    Words are what white space of ASCII separates, whole texts at a time; no shuffle. Null and empty texts have no runs and
    an empty rest. Repeated rows are treated alike, an empty table stays empty, columns with the new names are replaced.
    Words that no repeated string of least / 2 words covers go to no automaton; a task's memory follows its longest text.
    """

    def fn(texts: list) -> dict:
        runs, left = [], []
        for t in texts:
            words = utf8(t).split()
            found = word_runs(words, least)
            runs.append([{"start": s, "length": n, "period": d} for s, n, d in found])
            left.append(collapsed(words, found).decode("utf-8", "replace"))
        return {out: runs, rest: left}

    return append_columns(docs, [T.StructField(out, _RUNS), T.StructField(rest, T.StringType())], fn, [text])


def planted(doc_id: int | None, text: str | None) -> str | None:
    """The text with the query's periodic end, for one of ten ids: from a word on, words repeat a stretch of the text."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not (words := utf8(text).split()):
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document its runs: number, the longest (smallest start, then period, at a tie) and digests of the list and of
    the text without repeats. A null id plants nothing."""
    plant = lambda ids, texts: {"text": [planted(i, t) for i, t in zip(ids, texts)]}
    changed = append_columns(docs.select("doc_id", "text"), [T.StructField("text", T.StringType())], plant, ["doc_id", "text"])
    found = with_runs(changed).drop("text")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = found.withColumn("best", order)
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
