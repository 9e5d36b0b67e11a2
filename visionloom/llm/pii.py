"""Personal data: exact base spans, high-recall candidates, boosted trees over format and context, thresholds per kind.

All in DataFrame functions. There are no labels of personal data, so training makes its own: base spans of the corpus
rewritten as people disguise them are positive, and broken or look-alike rewritings are negative, as are the candidates
that the corpus itself holds beside its base spans where they don't look like the former. Trees are grown on the driver from counts per combination of binned
features, never from rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, unused

KINDS = ["email", "ip", "card", "phone"]

#: Base patterns. Where a plain leftmost search would try every place of a long run, a match begins only at a run's start
#: or at the last match's end (\G), which finds the same spans in linear time; possessive loops can't overflow the stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) |@)", r"(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)"
_SPELLED = r"(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )"
_MARK = r"(?:\.| \. |\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot | DOT )"
#: Candidates: spelled or bracketed marks, other separators, no leading plus, wrong check digits.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_SPELLED}[A-Za-z0-9._%+-]{{1,64}}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_MARK}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,3}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){7,14}(?![0-9])",
}
#: What a text must hold before a kind's patterns are tried: never less than a base or a loose match holds.
NEEDS = {"email": r"@|[\[({] ?(?:at|AT) ?[\])}]| (?:at|AT) ", "ip": r"[0-9] ?(?:[.\[(]|dot|DOT)", "card": r"[0-9][ ._/-]{0,3}[0-9]", "phone": r"\+[0-9][ ().0-9-]+[0-9]|[0-9][ ()./-]{0,2}[0-9]"}
CUES = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|addr|server|from", "card": r"(?i)card|visa|credit|carte|karte|tarjeta|pay", "phone": r"(?i)tel|phone|call|fax|mobil|ring"}
#: One form of rewriting in HELD is held out; fewer held-out positives than FEW give no threshold of their own but FALLBACK.
HELD, FEW, FALLBACK = 4, 30, 0.9
CONTEXT = 24  # characters before a span that are looked at
MARK, BLANK = "\x01", "\x02"  # neither is of any pattern; a text's own MARK is read as BLANK


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: inside a lambda a plain expression would be worked out for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(xs: Column, op: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """op over all earlier elements of an array of int, 0 for the first. xs must be a lambda's variable.

    A fold that appends to an array copies it at every step, so it is done in blocks, whose totals are folded after."""

    def fold_all(part: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct(op(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / block).cast("int"))
    blocks = F.transform(numbers, lambda i: fold_all(F.slice(xs, i * block + 1, F.lit(block)), lambda x: x))
    return let(blocks, lambda bs: let(fold_all(bs, lambda b: b["at"])["out"], lambda ahead: F.flatten(F.transform(bs, lambda b, j: F.transform(b["out"], lambda x: op(F.get(ahead, j), x))))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum. The sum of digits is the number of those of 1 or more, of 2 or more..."""
    back = F.reverse(number)
    once, twice = F.regexp_replace(back, "(.)(.?)", "$1"), F.translate(F.regexp_replace(back, "(.)(.?)", "$2"), "0123456789", "0246813579")
    return let(F.concat(once, twice), lambda d: (F.length(d) > 0) & (reduce(lambda a, b: a + b, [F.length(F.translate(d, "0123456789"[:j], "")) for j in range(1, 10)]) % 10 == 0))


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "phone":
        return F.length(digits(s)).between(8, 15)
    return let(digits(s), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


_SPAN = "struct<start:int,end:int,s:string,before:string,after:string>"
_BASE_TYPE = f"struct<spans:array<{_SPAN}>,masked:string>"


def _parts(text: Column, pattern: str) -> Column:
    """The gaps (even) and the matches (odd) of a text without MARK, in order."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def matches(text: Column, pattern: str, valid: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
    """(spans, masked): all leftmost non-overlapping matches that are valid, as (start, end, s, before, after) in code
    points, end exclusive, with what stands beside them; and the text with these blanked. Linear in the text."""

    def both(parts: Column) -> Column:
        kept = F.transform(parts, lambda x, i: F.when(i % 2 == 1, valid(x)).otherwise(F.lit(False)))

        def spans(ok: Column) -> Column:
            def found(starts: Column) -> Column:
                odd = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.get(ok, i))

                def one(i: Column) -> Column:
                    s, at = F.get(parts, i), F.get(starts, i)
                    return F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("s"), F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(4)).alias("after"))

                return F.transform(odd, one)

            out = let(F.transform(parts, lambda x: F.length(x)), lambda n: let(running(n, lambda a, b: a + b), found))
            masked = F.array_join(F.transform(parts, lambda x, i: F.when(F.get(ok, i), F.repeat(F.lit(BLANK), F.length(x))).otherwise(x)), "")
            return F.struct(out.alias("spans"), masked.alias("masked"))

        whole = F.struct(F.array().cast(f"array<{_SPAN}>").alias("spans"), F.get(parts, F.lit(0)).alias("masked"))
        return F.when(F.size(parts) == 1, whole).otherwise(let(kept, spans))

    return let(_parts(text, pattern), both)


def _valid_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s)


def clear_of(taken: Column, spans: Column) -> Column:
    """Those of the spans, which don't overlap each other, that overlap none of the taken (start, end): by one sort."""
    tagged = F.concat(F.transform(taken, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(0).alias("new"), F.lit("").alias("s"), F.lit("").alias("before"), F.lit("").alias("after"))), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).alias("new"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"))))

    def free(every: Column) -> Column:
        def keep(x: Column, i: Column, ends: Column) -> Column:
            after = F.get(every, i + 1)
            return (x["new"] == 1) & (F.get(ends, i) <= x["start"]) & ~F.coalesce((after["new"] == 0) & (after["start"] < x["end"]), F.lit(False))

        ends = let(F.transform(every, lambda x: F.when(x["new"] == 0, x["end"]).otherwise(F.lit(0))), lambda e: running(e, F.greatest))
        left = let(ends, lambda e: F.filter(every, lambda x, i: keep(x, i, e)))
        return F.transform(left, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "s", "before", "after")]))

    return F.when(F.size(spans) == 0, spans).otherwise(let(F.sort_array(tagged), free))


@dataclass
class Found:
    """Names of the columns that with_matches adds: the text, and per kind the base matches and the candidates."""

    text: str
    base: dict[str, str]
    loose: dict[str, str]


def with_matches(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Found]:
    """docs with the text (null as empty), the base matches and the candidates outside the base spans of their kind."""
    names = list(docs.columns)

    def fresh(stem: str) -> str:
        names.append(unused(names, stem))
        return names[-1]

    at = Found(fresh("t"), {k: fresh(f"base_{k}") for k in KINDS}, {k: fresh(f"loose_{k}") for k in KINDS})
    out = docs.withColumn(at.text, F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(BLANK)))
    for k in KINDS:
        t = F.col(at.text)
        out = out.withColumn(at.base[k], F.when(t.rlike(NEEDS[k]), matches(t, BASE[k], _valid_of(k))).cast(_BASE_TYPE))
    for k in KINDS:
        b = F.col(at.base[k])
        out = out.withColumn(at.loose[k], F.when(b.isNotNull(), matches(b["masked"], LOOSE[k])["spans"]).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return out, at


def base_of(at: Found, kind: str) -> Column:
    return F.coalesce(F.col(at.base[kind])["spans"], F.array().cast(f"array<{_SPAN}>"))


def features(kind: str, m: Column) -> dict[str, Column]:
    """Binned format and context features of a candidate; neither the plus sign nor the plain mark of an address is one."""
    s, before = m["s"], m["before"]
    n = F.length(digits(s))
    flag = lambda c: c.cast("int")
    out = {"cue": flag(before.rlike(CUES[kind])), "space_before": flag((m["start"] == 0) | before.rlike(r"[\s(:,=]$")), "runs_on": flag(m["after"].rlike(r"^[\w./-]\w"))}
    if kind == "email":
        name = F.regexp_extract(s, r"^[A-Za-z0-9._%+-]+", 0)
        at = F.when(s.rlike(r"[\[({] ?(?:at|AT)"), 2).when(s.rlike(r" (?:at|AT) "), 1).otherwise(0)
        dot = F.when(s.rlike(r"[\[({] ?(?:dot|DOT)"), 2).when(s.rlike(r" (?:dot|DOT) "), 1).otherwise(0)
        return out | {"name": F.least(F.length(name) / 4, F.lit(4)).cast("int"), "joined": flag(name.rlike("[A-Za-z][._+-][A-Za-z]|[0-9]") | s.rlike(_SPELLED + ".*" + _AT)), "shout": flag(s.contains(" AT ")), "at": at, "dot": dot, "top": flag(s.rlike(r"[^A-Za-z][A-Za-z]{2,12}$")), "capital_top": flag(s.rlike(r"[A-Z][a-z]+$")), "figures": flag(s.rlike(r"[0-9]"))}
    out |= {
        "digits": F.least(n, F.lit(20)),
        "groups": F.least(F.size(F.split(s, "[^0-9]+")), F.lit(8)),
        "spaced": flag(s.contains(" ")),
        "dashed": flag(s.contains("-")),
        "dotted": flag(s.contains(".")),
        "round": flag(s.contains("(")),
        "slashed": flag(s.contains("/")),
        "wide": flag(s.rlike(r"[^0-9+]{3}")),
    }
    if kind == "card":
        out |= {"luhn": flag(luhn(digits(s))), "first": F.substring(digits(s), 1, 1).cast("int")}
    if kind == "phone":
        out |= {"zeros": flag(s.startswith("00")), "nation": flag(s.rlike(r"^\(?0[1-9]")), "first_group": F.least(F.length(F.regexp_extract(s, "[0-9]+", 0)), F.lit(9)), "last_group": F.least(F.length(F.regexp_extract(s, "[0-9]+$", 0)), F.lit(9)), "date": flag(s.rlike(r"(?:19|20)[0-9]{2}[-/.][01][0-9]|[0-3][0-9][-/.][01][0-9][-/.](?:19|20)"))}
    if kind == "ip":
        out |= {"range": flag(F.forall(F.split(s, "[^0-9]+"), lambda p: F.lpad(p, 3, "0") <= "255")), "last": F.least(F.length(F.regexp_extract(s, "[0-9]+$", 0)), F.lit(4)), "bracketed": flag(s.rlike(r"[\[(]"))}
    return out


def disguises(kind: str, s: Column) -> tuple[list[Column], list[Column]]:
    """What a base span may be written as to hide it, and what looks like it and is none."""
    d = digits(s)
    put = lambda pattern, to: F.regexp_replace(d, pattern, to)
    if kind == "email":
        name, host = F.regexp_extract(s, "^[^@]+", 0), F.regexp_extract(s, "@(.*)$", 1)
        dots = lambda to: F.regexp_replace(host, r"\.", to)
        good = [F.concat(name, F.lit(a), h) for a, h in ((" [at] ", dots(" [dot] ")), ("(at)", dots("(dot)")), (" (at) ", host), ("[at]", host), (" {at} ", dots(" {dot} ")), (" at ", dots(" dot ")), (" AT ", dots(" DOT ")))]
        spelt = F.regexp_replace(name, "[._]", " dot ")
        joined = name.rlike("[A-Za-z][._+-][A-Za-z]|[0-9]")
        good += [F.concat(spelt, F.lit(" at "), dots(" dot ")), F.when(joined, F.concat(name, F.lit(" AT "), host)).otherwise(F.concat(name, F.lit(" [AT] "), host)), F.concat(spelt, F.lit(" [at] "), dots(" [dot] "))]
        word = F.regexp_extract(name, "^[A-Za-z]+", 0)
        return good, [F.concat(word, F.lit(" at 10.30")), F.concat(word, F.lit(" at "), F.regexp_extract(host, "^[A-Za-z]+", 0), F.lit(".The")), F.concat(word, F.lit(" at home.And")), F.concat(word, F.lit(" (at) 3.14")), F.concat(word, F.lit(" at 7 dot 5")), F.concat(word, F.lit(" at "), host), F.concat(word, F.lit(" dot "), word, F.lit(" at noon.Then"))]
    if kind == "ip":
        dots = lambda to: F.regexp_replace(s, r"\.", to)
        over = F.regexp_replace(s, r"^0*([0-9]{1,2})[0-9]?\.", r"9$1.")
        return [dots("[.]"), dots("(.)"), dots(" . "), dots("[dot]"), dots("(dot)"), dots(" dot "), dots(" DOT ")], [F.regexp_replace(over, r"^([0-9]{2})\.", "9$1."), F.concat(F.lit("999."), F.regexp_replace(s, r"^[0-9]+\.", "")), F.concat(F.lit("Fig. 300 . "), F.regexp_replace(s, r"^[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)$", r"$1 . $2 . $3"))]
    if kind == "card":
        last = F.substring(d, F.length(d), F.lit(1)).cast("int")
        wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((last + 1 + F.length(d) % 8) % 10).cast("string"))
        head = F.concat(F.lit("34"), F.substring(d, 3, 12))
        amex = F.concat(head, F.get(F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: luhn(F.concat(head, c))), F.lit(0)))
        fours = [r"([0-9]{4})(?=[0-9])", ["$1.", "$1 - ", "$1/", "$1_", "$1  "]]
        good = [F.regexp_replace(d, fours[0], to) for to in fours[1]]
        good += [amex, F.regexp_replace(amex, "^([0-9]{4})([0-9]{6})", "$1 $2 "), F.regexp_replace(amex, "^([0-9]{4})([0-9]{6})", "$1-$2-")]
        bad = [wrong, *[F.regexp_replace(wrong, fours[0], to) for to in [*fours[1], "$1 ", "$1-"]]]
        off = F.concat(head, ((F.substring(amex, 15, 1).cast("int") + 3) % 10).cast("string"))
        return good, [*bad, off, F.regexp_replace(off, "^([0-9]{4})([0-9]{6})", "$1 $2 ")]
    good = [F.regexp_replace(s, r"^\+", ""), F.regexp_replace(s, r"^\+", "00"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{4})$", "($1) $2-$3"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{4})$", "$1-$2-$3"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{4})$", "$1.$2.$3"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{4})$", "+49/$1/$2$3"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{4})$", "0$1/$2$3"), put(r"^.*([0-9]{2})([0-9]{7})$", "0049 $1 $2"), put(r"^.*([0-9]{3})([0-9]{2})([0-9]{2})([0-9]{2})$", "0033 $1 $2 $3 $4")]
    good += [put(r"^.*([0-9])([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", f"0$1{to}$2{to}$3{to}$4{to}$5") for to in (" ", ".", "-")] + [put(r"^.*([0-9]{3})([0-9]{6})$", "07$1 $2"), put(r"^.*([0-9]{2})([0-9]{3})([0-9]{4})$", "0$1 $2 $3"), put(r"^.*([0-9]{3})([0-9]{7})$", "0$1-$2")]
    bad = [d, put(r"^.*([0-9]{2})([0-9])([0-9])$", "20$1-0$2-1$3 10"), put(r"^.*([0-9]{2})([0-9])([0-9])$", "1$2.0$3.20$1 12:00"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{3})$", "$1 $2 $3"), put(r"^.*([0-9]{3})([0-9]{3})([0-9]{3})$", "$1.$2.$3"), put(r"^.*([0-9]{2})([0-9]{6})([0-9])$", "978-3-$1-$2-$3"), put(r"^.*([0-9]{2})([0-9]{2})$", "19$1-20$2 1"), put(r"^.*([0-9]{4})([0-9]{4})$", "$1 $2"), put(r"^.*([0-9]{9})$", "$1")]
    bad += [put(r"^.*([0-9]{2})([0-9]{2})([0-9]{4})$", "$1-$2 $3"), put(r"^.*([0-9])([0-9]{3})([0-9]{4})$", "$1-$2 $3"), F.concat(F.lit("00"), F.left(F.concat(d, d), F.lit(14))), F.concat(F.lit("000"), F.left(F.concat(d, d), F.lit(9)))]
    longer = F.left(F.concat(d, d), F.lit(16))  # of a longer number the first groups are no telephone number
    bad += [F.regexp_replace(longer, "([0-9]{4})(?=[0-9])", to) for to in ("$1.", "$1-", "$1 ", "$1/")]
    return good, bad


@dataclass
class Boosted:
    """Trees of two levels over integer features: (feature, cut, left, right), a side being a leaf value or a stump.

    precision and recall are those of the threshold on the held-out part of the training examples."""

    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = 2.0  # on the probability; above 1 selects nothing
    precision: float = 0.0
    recall: float = 0.0

    def raw(self, x: dict[str, int]) -> float:
        def walk(t) -> float:
            return t if isinstance(t, float) else walk(t[2] if x[t[0]] < t[1] else t[3])

        return self.base + sum(map(walk, self.trees))

    def column(self, x: dict[str, Column]) -> Column:
        """The probability; the features are worked out once."""

        def walk(v: Column, t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(v[t[0]] < t[1], walk(v, t[2])).otherwise(walk(v, t[3]))

        values = F.struct(*[c.cast("int").alias(n) for n, c in x.items()])
        return let(values, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, t: a + walk(v, t), self.trees, F.lit(self.base)))))


def boost(rows: list[tuple[dict[str, int], float, float]], rounds: int = 25, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """Gradient boosting of the logistic loss on (features, count, positives) rows. Without both classes: no tree."""
    total, good = sum(n for _, n, _ in rows), sum(p for *_, p in rows)
    share = min(1 - 1e-4, max(1e-4, good / total)) if total else 1e-4
    model = Boosted(math.log(share / (1 - share)))
    if not total or not 0 < good < total:
        return model
    names = sorted(rows[0][0])
    x = np.array([[r[0][f] for f in names] for r in rows])
    count, hits = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    bins = [np.unique(c, return_inverse=True) for c in x.T]
    scores = np.full(len(rows), model.base)
    worth = lambda a, b: a * a / (b + ridge)

    def best(part: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple | None:
        found = None
        for f, (values, place) in enumerate(bins):
            a, b = (np.cumsum(np.bincount(place[part], v[part], len(values))) for v in (g, h))
            n = np.cumsum(np.bincount(place[part], minlength=len(values)))
            gain = worth(a[:-1], b[:-1]) + worth(a[-1] - a[:-1], b[-1] - b[:-1]) - worth(a[-1], b[-1])
            gain = np.where((n[:-1] > 0) & (n[:-1] < n[-1]), gain, -1.0)
            if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > 1e-6 and (found is None or gain[k] > found[0] + 1e-12):
                found = (gain[k], f, int(values[k + 1]))
        return found and found[1:]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scores))
        g, h = hits - count * p, count * p * (1 - p)
        root = best(np.arange(len(rows)), g, h)
        if root is None:
            break
        value = lambda part: float(rate * g[part].sum() / (h[part].sum() + ridge))  # noqa: E731, B023

        def side(part: np.ndarray):
            cut = best(part, g, h)  # noqa: B023
            if cut is None:
                scores[part] += value(part)  # noqa: B023
                return value(part)  # noqa: B023
            low = x[part, cut[0]] < cut[1]
            for half in (part[low], part[~low]):
                scores[half] += value(half)  # noqa: B023
            return (names[cut[0]], cut[1], value(part[low]), value(part[~low]))  # noqa: B023

        low = x[:, root[0]] < root[1]
        model.trees.append((names[root[0]], root[1], side(np.flatnonzero(low)), side(np.flatnonzero(~low))))
    return model


def calibrate(model: Boosted, rows: list[tuple[dict[str, int], float, float]], precision: float, few: float = FEW, fallback: float = FALLBACK) -> Boosted:
    """Sets the lowest score of 0.5 or more at which held-out candidates (with one doubtful case added) reach the precision.

    Where they are too few to tell, fewer than `few` positives, or never reach it, the threshold is `fallback`; a model
    without trees, one that has seen no positives, selects nothing. precision and recall tell what the held-out ones give."""
    n = good = 0.0
    scored: dict[float, list[float]] = {}
    for x, count, positives in rows:
        at = scored.setdefault(1 / (1 + math.exp(-model.raw(x))), [0.0, 0.0])
        at[0] += count
        at[1] += positives
    every = sum(p for _, p in scored.values())
    model.threshold = fallback if model.trees else 2.0
    if every >= few:
        for s in sorted(scored, reverse=True):
            n, good = n + scored[s][0], good + scored[s][1]
            if s >= 0.5 and good / (n + 1) >= precision:
                model.threshold = s - 1e-9
    taken = [v for s, v in scored.items() if s >= model.threshold]
    n, good = sum(v[0] for v in taken), sum(v[1] for v in taken)
    model.precision, model.recall = good / n if n else 0.0, good / every if every else 0.0
    return model


def _example(kind: str, m: Column, y: Column, form: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(*[c.cast("int").alias(n) for n, c in features(kind, m).items()])).alias("x"), y.cast("int").alias("y"), form.cast("int").alias("form"))


def _examples(kind: str, at: Found) -> Column:
    """Of a document: its candidates as they stand (form -1, read as negative), and the candidates that stand where rewritten
    base spans do, with the number of the form that they are written in."""
    empty = F.array().cast("array<struct<kind:string,x:string,y:int,form:int>>")
    seen = F.transform(F.col(at.loose[kind]), lambda m: _example(kind, m, F.lit(0), F.lit(-1)))

    def rewritten(b: Column) -> Column:
        good, bad = disguises(kind, b["s"])
        made = F.array(*[F.struct(s.alias("s"), F.lit(y).alias("y"), F.lit(i).alias("form")) for y, part in ((1, good), (0, bad)) for i, s in enumerate(part)])

        def planted(v: Column) -> Column:
            whole, lo = F.concat(b["before"], v["s"], b["after"]), F.length(b["before"])
            hit = lambda m: (m["start"] < lo + F.length(v["s"])) & (m["end"] > lo)
            return F.transform(F.filter(matches(whole, LOOSE[kind])["spans"], hit), lambda m: _example(kind, m, v["y"], v["form"]))

        return F.flatten(F.transform(made, planted))

    return F.when(F.col(at.base[kind]).isNull(), empty).otherwise(F.concat(seen, F.flatten(F.transform(base_of(at, kind), rewritten))))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, precision: float = 0.95) -> dict[str, Boosted]:
    """A model per kind, from at most `sample` documents of at most 100 000 characters, chosen by a hash of their id.

    Every HELD-th form of rewriting is held out, whole: a model of the other forms is calibrated on those and on the
    candidates of one document in four, and tells what to expect of forms it hasn't seen; then all forms train the model
    that is used with that threshold. A candidate of the corpus that looks like a rewritten span to the first model is no
    example at all, since it may be what it looks like. Only counts per combination of binned features reach the driver.
    Rows without id or text teach nothing, of repeated ids one row counts; without base spans of a kind its model selects
    nothing; with few of them calibrate's fallback holds.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text").between(1, 100_000))
    found, at = with_matches(bounded_sample(src, "doc_id", sample))
    rows = found.select((fold(F.col("doc_id"), 4) == 3).alias("held"), F.explode(F.concat(*[_examples(k, at) for k in KINDS])).alias("c"))
    held = F.when(F.col("c.form") < 0, F.col("held")).otherwise(F.col("c.form") % HELD == HELD - 1)
    own = F.col("c.form") < 0
    counts = rows.groupBy("c.kind", held.alias("held"), own.alias("own"), "c.x").agg(F.count(F.lit(1)).alias("n"), F.sum("c.y").alias("y")).orderBy("kind", "held", "own", "x").collect()
    models = {}
    for k in KINDS:
        mine = {(h, o): [(json.loads(r["x"]), float(r["n"]), float(r["y"])) for r in counts if (r["kind"], r["held"], r["own"]) == (k, h, o)] for h in (False, True) for o in (False, True)}
        first = boost(mine[False, False])
        plain = {h: [r for r in mine[h, True] if first.raw(r[0]) < 0] for h in (False, True)}  # less than an even chance
        told = calibrate(boost(mine[False, False] + plain[False]), mine[True, False] + plain[True], precision)
        models[k] = boost(mine[False, False] + mine[True, False] + plain[False] + plain[True])
        models[k].precision, models[k].recall, models[k].threshold = told.precision, told.recall, told.threshold if models[k].trees else 2.0
    return models


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _clear_of(spans: str) -> Callable[[Column], Column]:
    return lambda taken: clear_of(taken, F.col(spans))


def _selects(kind: str, model: Boosted) -> Callable[[Column], Column]:
    return lambda m: model.column(features(kind, m)) >= model.threshold


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def find_spans(docs: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """docs with base_spans and all_spans: arrays of (kind, start, end) by kind as listed, then start.

    All base spans stay; a candidate joins where it overlaps no base span and none taken before, and its kind's model
    selects it. Null and empty texts have no spans; repeated rows are treated alike; columns of docs with these names are
    replaced. No shuffle, no Python.
    """
    names = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    out, at = with_matches(docs, text)
    kept: dict[str, str] = {}
    for k in KINDS:
        kept[k] = unused(out.columns, f"kept_{k}")
        if models[k].threshold > 1:
            out = out.withColumn(kept[k], F.array().cast(f"array<{_SPAN}>"))
            continue
        taken = F.concat(*[base_of(at, o) for o in KINDS], *[F.col(c) for o, c in kept.items() if o != k])
        free = F.when(F.size(at.loose[k]) == 0, F.col(at.loose[k])).otherwise(let(taken, _clear_of(at.loose[k])))
        out = out.withColumn(kept[k], F.filter(free, _selects(k, models[k])))
    base = F.concat(*[_tagged(k, base_of(at, k)) for k in KINDS])
    every = F.concat(*[F.sort_array(_tagged(k, F.concat(base_of(at, k), F.col(kept[k])))) for k in KINDS])
    return out.withColumns({"base_spans": base, "all_spans": every}).select(*[F.col(f"`{c}`") for c in names], "base_spans", "all_spans")


def spelled(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per document; the counts are of base spans.

    Repeated ids keep a row each; null text has no spans and the digest of the empty string.
    """
    models = fit(docs)
    found = find_spans(docs.select("doc_id", "text"), models)
    counts = [F.size(F.filter("base_spans", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled("base_spans").cast("binary"), 256).alias("base_sha256"), spelled("all_spans").alias("spans"))


def pieces(text: Column, spans: Column, chunk: int = 256) -> Column:
    """The substrings of a text at (start, end), linear in both: cut from the chunks that a span lies in."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))

    def cut(cs: Column) -> Column:
        def one(x: Column) -> Column:
            a, b = x["start"], x["end"]
            first = F.floor(a / chunk).cast("int")
            held = F.array_join(F.slice(cs, first + 1, F.floor((F.greatest(a, b - 1)) / chunk).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(held, a - first * chunk + 1, b - a)).otherwise("")

        return F.transform(spans, one)

    return let(chunks, cut)


def merged(spans: Column) -> Column:
    """(start, end, kind) of the union of the spans, named by the first of those that overlap."""

    def unite(every: Column) -> Column:
        def heads(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: (F.get(ends, i) <= F.get(every, i)["start"]))
            last = F.array_max(F.transform(every, lambda x: x["end"]))
            return let(first, lambda h: F.transform(h, lambda i, j: F.struct(F.get(every, i)["start"].alias("start"), F.coalesce(F.get(ends, F.get(h, j + 1)), last).alias("end"), F.get(every, i)["kind"].alias("kind"))))

        return let(let(F.transform(every, lambda x: x["end"]), lambda e: running(e, F.greatest)), heads)

    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return let(ordered, unite)


def redact(docs: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """docs whose texts have [KIND] in place of each span; overlapping spans become one, named by the first.

    Null texts stay null, texts without spans as they are; other columns stay; an empty table stays empty."""
    names = docs.columns
    found = find_spans(docs.withColumnsRenamed({c: unused(names, c) for c in names if c in ("base_spans", "all_spans")}), models, text)

    def rewrite(union: Column) -> Column:
        gaps = F.transform(union, lambda x, i: F.struct(F.when(i > 0, F.get(union, i - 1)["end"]).otherwise(F.lit(0)).alias("start"), x["start"].alias("end")))
        rest = F.array(F.struct(F.get(union, F.size(union) - 1)["end"].alias("start"), F.length(F.col(text)).alias("end")))
        between = let(F.concat(gaps, rest), lambda g: pieces(F.col(text), g))
        labels = F.concat(F.transform(union, lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))), F.array(F.lit("")))
        return F.array_join(F.zip_with(between, labels, lambda a, b: F.concat(a, b)), "")

    clean = F.when(F.size("all_spans") > 0, let(merged(F.col("all_spans")), rewrite)).otherwise(F.col(text))
    done = found.withColumn(text, clean)
    return done.select(*[F.col(f"`{unused(names, c) if c in ('base_spans', 'all_spans') else c}`").alias(c) for c in names])
