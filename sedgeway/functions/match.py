"""How one term matches a name: tier and score, as Column expressions.

Tiers: 0 the whole name or its stem, 1 its beginning, 2 the beginning of a word, 3 anywhere, 4 as a scattered
subsequence within a short window, 5 with one or two typing errors, 255 not at all. Regular expressions and
``locate`` decide; only names that passed a cheap test reach a higher-order function.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeway.plans.query import Term

NO_MATCH = 255

#: Scores of the fuzzy window. Fixed values.
MATCH, GAP_START, GAP_MORE = 16, -3, -1
BOUNDARY, NON_WORD, CAMEL, CONSECUTIVE, WHITE, DELIMITER = 8, 8, 7, 4, 10, 9
_CLASS_WHITE, _CLASS_NON_WORD, _CLASS_DELIMITER, _CLASS_LOWER, _CLASS_UPPER, _CLASS_LETTER, _CLASS_NUMBER = range(7)


def _quote(text: str) -> str:
    """A Java pattern for exactly ``text``."""
    return "".join(f"\\{c}" if c in r"\.[]{}()<>*+-=!?^$|#&~ /" else c for c in text)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


#: Patterns of the character classes after one another; what is left is no word. A class is coded by a private-use character.
_CLASS_PATTERNS = (
    (_CLASS_LOWER, r"\p{Ll}"), (_CLASS_UPPER, r"\p{Lu}"), (_CLASS_NUMBER, r"\p{Nd}"), (_CLASS_LETTER, r"\p{L}"),
    (_CLASS_WHITE, r"[ \t]"), (_CLASS_DELIMITER, r"[\\/,:;|_\-.]"), (_CLASS_NON_WORD, r"[^\uE000-\uE006]"),
)


def class_codes(name: Column) -> Column:
    """The classes of a name's characters, a coding character for each."""
    return reduce(lambda acc, kp: F.regexp_replace(acc, f"(?s){kp[1]}", chr(0xE000 + kp[0])), _CLASS_PATTERNS, name)


def _bonus(prev: Column, cls: Column) -> Column:
    edge = F.when(prev == _CLASS_WHITE, WHITE).when(prev == _CLASS_DELIMITER, DELIMITER).when(prev == _CLASS_NON_WORD, BOUNDARY)
    inner = (
        F.when(((prev == _CLASS_LOWER) & (cls == _CLASS_UPPER)) | ((prev != _CLASS_NUMBER) & (cls == _CLASS_NUMBER)), CAMEL)
        .when(cls.isin(_CLASS_NON_WORD, _CLASS_DELIMITER), NON_WORD).when(cls == _CLASS_WHITE, WHITE).otherwise(0)
    )
    return F.when((cls > _CLASS_NON_WORD) & (prev <= _CLASS_DELIMITER), edge).otherwise(inner)


def window_score(name: Column, folded: Column, text: str, start: Column, end: Column) -> Column:
    """Score of ``text`` matched from the left in characters start..end-1 (from 0). Only the classes of these characters and of the one before are looked up."""
    m = len(text)
    pattern = F.lit(text)

    def within(w: Column) -> Column:
        first = F.greatest(w["start"] - 1, F.lit(0))  # the character before, if there is one
        part = F.struct(w["start"].alias("start"), w["end"].alias("end"), first.alias("at"), class_codes(F.substring(name, first + 1, w["end"] - first)).alias("codes"), F.substring(folded, w["start"] + 1, w["end"] - w["start"]).alias("chars"))
        return _let(part, scored)

    def scored(w: Column) -> Column:
        def class_at(i: Column) -> Column:
            return F.ascii(F.substring(w["codes"], i - w["at"] + 1, F.lit(1))) - 0xE000

        zero = F.struct(
            F.lit(0).alias("p"), F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("first"), F.lit(False).alias("gap"),
            F.when(w["start"] > 0, class_at(w["start"] - 1)).otherwise(_CLASS_WHITE).alias("prev"),
        )

        def step(s: Column, i: Column) -> Column:
            return _let(F.struct(class_at(i).alias("cls"), (F.substring(w["chars"], i - w["start"] + 1, F.lit(1)) == F.substring(pattern, s["p"] + 1, F.lit(1))).alias("hit")), lambda c: advance(s, c["cls"], c["hit"]))

        def advance(s: Column, cls: Column, hit: Column) -> Column:
            def with_bonus(b: Column) -> Column:
                first = F.when((s["run"] == 0) | ((b >= BOUNDARY) & (b > s["first"])), b).otherwise(s["first"])
                worth = F.when(s["run"] == 0, b).otherwise(F.greatest(b, first, F.lit(CONSECUTIVE)))
                gain = MATCH + F.when(s["p"] == 0, worth * 2).otherwise(worth)
                return F.struct((s["p"] + 1).alias("p"), (s["score"] + gain).alias("score"), (s["run"] + 1).alias("run"), first.alias("first"), F.lit(False).alias("gap"), cls.alias("prev"))

            passed = F.struct(
                s["p"].alias("p"), (s["score"] + F.when(s["gap"], GAP_MORE).otherwise(GAP_START)).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("first"), F.lit(True).alias("gap"), cls.alias("prev")
            )
            return F.when(s["p"] >= m, s).when(hit, _let(_bonus(s["prev"], cls), with_bonus)).otherwise(passed)

        return F.aggregate(F.sequence(w["start"], w["end"] - 1), zero, step, lambda s: s["score"])

    return _let(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")), within)


_WORD_EDGE = r"(?:(?<=[ _\-.(\[{,;+@#~\\/])|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L}))"


def word_start(name: Column, text: str) -> Column:
    """Place (from 1) of the first occurrence at a word boundary, 0 if none."""
    return F.regexp_instr(name, F.lit(f"(?s){_WORD_EDGE}(?iu:{_quote(text)})"))


def subsequence_patterns(text: str) -> tuple[str, str]:
    """Java patterns that end a greedy scan for ``text``, and from there the scan back."""

    def scan(s: str) -> str:
        return "(?s)^" + "".join(f"[^{_quote(c)}]*{_quote(c)}" for c in s)

    return scan(text), scan(text[::-1])


def typo_distance(folded: Column, text: str, most: int) -> Column:
    """Least number of edits between ``text`` and any part of the name, ``most`` + 1 if it is more.

    Bit-parallel simulation of the automaton with up to ``most`` errors: shifts, ands and ors only.
    """
    m, last = len(text), 1 << (len(text) - 1)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    bits: dict[str, int] = {}
    for i, c in enumerate(text):
        bits[c] = bits.get(c, 0) | 1 << i
    zero = F.struct(*[F.lit((1 << d) - 1).cast("long").alias(f"r{d}") for d in range(most + 1)], F.lit(most + 1).alias("best"))

    def step(s: Column, c: Column) -> Column:
        def with_mask(mask: Column) -> Column:
            one = F.lit(1).cast("long")
            left = lambda x: F.shiftleft(x, 1)
            new: list[Column] = []
            def build(d: int) -> Column:
                """Nested lets, so that each register is computed once."""
                if d > most:
                    found = reduce(lambda acc, k: acc.when(new[k].bitwiseAND(F.lit(sign(last))) != 0, k), range(most + 1), F.when(F.lit(False), 0)).otherwise(most + 1)
                    return F.struct(*[r.alias(f"r{k}") for k, r in enumerate(new)], F.least(s["best"], found).alias("best"))
                r = left(s[f"r{d}"]).bitwiseOR(one).bitwiseAND(mask)
                if d:
                    r = r.bitwiseOR(s[f"r{d - 1}"]).bitwiseOR(left(s[f"r{d - 1}"])).bitwiseOR(left(new[d - 1])).bitwiseOR(one)

                def deeper(x: Column) -> Column:
                    new.append(x)
                    return build(d + 1)

                return _let(r, deeper)

            return build(0)

        mask = F.lit(0).cast("long")
        if bits:
            mask = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(sign(kv[1])).cast("long")), list(bits.items())[1:], F.when(c == list(bits)[0], F.lit(sign(bits[list(bits)[0]])).cast("long"))).otherwise(mask)
        return _let(mask, with_mask)

    return F.aggregate(F.split(folded, ""), zero, step, lambda s: s["best"]) if m else F.lit(0)


def wildcard_regex(text: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else _quote(c) for c in text) + "$"


def match(name: Column, folded: Column, term: Term, fuzzy: bool = True, typos: bool = False) -> tuple[Column, Column, Column]:
    """(whether it matches, tier, score) of a wildcard or plain term. The first is the cheapest to compute."""
    t, m = term.text, len(term.text)
    if term.kind == "wildcard":
        hit = folded.rlike(wildcard_regex(t))
        return hit, F.when(hit, 0).otherwise(NO_MATCH), F.lit(0)
    if term.kind == "path":
        return F.lit(False), F.lit(NO_MATCH), F.lit(0)
    hit = F.contains(folded, F.lit(t))
    subsequence = fuzzy and m >= 2
    if subsequence:
        ahead, back = subsequence_patterns(t)
        stop_of = F.length(F.regexp_extract(folded, ahead, 0))
        span_of = lambda stop: F.length(F.regexp_extract(F.reverse(F.substring(folded, F.lit(1), stop)), back, 0))
        hit = hit | ((F.locate(t, folded) == 0) & (stop_of > 0) & (span_of(stop_of) <= 2 * m + 3))
    with_typos = typos and term.allows_typos
    if with_typos:
        k = term.max_typos
        missing = reduce(lambda a, c: a + F.when(F.contains(folded, F.lit(c)), 0).otherwise(1), dict.fromkeys(t), F.lit(0))
        distance = F.when((missing <= k) & (F.length(folded) >= m - k), typo_distance(folded, t, k)).otherwise(k + 1)
        hit = hit | (distance <= k)

    # For the rows that pass, each piece is computed once, and only where the tier hangs on it.
    def placed(at: Column) -> Column:
        none = F.lit(0)
        stop = F.when(at == 0, stop_of).otherwise(0) if subsequence else none
        return _let(F.struct(at.alias("at"), F.when(at > 1, word_start(name, t)).otherwise(0).alias("edge"), stop.alias("stop")), spanned)

    def spanned(p: Column) -> Column:
        span = F.when(p["stop"] > 0, span_of(p["stop"])).otherwise(0) if subsequence else F.lit(0)
        return _let(F.struct(p["at"].alias("at"), p["edge"].alias("edge"), p["stop"].alias("stop"), span.alias("span")), judged)

    def judged(p: Column) -> Column:
        at, edge, stop, span = p["at"], p["edge"], p["stop"], p["span"]
        whole = (F.length(folded) == m) | (F.length(folded) - F.length(F.substring_index(folded, ".", -1)) - 1 == m)
        near = (stop > 0) & (span <= 2 * m + 3)
        tier = F.when(at == 1, F.when(whole, 0).otherwise(1)).when(at > 1, F.when(edge > 0, 2).otherwise(3)).when(near, 4)
        start = F.when(at == 1, 0).when(at > 1, F.when(edge > 0, edge - 1).otherwise(at - 1)).when(near, stop - span)
        end = F.when(at > 0, start + m).when(near, stop)
        score = F.when((at > 0) | near, window_score(name, folded, t, start, end))
        if not with_typos:
            return F.struct(tier.otherwise(NO_MATCH).alias("tier"), score.otherwise(0).alias("score"))
        far = F.when((at == 0) & ~near, distance).otherwise(k + 1)
        return _let(far, lambda d: F.struct(tier.when(d <= k, 5).otherwise(NO_MATCH).alias("tier"), score.when(d <= k, 100 - 30 * d).otherwise(0).alias("score")))

    best = _let(F.locate(t, folded), placed)
    return hit, best["tier"], best["score"]


def highlight_ranges(name: str, terms: list[str]) -> list[tuple[int, int]]:
    """(start, length) of what plain ``terms`` mark in ``name``; for the rows of a result page."""
    low = name.lower() if len(name.lower()) == len(name) else "".join(c.lower() if len(c.lower()) == 1 else c for c in name)
    marked: set[int] = set()
    for t in terms:
        places = [m.start() for m in re.finditer(f"(?={re.escape(t)})", low)] if t else []
        if places:
            best = next((p for p in places if is_word_start(name, p)), places[0])
            marked |= set(range(best, best + len(t)))
        elif 0 < len(t) <= 64 and (span := subsequence_span(low, t)):
            p = 0
            for i in range(*span):
                if p < len(t) and low[i] == t[p]:
                    marked.add(i)
                    p += 1
    out: list[tuple[int, int]] = []
    for i in sorted(marked):
        if out and sum(out[-1]) == i:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((i, 1))
    return out


def is_word_start(name: str, at: int) -> bool:
    if at <= 0:
        return True
    a, b = name[at - 1], name[at]
    return a in " _-.([{,;+@#~\\/" or (a.islower() and b.isupper()) or (a.isalpha() and b.isdecimal()) or (a.isdecimal() and b.isalpha())


def subsequence_span(low: str, text: str) -> tuple[int, int] | None:
    """The window of a greedy scan for ``text``, tightened from its end."""
    at = -1
    for c in text:
        at = low.find(c, at + 1)
        if at < 0:
            return None
    end = stop = at + 1
    for c in reversed(text):
        stop = low.rfind(c, 0, stop)
    return stop, end
