"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary ones.

Three kinds of base spans are found by pattern: ``assign`` (a keyword, a separator and a value of 8 or more
characters), ``access`` (AKIA and at least 12 more capitals or digits) and ``hex`` (32 or more lower-case
hexadecimal digits). The method adds ``random``: a token of 20 or more characters, outside the base spans,
whose letters, digits and signs are likelier under a second-order character model of random strings than
under one of ordinary identifiers, by the log-likelihood ratio of the whole token and for each character.

Both models are trained when they are first needed, from labelled samples: seeded random strings (of
hexadecimal, base-36, base-62 and base-64 digits), and ordinary ones: identifiers put together from common words in
the usual styles, long words made of those of four languages, numbers, dates, rulers. Nothing is taken from the corpus.

Defined cases: a null or empty text has no secrets; repeated rows are judged one by one; an empty table gives
no rows; offsets are in code points, ends exclusive; a text may be
of any length; input columns pass through and new columns replace those of the same names.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow
from sedgeway.runtime import table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
#: Log-likelihood ratio (nats) that a token needs, in all and for each character.
MIN_RATIO = 12.0
MIN_PER_CHAR = 0.35
SAMPLES = 6000
SEED = 20240611
#: Words that ordinary identifiers are made of. Fixed values.
IDENTIFIER_WORDS = """
account action active address agent alert amount application argument array assert async author backup base batch
begin binary block board branch buffer build button cache call category channel character check child class client
close cluster code collection color column command comment commit component config connection container content
context control copy count create current customer data database date debug default delete description detail
device dictionary directory document domain driver element email enable encoding entry environment error event
example exception execute export factory feature field file filter find folder format frame function generate
global graph group handler header height history host identifier image import index information input instance
integer interface internal item iterator journal kernel language layer length level library license limit line
list load local location logger machine manager mapping master maximum memory message metadata method minimum
model module monitor name network node notification number object offset operation option order output package page
parameter parent parser partition path pattern payment performance permission pipeline platform player plugin
pointer position prefix process product profile project property provider query queue random range reader record
reference region register release remote report request resource response result schedule schema screen script
search section security segment selector sequence server service session setting shared signal simple snapshot
source stack standard start state status storage stream string structure style submit summary support switch
symbol system table target task template terminal test text thread timeout timestamp title total transaction
transfer tree trigger type unique update upload user utility validate value variable vector version video view
volume warning widget width window worker wrapper
""".split()

#: Words of ordinary prose in four languages. Fixed values.
PROSE_WORDS = """
about after again because before between could different every found great house little might never other people
place point right should small something still their there these thing think three through under water where which
while without world would write years action mention nation station tionally measurement government possible visible
aber alle andere arbeit auch bericht dieser einheit einige entwicklung erde freiheit geschichte gesellschaft haben
heiter immer jahr kein keit klein leben lichkeit machen mensch möglich nicht noch ordnung pflicht recht sagen schaft
schule sicherheit sprache stadt strecke tätigkeit ungen unter verbindung verein wahrheit weiter wirtschaft zeit zurück
alors autre avant avec beau beaucoup bien chaque comme dans depuis deux donc eaux elle encore entre faire femme gauche
homme jour leur lieu maintenant mieux moment monde nouveau oiseau plus pourquoi quatre quelle question raison toujours
antes aunque bueno cada ciudad como cosa cuando donde ejemplo entonces estado forma gente hombre lugar manera mejor
mientras mismo mucho mundo mujer nuestro nunca palabra parte pero persona poder porque primero pueblo queria siempre
""".split()

_ALPHABETS = {
    "0123456789abcdef": 4,
    "0123456789ABCDEF": 1,
    "0123456789abcdefghijklmnopqrstuvwxyz": 2,
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": 1,
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": 4,
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": 3,
}


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """``n`` random strings (label 1) and ``n`` ordinary ones (label 0)."""
    rng = random.Random(seed)
    alphabets = [a for a, k in _ALPHABETS.items() for _ in range(k)]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), 1) for _ in range(n)]

    def ordinary() -> str:
        ws = rng.choices(IDENTIFIER_WORDS, k=rng.randint(2, 6))
        digits = lambda a, b: "".join(rng.choices("0123456789", k=rng.randint(a, b)))
        style = rng.randrange(14)
        if style > 10:
            s = "".join(w for w in rng.choices(PROSE_WORDS, k=rng.randint(3, 7)) if w.isascii())
            return s.title() if rng.random() < 0.2 else s.upper() if rng.random() < 0.1 else s
        if style < 6:
            s = [
                lambda: "_".join(ws), lambda: "-".join(ws), lambda: ws[0] + "".join(w.title() for w in ws[1:]),
                lambda: "".join(w.title() for w in ws), lambda: "_".join(ws).upper(), lambda: "/".join(ws),
            ][style]()
            return s + (rng.choice(["", "_", "-"]) + digits(1, 4) if rng.random() < 0.3 else "")
        if style == 6:
            return "".join(ws)
        if style == 7:
            return digits(8, 40)
        if style == 8:
            return f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-{'-'.join(ws)}"
        if style == 9:
            return "-".join(digits(2, 5) for _ in range(rng.randint(4, 8)))
        return rng.choice("=-_") * rng.randint(20, 60)

    return out + [(ordinary(), 0) for _ in range(n)]


_CLASS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")}
_N = len(_CLASS)


class Markov:
    """Log-probabilities of a character after the two before it, backed off to one and none."""

    def __init__(self, samples: list[str], weight: float = 4.0):
        one, two, three = [0] * _N, {}, {}
        for s in samples:
            code = [_CLASS[c] for c in s]
            for i, c in enumerate(code):
                one[c] += 1
                if i:
                    two[code[i - 1], c] = two.get((code[i - 1], c), 0) + 1
                if i > 1:
                    three[code[i - 2], code[i - 1], c] = three.get((code[i - 2], code[i - 1], c), 0) + 1
        total = sum(one)
        self.p1 = [(x + 1) / (total + _N) for x in one]
        sum2, sum3 = [0] * _N, {}
        for (a, _), n in two.items():
            sum2[a] += n
        for (a, b, _), n in three.items():
            sum3[a, b] = sum3.get((a, b), 0) + n
        self.two, self.three, self.sum2, self.sum3, self.weight = two, three, sum2, sum3, weight

    def log_likelihood(self, s: str) -> float:
        w, total, a, b = self.weight, 0.0, None, None
        for ch in s:
            c = _CLASS[ch]
            p = self.p1[c]
            if b is not None:
                p = (self.two.get((b, c), 0) + w * p) / (self.sum2[b] + w)
            if a is not None:
                p = (self.three.get((a, b, c), 0) + w * p) / (self.sum3.get((a, b), 0) + w)
            total += math.log(p)
            a, b = b, c
        return total


class RandomStrings:
    """The log-likelihood ratio of the two models."""

    def __init__(self, samples: list[tuple[str, int]]):
        self.random = Markov([s for s, y in samples if y])
        self.ordinary = Markov([s for s, y in samples if not y])

    def ratio(self, s: str) -> float:
        return self.random.log_likelihood(s) - self.ordinary.log_likelihood(s)

    def is_secret(self, s: str) -> bool:
        return (r := self.ratio(s)) >= MIN_RATIO and r >= MIN_PER_CHAR * len(s)


@lru_cache(maxsize=1)
def model() -> RandomStrings:
    return RandomStrings(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    out = []
    low = text.lower()
    # The long s and the Kelvin sign are no ASCII letters; str.lower can only add places to look at.
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def method_spans(text: str, base: list[tuple[int, int, int]], judge: RandomStrings) -> list[tuple[int, int, int]]:
    """The tokens outside ``base`` that look random."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        s = m.group()
        if judge.is_secret(s):
            out.append((a, 3, b))
    return out


def all_spans(text: str, judge: RandomStrings) -> list[tuple[int, int, int]]:
    """Those of the patterns and of the method, in order."""
    base = base_spans(text)
    return sorted(base + method_spans(text, base, judge))


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``, an array of (kind, start, end) by start, then kind."""
    added = T.StructType([T.StructField("secrets", T.ArrayType(_SPAN))])

    def make():
        judge = model()
        one = lambda t: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t, judge)]
        return lambda batch: {"secrets": [one(t or "") for t in batch.column(text).to_pylist()]}

    return map_arrow(df, text, make, added)


def _marked(text: str | None, places: list[tuple[int, int]], mark: str) -> str | None:
    """``text`` with each run of overlapping places, in order of their starts, replaced by ``mark``."""
    if not places:
        return text
    out, at = [], 0
    for a, b in places:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each run of overlapping spans of ``secrets`` in ``text`` replaced by ``mark``; null texts stay null."""
    field = T.StructType([T.StructField(text, T.StringType())])

    def make():
        places = lambda spans: sorted((s["start"], s["end"]) for s in spans or ())
        return lambda batch: {text: [_marked(t, places(s), mark) for t, s in zip(batch.column(text).to_pylist(), batch.column("secrets").to_pylist())]}

    order = df.columns
    return map_arrow(df, text, make, field).select(*order)


def find_and_redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` redacted by what ``find_secrets`` finds, in one pass: each task takes one Python worker, where the two calls one after the other take two."""
    field = T.StructType([T.StructField(text, T.StringType())])

    def make():
        judge = model()
        return lambda batch: {text: [_marked(t, [(a, b) for a, _, b in all_spans(t or "", judge)], mark) for t in batch.column(text).to_pylist()]}

    order = df.columns
    return map_arrow(df, text, make, field).select(*order)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
