"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton in folded text.

Folding lower-cases, replaces look-alike letters of other scripts and digits or signs put for letters
(1d10t, sсum), drops marks inside words and turns all else into single spaces. Lexicon entries are whole
words and beginnings of words; exception phrases are pairs of neighbouring words in which an entry does
not count. A text's evidence is the sum of the weights of what matched, alone and by length; a logistic
function of it, fitted to the labels, is the score.

Everything is learned from labelled rows that are not held out: a row's crc32 of its id in decimal, mod 5,
is 0 where it is held out. ``fit`` sees at most ``MAX_ROWS`` such rows of each label, those of the least
hash of the id, and the shares of the labels among all of them. Entries are the words, and beginnings of 4 to 9 letters, that at
least ``MIN_TOXIC`` toxic rows hold and whose log-odds reach ``MIN_WEIGHT``; a beginning is only kept where
it does better than the words it would cover. Exceptions are pairs whose entry occurs with them in
``MIN_CLEAN`` or more clean rows and hardly in toxic ones.

Defined cases: a null or empty text scores as one without any match; texts are scored whole; labels other
than 0 and 1, and rows without a label, are not learned from; repeated rows count as often as they occur;
with no labels of both kinds every score is the share of toxic rows (0 if none). Input columns pass
through; ``score`` and ``predicted`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow
from sedgeway.runtime import table

MAX_ROWS = 6_000
MIN_TOXIC = 8
MIN_CLEAN = 5
MIN_WEIGHT = 2.5
#: Labelled rows with longer texts are not learned from, so that the sample has at most 2 * MAX_ROWS * MAX_CHARS characters.
MAX_CHARS = 20_000

#: Letters of other scripts that look like a Latin one. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӓ": "ä",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ｌ": "l",
}
#: Digits and signs written for letters, inside a word that has letters too. Fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_FOLD: dict[int, str] = {ord(a): b for a, b in HOMOGLYPHS.items()}
_FOLD |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0x1D400, 0x1D6A4) if unicodedata.normalize("NFKC", chr(c)).isascii()}


class _Letters(dict):
    """Folded letters by code point; a space for all else."""

    def __missing__(self, c: int) -> str:
        self[c] = chr(c) if chr(c).isalpha() else " "
        return self[c]


_LETTERS = _Letters(_FOLD)
_SIGN = re.compile(r"[0-9@$!]")
_MIXED = re.compile(r"[^\W_]*[0-9@$!][^\W_0-9]*(?:[^\W_]|[0-9@$!])*")
_DIGITS = str.maketrans(DIGITS)


def _word(m: re.Match) -> str:
    """A word with digits or signs inside as it was meant; signs at its end and plain numbers stay."""
    w = m.group().rstrip("@$!")
    return w.translate(_DIGITS) + m.group()[len(w) :] if any(c.isalpha() for c in w) else m.group()


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    low = text.lower()
    if _SIGN.search(low):
        low = _MIXED.sub(_word, low)
    return f" {' '.join(low.translate(_LETTERS).split())} "


def stems(word: str) -> Iterable[str]:
    """Entries that a word could match: itself, and its beginnings."""
    yield f" {word} "
    for n in range(4, min(9, len(word)) + 1):
        yield f" {word[:n]}"


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (entry, w))
        a.make_automaton()
        return a


def matches(folded: str, automaton) -> list[tuple[int, str, float]]:
    """(start of the word, entry, weight): the weightiest entry at each word."""
    best: dict[int, tuple[str, float]] = {}
    for end, (entry, w) in automaton.iter(folded):
        start = end + 1 - len(entry)
        if start not in best or w > best[start][1]:
            best[start] = (entry, w)
    return [(s, e, w) for s, (e, w) in sorted(best.items())]


def _neighbours(folded: str, start: int) -> tuple[str, str]:
    """The words before and after the one that follows the space at ``start``."""
    before = folded[:start].rpartition(" ")[2] if start else ""
    end = folded.find(" ", start + 1)
    after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
    return before, after


def evidence(folded: str, lexicon: Lexicon, automaton) -> tuple[float, float, float]:
    """Sum of weights, sum of weights by length, heaviest weight."""
    total = most = 0.0
    if len(lexicon.weights):
        for start, entry, w in matches(folded, automaton):
            if lexicon.exceptions:
                before, after = _neighbours(folded, start)
                if ("<" + before, entry) in lexicon.exceptions or (">" + after, entry) in lexicon.exceptions:
                    continue
            total += w
            most = max(most, w)
    n = max(1, folded.count(" ") - 1)
    return math.log1p(total), total / math.sqrt(n), most


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: Iterable[tuple[str | None, int]], prior_odds: float | None = None) -> Lexicon:
    """The lexicon, its exceptions and the scoring function from (text, label) rows; ``prior_odds`` of toxic rows, if not theirs."""
    data = [(fold(t or ""), int(y)) for t, y in rows]
    n = Counter(y for _, y in data)
    odds = prior_odds if prior_odds is not None else n[1] / max(1, n[0])
    if not n[0] or not n[1]:
        return Lexicon(coefficients=(math.log(odds + 1e-9) if n[0] or n[1] else -20.0, 0.0, 0.0, 0.0))
    toxic_rows: Counter[str] = Counter()
    for text, y in data:
        if y:
            toxic_rows.update({s for w in set(text.split()) for s in stems(w)})
    seen = {e: [0, k] for e, k in toxic_rows.items() if k >= MIN_TOXIC}
    for text, y in data:
        if not y:
            for entry in {s for w in set(text.split()) for s in stems(w) if s in seen}:
                seen[entry][0] += 1
    weight = {}
    for entry, (clean, toxic) in seen.items():
        w = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
        if w >= MIN_WEIGHT:
            weight[entry] = w
    # A beginning must beat every longer entry that it covers, in toxic rows or in weight; else the longer ones stand.
    kept: dict[str, float] = {}
    above: dict[str, float] = {}  # beginning of a kept entry: greatest weight below it
    for entry in sorted(weight, key=lambda e: (-seen[e][1] * weight[e], -len(e), e)):
        beginnings = [entry[:n] for n in range(1, len(entry) + 1)]
        if not any(b in kept for b in beginnings) and above.get(entry, 0.0) < weight[entry]:
            kept[entry] = weight[entry]
            for b in beginnings:
                above[b] = max(above.get(b, 0.0), weight[entry])
    lexicon = Lexicon(kept)
    automaton = lexicon.automaton()
    pairs: dict[tuple[str, str], list[int]] = {}
    for text, y in data:
        if kept:
            for start, entry, _ in matches(text, automaton):
                before, after = _neighbours(text, start)
                for k in {("<" + before, entry), (">" + after, entry)}:
                    pairs.setdefault(k, [0, 0])[y] += 1
    lexicon.exceptions = frozenset(k for k, (clean, toxic) in pairs.items() if clean >= MIN_CLEAN and clean > 10 * toxic and len(k[0]) > 1)
    x = np.array([evidence(t, lexicon, automaton) for t, _ in data])
    w = _logistic(x, np.array([y for _, y in data], dtype=float))
    w[0] += math.log(max(odds, 1e-9)) - math.log(n[1] / n[0])
    lexicon.coefficients = tuple(w.tolist())
    return lexicon


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Lexicon:
    """``fit`` on labelled rows that are not held out, ``max_rows`` of each label at most (those of the least hash of the id).

    Of rows that share an id the least text counts, rows without an id and texts of over ``MAX_CHARS`` don't.
    """
    y = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    n = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}  # two rows
    chosen = None
    for k in (0, 1):
        part = y.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    short = docs.filter(F.length(F.coalesce(F.col(text), F.lit(""))) <= MAX_CHARS).select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    sample = short.join(F.broadcast(chosen.distinct()), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))  # broadcast: 2 * max_rows rows of two numbers
    rows = sorted(sample.collect(), key=lambda r: (str(r["_id"]), r["_y"]))  # 2 * max_rows short texts
    return fit(((r["_t"], r["_y"]) for r in rows), n.get(1, 0) / max(1, n.get(0, 0)))


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # entries of at most 2 * MAX_ROWS short texts
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        lex = shared.value
        automaton = lex.automaton()
        bias, *w = lex.coefficients

        def one(t: str) -> float:
            z = bias + sum(a * b for a, b in zip(w, evidence(fold(t), lex, automaton)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        def work(batch: pa.RecordBatch) -> dict:
            s = [one(t or "") for t in batch.column(text).to_pylist()]
            return {"score": s, "predicted": [int(x >= 0.5) for x in s]}

        return work

    return map_arrow(df, text, make, added)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn(docs, labels)
    return score(docs.select("doc_id", "text"), lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
