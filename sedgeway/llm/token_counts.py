"""Token counts of texts by a public tokenizer with word ends, without a shuffle.

A text is split into pre-tokens, and its count is the sum of theirs. Lookup has two tiers. The first is a broadcast
table of the lengths of frequent pre-tokens: the vocabulary's own whole words, which are what the merges found most
often (each is encoded once on the driver, so its length is exact). The second, for misses, is a table in each worker
process of what it has encoded before, emptied when it has ``MEMO`` entries; a miss there is encoded. Neither table
changes a count.

Splitting follows the tokenizer's own steps: its special strings first, then NFC, lower case and its pattern. Texts of
``PLAIN`` characters, on which all Unicode versions agree, are split by one regular expression; any other text goes through
the tokenizer's normalizer and pre-tokenizer.

Defined cases: a null text is the empty text, with no tokens; texts and pre-tokens of any length are counted whole; a
special string inside a text counts as one token, as is the library's default; no begin or end tokens. Other columns pass
through; new ones replace those of the same names. The file must be of at most ``MAX_VOCABULARY`` bytes, as it is broadcast.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from unicodedata import is_normalized, normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow, tokenizer_path
from sedgeway.runtime import table

NAME = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Pre-tokens whose lengths a worker remembers, and the longest that it keeps.
MEMO, LONGEST = 1 << 18, 64
MAX_VOCABULARY = 64 << 20
#: Characters whose class, case and composition are the same in all versions of Unicode since 3.0; no sigma, whose lower case depends on its place.
PLAIN = r"[\t-\r -~\x85\xa0-ȗ̀-̷΄-ΊΌΎ-ΡΤ-ώЁ-ЌЎ-яё-ќў-ҁא-תء-غ‐-‧‰-⁆₠-₪、-〃ぁ-ゔァ-ヺ一-龥가-힣！-～]*"


@dataclass
class Counts:
    """What every worker gets: the tokenizer's file, its pattern and special strings, and the lengths of frequent pre-tokens."""

    file: str
    pattern: str
    specials: tuple[str, ...]
    words: str  # joined by spaces
    lengths: bytes


def _letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


def _encode(tokenizer):
    """The function from a pre-token to the number of its tokens."""
    tokenize, letters = tokenizer.model.tokenize, _letters()
    other = re.compile(r"[^!-~]").search

    def find(token: str) -> int:
        return len(tokenize("".join(map(letters.__getitem__, token.encode())) if other(token) else token))

    return find


def prepare(file: str) -> Counts:
    """``Counts`` from the text of a tokenizer file of this kind; ValueError for any other."""
    import regex
    from tokenizers import Tokenizer

    data = json.loads(file)
    steps = [x["type"] for x in (data.get("normalizer") or {}).get("normalizers", [])]
    split, *rest = (data.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = data["model"]
    if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split.get("invert") or [x["type"] for x in rest] != ["ByteLevel"] or model.get("type") != "BPE" or any(x["normalized"] for x in data["added_tokens"]):
        raise ValueError("no tokenizer of this kind: NFC, spaces, lower case, a pattern of pre-tokens, bytes, merges")
    pattern, end = split["pattern"]["Regex"], model["end_of_word_suffix"]
    back = {v: k for k, v in _letters().items()}
    whole = regex.compile(pattern).fullmatch
    words = []
    for entry in model["vocab"]:
        if entry.endswith(end):
            try:
                word = bytes(map(back.__getitem__, entry[: -len(end)])).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if whole(word):
                words.append(word)
    lengths = bytes(map(_encode(Tokenizer.from_str(file)), words))  # one byte each: an entry has 255 bytes at most
    return Counts(file, pattern, tuple(x["content"] for x in data["added_tokens"]), " ".join(words), lengths)


class _Lengths(dict):
    """Both tiers in one table: the frequent pre-tokens, and up to ``limit`` that this process has encoded; when full it goes back to the former. Long ones are not kept."""

    def __init__(self, frequent: dict[str, int], find, limit: int):
        super().__init__(frequent)
        self.frequent, self.find, self.most = frequent, find, len(frequent) + limit

    def __missing__(self, token: str) -> int:
        n = self.find(token)
        if len(token) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[token] = n
        return n


class Counter:
    def __init__(self, counts: Counts, memo: int = MEMO):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(counts.file)
        self.plain = re.compile(PLAIN).fullmatch
        self.split = regex.compile(counts.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(counts.specials, key=len, reverse=True))) or r"(?!)")
        self.lengths = _Lengths(dict(zip(counts.words.split(" "), counts.lengths)), _encode(self.tokenizer), memo)
        self.bytes_of = {v: k for k, v in _letters().items()}

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.plain(text):
            return self.split((text if is_normalized("NFC", text) else normalize("NFC", text)).lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [bytes(map(self.bytes_of.__getitem__, t)).decode() for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.lengths.__getitem__, self.pre_tokens(p))) for p in parts if p)


#: The counter of this worker process and what it is for; later tasks go on with what it remembers.
_counter: list = [None, None]


def counter_for(counts) -> Counter:
    """This process's counter for a broadcast ``Counts``."""
    if _counter[0] is not counts.value:
        _counter[:] = [counts.value, Counter(counts.value)]
    return _counter[1]


def load(spark, path: str | None = None):
    """The tokenizer at ``path`` (read by the driver) with its table, as a broadcast; its size is checked."""
    import os

    path = path or tokenizer_path(NAME)
    if (size := os.path.getsize(path)) > MAX_VOCABULARY:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY} are broadcast")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(prepare(f.read()))


def with_counts(df: DataFrame, counts, text: str = "text", max_tokens: int = MAX_TOKENS, keep: bool = True) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``max_tokens``)."""
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        count = counter_for(counts).count

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text)
            found = [count(t) if t else 0 for t in texts.to_pylist()]
            return {"n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), "n_tokens": found, "over_limit": [n > max_tokens for n in found]}

        return work

    return map_arrow(df, text, make, added, keep)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_counts(docs, load(spark), keep=False)
