"""Byte-level BPE encoding and decoding with a public vocabulary.

Each match of the split pattern is a pre-token. Its lookup has two tiers: a minimal perfect hash over all
vocabulary entries resolves a pre-token that is itself an entry; any other is merged from its bytes, which
stand in a doubly linked list while a heap yields the pair of lowest rank, leftmost first. Results are kept
in a table of ``MEMO`` pre-tokens in each worker process, emptied when full; it only saves repeated work.

Decoding maps ids to their bytes through the table in which the perfect hash stores the entries.

Defined cases: a null text is the empty text, with no ids; texts and pre-tokens of any length are encoded
whole (a pre-token of n bytes in n log n steps); special tokens' strings are ordinary text. Input columns
pass through; ``ids`` and ``n_tokens`` replace columns of these names. Decoding an id outside the
vocabulary raises an error; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow, tokenizer_path
from sedgeway.runtime import table

#: Pre-tokens whose ids a task remembers.
MEMO = 1 << 18
#: Bytes of a vocabulary file at most, as it is broadcast.
MAX_VOCABULARY = 64 << 20


class PerfectHash:
    """Minimal perfect hash of byte strings: every key has a slot of its own in 0..n-1.

    Keys fall into buckets by one part of their hash; each bucket, largest first, gets the least
    displacement that sends all its keys to free slots.
    """

    def __init__(self, keys: Sequence[bytes], seed: int = 0):
        n = self.n = len(keys)
        self.seed = seed
        self.buckets = max(1, n // 4)
        hashes = [xxhash.xxh3_128_intdigest(k, seed) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[(h & 0xFFFFFFFF) % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, dtype=np.uint32)
        slots = np.full(max(n, 1), -1, dtype=np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if not groups[b]:
                break
            x = np.array([(hashes[i] >> 32) & 0xFFFFFFFF for i in groups[b]], dtype=np.uint64)
            y = np.array([((hashes[i] >> 64) | 1) & 0xFFFFFFFFFFFFFFFF for i in groups[b]], dtype=np.uint64)
            start, many = 0, 16
            while True:
                d = np.arange(start, start + many, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B1)
                at = (((x + d) * y) >> np.uint64(24)) % np.uint64(n)
                fits = (slots[at.astype(np.int64)] < 0).all(axis=1)
                if len(x) > 1:
                    fits &= (np.diff(np.sort(at, axis=1), axis=1) != 0).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    break
                start, many = start + many, min(many * 8, 1 << 15)
                if start > 256 * n + 65536:
                    raise ValueError("two keys have equal hashes")
            self.shift[b] = start + k
            slots[at[k].astype(np.int64)] = groups[b]
        self.order = slots[:n]

    def slot(self, key: bytes) -> int:
        """The key's slot; some slot for a string that is no key."""
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = int(self.shift[(h & 0xFFFFFFFF) % self.buckets])
        return (((((h >> 32) & 0xFFFFFFFF) + d * 0x9E3779B1) * ((h >> 64) | 1) & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 bytes and a number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@dataclass
class Vocabulary:
    """Entries with their ids, in the slots of a perfect hash."""

    pattern: str
    hash: PerfectHash
    entries: list[bytes]
    ids: list[int]

    @classmethod
    def build(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        keys = list(ranks)
        found = PerfectHash(keys)
        entries = [keys[i] for i in found.order]
        return cls(pattern, found, entries, [ranks[k] for k in entries])


class _Memo(dict):
    """Ids of pre-tokens met before; emptied when full. Long pre-tokens are not kept."""

    def __init__(self, find, limit: int):
        super().__init__()
        self.find, self.limit = find, limit

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.find(token)
        if len(token) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[token] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        import regex

        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.shift = vocabulary.hash.shift.tolist()
        self.bytes_of = dict(zip(vocabulary.ids, vocabulary.entries))
        self.pair_rank = dict(zip(vocabulary.entries, vocabulary.ids)).get
        self.memo = _Memo(self.piece_ids, memo)

    def rank(self, piece: bytes) -> int | None:
        """Tier one: the id of a piece that is an entry, by the perfect hash and one comparison."""
        v = self.v
        p = v.hash
        h = xxhash.xxh3_128_intdigest(piece, p.seed)
        d = self.shift[(h & 0xFFFFFFFF) % p.buckets]
        at = (((((h >> 32) & 0xFFFFFFFF) + d * 0x9E3779B1) * ((h >> 64) | 1) & 0xFFFFFFFFFFFFFFFF) >> 24) % p.n
        return v.ids[at] if v.entries[at] == piece else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: the ids of a piece that is no entry."""
        n = len(piece)
        rank = self.pair_rank
        after = list(range(1, n + 1))  # start of the next part; n past the last
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, end = pop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue  # a part of this pair has changed since
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                stop = after[end]
                if (r := rank(piece[i:stop])) is not None:
                    push(heap, (r, i, stop))
            if (k := before[i]) >= 0 and (r := rank(piece[k:end])) is not None:
                push(heap, (r, k, end))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : after[i]]))
            i = after[i]
        return tuple(out)

    def piece_ids(self, token: str) -> tuple[int, ...]:
        piece = token.encode()
        r = self.rank(piece)
        return (r,) if r is not None else self.merge(piece)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: The encoder of this worker process and the vocabulary it is for; later tasks go on with what it remembers.
_encoder: list = [None, None]


def encoder_for(vocabulary, memo: int = MEMO) -> Encoder:
    """This process's encoder for a broadcast vocabulary, remembering ``memo`` pre-tokens."""
    if _encoder[0] is not vocabulary.value or _encoder[1].memo.limit != memo:
        _encoder[:] = [vocabulary.value, Encoder(vocabulary.value, memo)]
    return _encoder[1]


def load(spark, path: str | None = None, pattern: str | None = None):
    """The vocabulary at ``path`` (read by the driver) as a broadcast, its size checked."""
    import os

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or tokenizer_path()
    if (size := os.path.getsize(path)) > MAX_VOCABULARY:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY} are broadcast")
    with open(path, "rb") as lines:
        return spark.sparkContext.broadcast(Vocabulary.build(read_ranks(lines), pattern))


def encode(df: DataFrame, vocabulary, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) and ``n_tokens``."""
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def make():
        encoder = encoder_for(vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            found = [np.array(encoder.encode(t or ""), dtype=np.int32) for t in batch.column(text).to_pylist()]
            sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            return {"n_tokens": pa.array(sizes.astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

        return work

    return map_arrow(df, text, make, added)


def decode(df: DataFrame, vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of ``ids``."""
    added = T.StructType([T.StructField("decoded", T.BinaryType())])

    def make():
        encoder = encoder_for(vocabulary)
        return lambda batch: {"decoded": [encoder.decode(x or ()) for x in _lists(batch, ids)]}

    return map_arrow(df, ids, make, added)


def _lists(batch: pa.RecordBatch, column: str) -> Iterator[list[int]]:
    return (x.as_py() for x in batch.column(column))


def digests(df: DataFrame, vocabulary, text: str = "text", keep_ids: bool = False, memo: int = MEMO, keep: bool = True) -> DataFrame:
    """``df`` (unless ``keep``, without ``text``) with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and ``ids``): encoded, then decoded from the ids, in one pass. A worker remembers ``memo`` pre-tokens."""
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    added = T.StructType([*ids_field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        encoder = encoder_for(vocabulary, memo)
        decimal = {i: str(i) for i in encoder.bytes_of}
        sha = hashlib.sha256

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for t in batch.column(text).to_pylist():
                ids = encoder.encode(t or "")
                out["n_tokens"].append(len(ids))
                if keep_ids:
                    out["ids"].append(np.array(ids, dtype=np.int32))
                out["ids_sha256"].append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(sha(encoder.decode(ids)).hexdigest())
            return out

        return work

    return map_arrow(df, text, make, added, keep)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, load(spark)).drop("text")
