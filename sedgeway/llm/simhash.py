"""SimHash near-duplicate groups by the general pigeonhole principle.

Fingerprints: the 64-bit XXH64 values of a text's word shingles vote on each bit. ``near_groups`` links
texts whose fingerprints differ in ``max_distance`` bits or fewer; a group is what links connect.

Search: the 64 bits are dealt to m parts so that correlated bits share a part, and the parts get thresholds
of -1 (unused), 0, 1 or 2 that sum to max_distance - m + 1. Two fingerprints within max_distance are then
within the threshold of some part. Grouping uses the co-occurrence counts of all pairs of bits over all
distinct fingerprints. The same counts give, by a dependence tree for each part, the expected number of
pairs that agree in a part; dynamic programming picks the thresholds, and the search over m the number of
parts, with the least expected cost of rows to send and pairs to verify. All choices are exact; they only
move cost.

Probe and verify: a fingerprint goes to the bucket of its value in each used part; where the threshold
is 1, also to the buckets of the values with one more bit set (so of two values that differ in one bit,
the lesser probes the greater); where it is 2, to the buckets of all values with one bit changed (two values
that differ in two bits meet in between). Buckets are compared in blocks, and a bucket sends out a spanning
forest of its links, so a group's pairs are never written out. A bucket of more than ``BLOCK`` rows is dealt
to several tasks: each holds a share of its fingerprints, and all of the bucket's rows pass by each share. A
bucket of n rows so takes n / BLOCK copies of each; the plan counts that in ``PAIR_COST``.

``keep_one`` is the stage for near copies by word shingles: it links two texts if their sets of five-word
shingles have a Jaccard similarity of 0.8 or more. Sets that similar share a shingle among the first fifth of
each, in any order that all texts keep: that of the shingles' hashes, with those that are frequent in a sample
last, so that few texts meet in a shingle. A text goes to the buckets of these shingles, whatever the number of
texts; texts of a bucket are candidates if their sizes allow it and their fingerprints of three-word shingles
are within ``SEARCH_DISTANCE`` bits. Two texts of a candidate group are then compared exactly. Within a group,
only texts that share one of their rarest shingles can be that similar (the same with the group's own counts as
the order);
such sharers, but for those that bounds by place and by parities rule out, are joined to a few leaders of
each shingle at a time, verified, and what is already connected is not looked at again, so that no group's
pairs are written out.

Equal fingerprints (``keep_one``: equal sets of shingles) are merged before any of this, so a group of
copies is one row. Components come from star rounds on those forests.

Defined cases: a null or empty text has fingerprint zero and links like any other (``keep_one``: texts
without words are one group); fewer words than a shingle has make one shingle; a null doc_id is never a
component's id unless the whole component has none; rows that repeat are judged one by one (``keep_one``: one
of them stays); an empty table gives no rows. Extra input columns pass through; new columns replace those of
the same names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sedgeway.llm.common import map_arrow
from sedgeway.llm.components import connected_components
from sedgeway.runtime import cut, discard, release, store, table

WORDS = 3
MAX_DISTANCE = 3
#: The stage for near copies: words of a shingle, similarity, and bits within which fingerprints are candidates.
SHINGLE = 5
SIMILARITY = 0.8
SEARCH_DISTANCE = 20
#: The sample that tells frequent shingles: so many texts at least, one in so many of all; times that a frequent shingle is found there, and how many the tasks are told.
SAMPLE = 10_000
SAMPLE_EVERY = 32
FREQUENT = 4
MOST_FREQUENT = 1 << 16
SEED = 42
BITS = 64
#: Rows of a bucket that one task compares with each other; larger buckets are dealt to several.
BLOCK = 2048
#: Cost of comparing a pair, and of sending its share of a large bucket's copies, against that of sending a row.
PAIR_COST = 0.002
#: Nodes and shingles of a candidate group up to which one task compares its sets.
SMALL_NODES = 64
SMALL_SHINGLES = 1 << 21
#: 64-bit words of the parities by which pairs of large groups are told apart before they are written.
PARITY_WORDS = 4
_PARITY = [f"p{k}" for k in range(PARITY_WORDS)]
_VOTES = 1 << 15


def _shingles(words: list[bytes], n_words: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(words[i:] for i in range(n_words)))) if len(words) > n_words else iter([b" ".join(words)])


def _vote(words: list[bytes], n_words: int, seed: int) -> int:
    if not words:
        return 0
    n = max(1, len(words) - n_words + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in _shingles(words, n_words)), dtype=">u8", count=n).view(np.uint8).reshape(n, 8)
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _VOTES):
        votes += np.unpackbits(h[i : i + _VOTES], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: bytes, n_words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of UTF-8 ``text``, unsigned."""
    return _vote(text.lower().split(), n_words, seed)  # of bytes: ASCII letters and the six white-space characters only


def fingerprints(df: DataFrame, text: str = "text", n_words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``fp``, the fingerprint as a signed 64-bit integer."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            raw = batch.column(text).cast(pa.binary()).to_pylist()
            return {"fp": pa.array(np.array([fingerprint(t or b"", n_words, seed) for t in raw], dtype=np.uint64).view(np.int64))}

        return work

    return map_arrow(df, text, make, T.StructType([T.StructField("fp", T.LongType())]))


# --- parts and thresholds


@dataclass(frozen=True)
class Part:
    """Bits (0 the lowest) and the distance up to which values in them are matched."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def bit_counts(fps: DataFrame, fp: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both set; summed over all rows."""
    low, high = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(x.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(x)
        counts = [n, *total[low, high].astype(np.int64).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([counts], type=pa.list_(pa.int64()))], names=["counts"])

    sums = fps.select(fp).mapInArrow(run, "counts array<bigint>").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # 2081 rows
    by = {r["pos"]: r["n"] for r in sums}
    counts = np.zeros((BITS, BITS))
    counts[low, high] = [by.get(i + 1, 0) for i in range(len(low))]
    return int(by.get(0, 0)), np.maximum(counts, counts.T)


def _agreement(n: int, counts: np.ndarray) -> np.ndarray:
    """Chance that two random fingerprints agree in both of two bits (on the diagonal: in one)."""
    both = counts / max(n, 1)
    one = np.diag(both)
    cells = [both, one[:, None] - both, one[None, :] - both, 1 - one[:, None] - one[None, :] + both]
    out = sum(np.square(np.clip(c, 0, 1)) for c in cells)
    np.fill_diagonal(out, np.square(one) + np.square(1 - one))
    return np.clip(out, 1e-12, 1)


def _grouped(agree: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size, each grown from its most dependent bits."""
    single = np.diag(agree)
    tie = np.abs(agree - np.outer(single, single))
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        idx = sorted(left)
        group = [max(idx, key=lambda b: (tie[b, idx].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in idx if b not in group), key=lambda b: (tie[b, group].sum(), -b)))
        left -= set(group)
        out.append(sorted(group))
    return out


def _near(agree: np.ndarray, bits: list[int]) -> tuple[float, float, float]:
    """Chance that two random fingerprints differ in none, at most one and at most two of ``bits``, by a dependence tree."""
    single = np.diag(agree)

    def joint(b: int, c: int) -> np.ndarray:  # [agree or differ in b][in c]
        aa = agree[b, c]
        return np.clip(np.array([[aa, single[b] - aa], [single[c] - aa, 1 - single[b] - single[c] + aa]]), 1e-12, 1)

    def information(b: int, c: int) -> float:
        j = joint(b, c)
        return float((j * np.log(j / np.outer(j.sum(1), j.sum(0)))).sum())

    children: dict[int, list[int]] = {b: [] for b in bits}
    best = {c: (information(bits[0], c), bits[0]) for c in bits[1:]}
    order = [bits[0]]
    while best:
        c = max(best, key=lambda x: (best[x][0], -x))
        children[best.pop(c)[1]].append(c)
        order.append(c)
        for x in best:
            if (w := information(c, x)) > best[x][0]:
                best[x] = (w, c)
    below: dict[int, np.ndarray] = {}  # [state of the bit][differences in its subtree: 0, 1, 2], given the state
    for b in reversed(order):
        mine = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
        for c in children[b]:
            j = joint(b, c)
            step = (j / j.sum(1, keepdims=True)) @ below[c]
            mine = np.stack([sum(mine[:, i] * step[:, k - i] for i in range(k + 1)) for k in range(3)], axis=1)
        below[b] = mine
    root = np.array([single[bits[0]], 1 - single[bits[0]]]) @ below[bits[0]]
    return tuple(np.cumsum(root).tolist())


def plan_parts(n: int, counts: np.ndarray, max_distance: int = MAX_DISTANCE, most_parts: int = 8) -> list[Part]:
    """The parts and thresholds of least expected cost for n fingerprints."""
    agree, best = _agreement(n, counts), (float("inf"), [])
    pairs = n * (n - 1) / 2
    for m in range(max(1, (max_distance + 3) // 3), max(most_parts, max_distance + 1) + 1):
        groups = _grouped(agree, m)
        cost = []
        for g in groups:
            zero, one, two = _near(agree, g)
            # Threshold 2: equal values meet in all buckets, others in two.
            meet = (1 + len(g)) * zero + 2 * (two - zero)
            cost.append({-1: 0.0, 0: n + PAIR_COST * pairs * zero, 1: n * (2 + len(g) / 2) + PAIR_COST * pairs * one, 2: n * (1 + len(g)) + PAIR_COST * pairs * meet})
        # Least cost of the parts so far, by the sum of their thresholds.
        table_: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (spent, chosen) in table_.items():
                for t, x in c.items():
                    if total + t not in new or spent + x < new[total + t][0]:
                        new[total + t] = (spent + x, (*chosen, t))
            table_ = new
        found = table_.get(max_distance - m + 1)
        if found and found[0] < best[0]:
            best = (found[0], [Part(tuple(g), t) for g, t in zip(groups, found[1])])
    return best[1]


# --- probing


def bucket_rows(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, key, probe, fp, lo, hi): every fingerprint in its own buckets (probe 0) and in those it probes (probe 1).

    ``lo`` and ``hi``, the least and greatest size of the texts of a fingerprint, are zero if ``fps`` has none.
    """
    used = [(i, p) for i, p in enumerate(parts) if p.threshold >= 0]
    sized = fps.select("fp", "lo", "hi") if {"lo", "hi"} <= set(fps.columns) else fps.select("fp", F.lit(0).alias("lo"), F.lit(0).alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, lo, hi = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            fp = fp.view(np.uint64)
            every = np.ones(len(fp), dtype=bool)
            for i, p in used:
                key = fp & np.uint64(p.mask)
                lots = [(key, 0, every)]
                for b in p.bits if p.threshold else ():
                    bit = np.uint64(1 << b)
                    off = (fp & bit) == 0
                    lots.append((key[off] | bit, 1, off) if p.threshold == 1 else (key ^ bit, 0, every))
                for k, probe, at in lots:
                    if len(k):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(k), i, np.int32)), pa.array(k.view(np.int64)), pa.array(np.full(len(k), probe, np.int32)), pa.array(fp[at].view(np.int64)), pa.array(lo[at]), pa.array(hi[at])],
                            names=["part", "key", "probe", "fp", "lo", "hi"],
                        )

    return sized.mapInArrow(run, "part int, key bigint, probe int, fp bigint, lo int, hi int")


class Bucket:
    """Links within one bucket: its own fingerprints are held, probes pass by; a spanning forest comes out.

    Fingerprints are held by least size, so that each is compared only with those within ``ratio`` of its size.
    """

    def __init__(self, max_distance: int, ratio: float = 0.0):
        self.limit, self.ratio, self.held, self.own, self.label = max_distance, ratio, [], None, None

    def add(self, probe: np.ndarray, fp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
        k = int(np.searchsorted(probe, 1))
        if k:
            self.held.append((fp[:k], lo[:k], hi[:k]))
        if k < len(fp):
            yield from self.close()
            order = np.argsort(lo[k:], kind="stable")
            yield from self._pass(fp[k:][order], lo[k:][order], hi[k:][order], None)

    def close(self) -> Iterator[tuple[int, int]]:
        if self.own is None:
            fp, lo, hi = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))
            order = np.argsort(lo, kind="stable")
            self.own, self.lo, self.hi = fp[order], lo[order], hi[order]
            self.most = np.maximum.accumulate(self.hi) if len(fp) else self.hi
            self.label = np.arange(len(self.own))
            if len(self.own) > 1:
                yield from self._pass(self.own, self.lo, self.hi, self.label)

    def _pass(self, fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, labels: np.ndarray | None) -> Iterator[tuple[int, int]]:
        for i in range(0, len(fps), 256):
            chunk = fps[i : i + 256]
            a, b = 0, len(self.own)
            if self.ratio:
                a = int(np.searchsorted(self.most, self.ratio * lo[i] - 1e-6))
                b = int(np.searchsorted(self.lo, hi[i : i + 256].max() / self.ratio + 1e-6, side="right"))
            if labels is not None:
                a = max(a, i)
            if a >= b:
                continue
            own, label = self.own[a:b], self.label[a:b]
            near = np.bitwise_count(chunk[:, None] ^ own[None, :]) <= self.limit
            for r in np.flatnonzero(near.any(axis=1)):
                found = label[np.flatnonzero(near[r])]
                first = np.unique(found)
                mine = labels[i + r] if labels is not None else -1
                if len(first) == 1 and first[0] == mine:
                    continue
                at = np.flatnonzero(near[r])
                for x in first:
                    other = own[at[np.argmax(found == x)]]
                    if x != mine and other != chunk[r]:
                        yield int(chunk[r]), int(other)
                keep = int(first[0]) if mine < 0 else int(mine)
                for x in first:
                    if x != keep:
                        self.label[self.label == x] = keep


def _small(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: int, ratio: float) -> Iterator[tuple[int, int]]:
    """Links within many small buckets at once; rows of a bucket are together, its own before its probes."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    shift = 1
    while shift < len(fp):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        sizes = (hi[shift:] + 1e-6 >= ratio * lo[:-shift]) & (hi[:-shift] + 1e-6 >= ratio * lo[shift:])
        hit = np.flatnonzero(same & sizes & (probe[:-shift] == 0) & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= limit) & (fp[shift:] != fp[:-shift]))
        for i in hit.tolist():
            g = int(group[i])
            a, b = find((g, int(fp[i]))), find((g, int(fp[i + shift])))
            if a != b:
                root[a] = b
                yield int(fp[i]), int(fp[i + shift])
        shift += 1


def links(rows: DataFrame, max_distance: int = MAX_DISTANCE, ratio: float = 0.0) -> DataFrame:
    """(a, b) links of bucket rows: enough to connect, in each bucket, what is within ``max_distance``, but for what is of too different sizes for ``ratio``."""
    big = rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    marked = rows.join(cut(big), ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    whole = marked.filter("blocks = 1").select("part", "key", F.lit(0).alias("block"), "probe", "fp", "lo", "hi")
    shares = marked.filter("blocks > 1 and probe = 0").select("part", "key", home.alias("block"), "probe", "fp", "lo", "hi")
    passing = marked.filter("blocks > 1").select("part", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("probe"), "fp", "lo", "hi")
    dealt = whole.unionByName(shares).unionByName(passing).repartition("part", "key", "block").sortWithinPartitions("part", "key", "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at, bucket = None, None

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, key, block, probe, fp, lo, hi = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(7))
            fp = fp.view(np.uint64)
            new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(fp)]])
            found: list[tuple[int, int]] = []
            small = np.zeros(len(fp), dtype=bool)
            for s, e in zip(starts[[0, -1]].tolist() if len(starts) > 1 else [0], ends[[0, -1]].tolist() if len(starts) > 1 else [len(fp)]):
                at = (int(part[s]), int(key[s]), int(block[s]))
                if at != open_at:
                    if bucket is not None:
                        found += bucket.close()
                    open_at, bucket = at, Bucket(max_distance, ratio)
                found += bucket.add(probe[s:e], fp[s:e], lo[s:e], hi[s:e])
            for s, e in zip(starts[1:-1].tolist(), ends[1:-1].tolist()):
                if e - s > 64:
                    one = Bucket(max_distance, ratio)
                    found += one.add(probe[s:e], fp[s:e], lo[s:e], hi[s:e])
                    found += one.close()
                elif e - s > 1:
                    small[s:e] = True
            if small.any():
                group = np.zeros(len(fp), dtype=np.int64)
                group[new] = 1
                found += _small(np.cumsum(group)[small], probe[small], fp[small], lo[small], hi[small], max_distance, ratio)
            yield out(found)
        if bucket is not None:
            yield out(list(bucket.close()))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``."""
    spark = df.sparkSession
    each = cut(fingerprints(df.select(doc_id, text), text, n_words).select(doc_id, "fp"))
    distinct = cut(each.groupBy("fp").agg(F.min(doc_id).alias("rep")))
    n, counts = bit_counts(distinct)
    parts = plan_parts(n, counts, max_distance)
    linked = connected_components(links(bucket_rows(distinct, parts), max_distance))
    roots = linked.join(distinct, linked["node"] == distinct["fp"]).select("node", "root", "rep")
    least = cut(roots.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = roots.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component_id")
    label = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # The xor hides that the rows are dealt by fp already: with an exchange on both sides Spark can split the copies of one text.
    label = cut(label).select(F.col("fp").bitwiseXOR(F.lit(0)).alias("fp"), "component_id")
    release(spark)
    return each.join(label, "fp", "left").select(doc_id, "fp", "component_id")


def _set_of(words: list[bytes], n_words: int, seed: int = SEED) -> np.ndarray:
    n = max(1, len(words) - n_words + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, seed) for x in _shingles(words, n_words)), dtype=np.uint64, count=n).view(np.int64)) if n else np.empty(0, np.int64)


def shingle_set(text: bytes, n_words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The different XXH64 values of the word shingles of UTF-8 ``text``, in order; empty if it has no words."""
    return _set_of(text.lower().split(), n_words, seed)


def _frequent(df: DataFrame, text: str, key: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many texts of ``df`` share, in order, and their ranks, the most frequent last.

    They are those of a sample of the different values of ``key``, the text's hash. They set an order of all shingles,
    which moves cost and no result.
    """
    every = max(1, min(SAMPLE_EVERY, df.count() // SAMPLE))
    some = df.select(text, key).filter(F.pmod(key, F.lit(every)) == 0).dropDuplicates([key])

    def make():
        return lambda batch: {"s": [shingle_set(t or b"", n_words) for t in batch.column(text).cast(pa.binary()).to_pylist()]}

    sets = map_arrow(some, text, make, T.StructType([T.StructField("s", T.ArrayType(T.LongType()))]), keep=False)
    times = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("times")).filter(F.col("times") >= FREQUENT)
    top = times.orderBy(F.desc("times"), "s").limit(MOST_FREQUENT).toArrow()["s"].to_numpy()
    order = np.argsort(top)
    return top[order], -order


def _prefix(found: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Those of the shingles ``found``, in order, of which every set of that similarity has one among its own such."""
    length = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    known, rank = frequent
    if not len(known):
        return found[:length]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    often = known[at] == found
    rare = found[~often][:length]
    return np.concatenate([rare, found[often][np.argsort(rank[at[often]])][: length - len(rare)]])


def _marks(df: DataFrame, text: str, n_words: int, similarity: float = SIMILARITY, frequent: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))) -> DataFrame:
    """``df`` without ``text``, with ``fp``, and size ``n``, hash ``h`` and ``prefix`` of the set of shingles of ``n_words`` words."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"fp": [], "n": [], "h": [], "prefix": []}
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                words = (t or b"").lower().split()
                found = _set_of(words, n_words)
                out["fp"].append(_vote(words, WORDS, SEED))
                out["n"].append(len(found))
                out["h"].append(xxhash.xxh3_64_intdigest(found.tobytes()))
                out["prefix"].append(_prefix(found, similarity, frequent))
            return {"fp": pa.array(np.array(out["fp"], np.uint64).view(np.int64)), "n": pa.array(out["n"], pa.int32()), "h": pa.array(np.array(out["h"], np.uint64).view(np.int64)), "prefix": out["prefix"]}

        return work

    fields = [T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    return map_arrow(df, text, make, T.StructType(fields), keep=False)


def prefix_rows(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (fp, n, prefix) as ``bucket_rows``: one for each shingle of a prefix that several prefixes hold."""
    each = nodes.select(F.explode("prefix").alias("key"), "fp", "n")
    met = each.withColumn("times", F.count("*").over(Window.partitionBy("key"))).filter("times > 1")
    return met.select(F.lit(0).alias("part"), "key", F.lit(0).alias("probe"), "fp", F.col("n").alias("lo"), F.col("n").alias("hi"))


def _sets(df: DataFrame, text: str, n_words: int) -> DataFrame:
    """(node, comp, n, s): the shingles of every row of ``df``."""

    def make():
        return lambda batch: {"s": [shingle_set(t or b"", n_words) for t in batch.column(text).cast(pa.binary()).to_pylist()]}

    return map_arrow(df.select("node", "comp", "n", text), text, make, T.StructType([T.StructField("s", T.ArrayType(T.LongType()))]), keep=False)


def _compared(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, label) of small groups, each compared by one task: sets of like sizes that aren't connected yet."""

    def labels(group: list[tuple[str, np.ndarray]]) -> list[str]:
        root = list(range(len(group)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        order = sorted(range(len(group)), key=lambda i: len(group[i][1]))
        for a, i in enumerate(order):
            x = group[i][1]
            for j in order[a + 1 :]:
                y = group[j][1]
                if len(x) + 1e-9 < similarity * len(y):
                    break
                if (p := find(i)) != (q := find(j)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * (1 + similarity) + 1e-9 >= similarity * (len(x) + len(y)) > 0:
                        root[max(p, q)] = min(p, q)
        return [group[find(i)][0] for i in range(len(group))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in group], pa.string()), pa.array(labels(group), pa.string())], names=["node", "label"])

        for batch in batches:
            comps, nodes = batch.column("comp").to_pylist(), batch.column("node").to_pylist()
            for comp, node, s in zip(comps, nodes, batch.column("s")):
                if comp != at:
                    if group:
                        yield out()
                    at, group = comp, []
                group.append((node, s.values.to_numpy()))
        if group:
            yield out()

    dealt = sets.select("comp", "node", "s").repartition("comp").sortWithinPartitions("comp", "node")
    return dealt.mapInArrow(run, "node string, label string")


def similar_groups(sets: DataFrame, similarity: float = SIMILARITY, small: int = SMALL_NODES) -> DataFrame:
    """(node, label) for the nodes of ``sets`` (node, comp, n, s): equal labels for what similarities of ``similarity`` or more connect within a comp.

    A comp of ``small`` nodes and ``SMALL_SHINGLES`` shingles at most is compared by one task; larger ones in rounds.
    """
    large = cut(sets.groupBy("comp").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles")).filter((F.col("nodes") > small) | (F.col("shingles") > SMALL_SHINGLES)).select("comp"))
    near = _compared(sets.join(large, "comp", "left_anti"), similarity)
    return near if large.isEmpty() else near.unionByName(_in_rounds(store(sets.join(large, "comp", "left_semi")), similarity))


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, comp, n, alone, s, rest) and parities: of each node, those of its shared shingles that stand in its prefix.

    Unshared shingles, ``alone`` of them, are the first, then the rarest; ``rest`` counts what stands from ``s`` on. The
    parities are those of the number of shared shingles, by bits of their hashes.
    """
    each = sets.select("node", "comp", "n", F.explode("s").alias("s"))
    shared = cut(each.groupBy("comp", "s").agg(F.count("*").alias("times")).filter("times > 1"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    odd = [F.coalesce(F.bit_xor(F.when(F.pmod(F.shiftright("s", 6), F.lit(PARITY_WORDS)) == k, bit)), F.lit(0).cast("long")).alias(p) for k, p in enumerate(_PARITY)]
    ordered = each.join(shared, ["comp", "s"]).groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("times", "s"))).alias("x"), *odd)
    alone = F.col("n") - F.size("x")
    longer = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - alone
    prefix = F.slice("x", 1, F.greatest(longer, F.lit(0)).cast("int"))
    rows = ordered.select("node", "comp", "n", alone.alias("alone"), *_PARITY, F.posexplode(prefix).alias("at", "x"))
    return rows.select("node", "comp", "n", "alone", *_PARITY, F.col("x.s").alias("s"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))


def _may_be_similar(similarity: float) -> Column:
    """Bounds on a row of ``_prefixes`` and a leader's (``l_``) of the same shingle, which hold in one row at least for each pair of that similarity.

    From the first shingle that two sets share on, each has all that they share. They differ in all their unshared
    shingles, and in one at least for each parity in which they differ.
    """
    both = F.col("n") + F.col("l_n")
    sizes = F.least("n", "l_n") + 1e-9 >= similarity * F.greatest("n", "l_n")
    most = F.least("rest", "l_rest") * (1 + similarity) + 1e-9 >= similarity * both
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"l_{p}"))) for p in _PARITY), F.col("alone") + F.col("l_alone"))
    return sizes & most & (differ * (1 + similarity) <= (1 - similarity) * both + 1e-9)


def _in_rounds(sets: DataFrame, similarity: float, leaders: int = 4) -> DataFrame:
    """``similar_groups`` for comps of any size.

    Each round takes some leaders of every shingle that still has several labels (four times as many as in the round
    before), verifies them against the others, and joins the labels; leaders are then done. Sets of which others hold
    the largest share lead first, so an original comes before its edited copies, which it links at once.
    """
    label = cut(sets.select("node", F.col("node").alias("label")))
    rows = cut(_prefixes(sets, similarity).withColumn("label", F.col("node")))
    key, carried = ["comp", "s"], ("n", "alone", "rest", *_PARITY)
    while True:
        mixed = cut(rows.groupBy(key).agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select(key))
        cur = cut(rows.join(mixed, key, "left_semi"))
        if cur.isEmpty():
            return label
        lot = F.pmod(F.xxhash64("node"), F.lit(leaders))
        lead = cur.groupBy(*key, lot.alias("lot")).agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("rank"), "node", "label", *carried)).alias("x"))
        lead = cut(lead.select(*key, *[F.col(f"x.{c}").alias(f"l_{c}") for c in ("node", "label", *carried)]))
        pairs = cur.join(lead, key).filter((F.col("label") != F.col("l_label")) & _may_be_similar(similarity)).select(F.col("node").alias("a"), F.col("l_node").alias("b"), F.col("label").alias("la"), F.col("l_label").alias("lb")).distinct()
        side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"))
        both = F.size(F.array_intersect("sa", "sb"))
        enough = both * (1 + similarity) + 1e-9 >= similarity * (F.col("na") + F.col("nb"))
        found = pairs.join(side("a"), "a").join(side("b"), "b").filter(enough).select("la", "lb")
        roots = cut(connected_components(found, "la", "lb").withColumnRenamed("node", "label"))
        renamed = lambda df: df.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        done = label, rows, mixed, cur, lead, roots
        label = cut(renamed(label))
        rows = cut(renamed(cur.join(lead.select(*key, F.col("l_node").alias("node")), [*key, "node"], "left_anti")))
        discard(*done)
        leaders *= 4
        release(sets.sparkSession)


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = SHINGLE, similarity: float = SIMILARITY, max_distance: int = SEARCH_DISTANCE) -> DataFrame:
    """One row of ``df`` for each group: that of the least doc_id, null the last, and of its texts that of least hash."""
    keys = ["_no", "_id", "_hash"]
    named = df.withColumns({"_no": F.col(doc_id).isNull(), "_id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_hash": F.xxhash64(text)})
    each = _marks(named.select(doc_id, text, *keys), text, n_words, similarity, _frequent(named, text, "_hash", n_words)).select("fp", "h", "n", "prefix", F.struct("_no", doc_id, "_hash", "_id").alias("row"))
    nodes = cut(each.groupBy("fp", "h").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.first("prefix").alias("prefix")))
    fps = cut(nodes.groupBy("fp").agg(F.count("*").alias("nodes")))
    met = cut(prefix_rows(nodes))
    linked = connected_components(links(met, max_distance, similarity))
    discard(met)
    comp = fps.join(linked, fps["fp"] == linked["node"], "left").select("fp", F.when((F.col("nodes") > 1) | F.col("root").isNotNull(), F.coalesce("root", "fp")).alias("_comp"))
    node = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("fp", "h")]).alias("_node")
    first = cut(nodes.join(comp, "fp").select(node, "_comp", F.col("n").alias("_n"), F.struct("row._no", f"row.{doc_id}", "row._hash", "row._id").alias("_row"), "row._no", "row._id", "row._hash"))
    release(df.sparkSession)
    w = Window.partitionBy(keys).orderBy("_hash")  # rows that repeat: each task sends one of them
    once = named.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    # Only narrow rows are kept between the steps: texts are sent for the sets of what may be similar, and once more for the result.
    several = first.filter("_comp is not null").select(*keys, F.col("_node").alias("node"), F.col("_comp").alias("comp"), F.col("_n").alias("n"))
    sets = cut(_sets(once.select(text, *keys).join(several, keys).select("node", "comp", "n", text), text, n_words))
    label = similar_groups(sets, similarity)
    grouped = first.filter("_comp is not null").select("_node", "_row").join(label, F.col("_node") == F.col("node"), "left")
    leads = cut(grouped.groupBy(F.coalesce("label", "_node").alias("group")).agg(F.min(F.struct("_row", "_node")).alias("x")).select("x._node"))
    discard(sets)
    stay = cut(first.filter("_comp is null").select(keys).unionByName(first.join(leads, "_node", "left_semi").select(keys)))
    return once.join(stay, keys, "left_semi").select(df.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
