"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a document of smaller
doc_id or further up in the same one. Strings are judged on the input.

Bringing equal strings together: every LENGTH-byte window has a minimizer, the least hash of the
``GRAM``-byte strings within it, which depends on the window's bytes alone. A text falls into segments of
consecutive windows whose minimizer stands at the same place (so no two windows of a segment are equal);
equal windows are in segments of equal minimizers. Minimizers met once in all documents are left out (their segments repeat nothing); the bytes of the other segments
meet by minimizer, equal segments first merged where they arise.

Comparing: the different segments of each minimizer are joined to one text of about ``TEXT`` bytes, whose
suffixes are sorted in two stages: the suffixes smaller than their successors are sorted directly, to a
depth of at least LENGTH; scans of the buckets of first bytes induce the others. Neighbours in that order
whose common prefix has LENGTH bytes are equal windows, of which the earliest stays. A minimizer with more
than ``HOT`` different segments is not gathered in one task: its windows are dealt out by their own bytes
and the earliest of each is found by an aggregation that is summed up before the shuffle.

Every step reads blocks of bounded size. What is sent is a few numbers for each segment (about 26 windows)
and the bytes of those segments whose minimizer repeats.

Defined cases: a null text is the empty text; texts shorter than LENGTH lose nothing; texts of any length
are cut whole; a null doc_id comes after all others; rows alike in doc_id and text are one document, of
which no row loses to the other; rows with equal doc_id and other texts are judged as two documents, the
order between them being that of a 32-bit hash, by which they are told apart; an empty table gives no rows. Input columns pass through; new
columns replace those of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow, pieces, text_or_empty
from sedgeway.runtime import cut, release, table

LENGTH = 100
GRAM = 50
#: Bytes of text whose suffixes are sorted at a time; different segments of a minimizer, and their bytes, up to which one task compares them.
TEXT = 1 << 19
HOT = 4096
HOT_BYTES = 4 << 20
#: Bytes of text hashed at a time; least number of lots in which segment numbers are sent.
BLOCK = 1 << 20
LOTS = 1024
#: Bytes of text whose segment numbers one task takes in at most, on average; more text has more tasks and lots.
TASK_TEXT = 512 << 20
_GATHER = 1 << 18

_BASE = 0x9E3779B97F4A7C15
#: A segment: minimizer, document and number of its text, first window, windows, and whether it is known to repeat. _MARK windows: no segment, but the news that the minimizer repeats.
_NUMBERS = np.dtype([("v", "<u8"), ("d", "<i8"), ("h", "<i4"), ("s", "<i4"), ("n", "u1"), ("known", "u1")])
_MARK = 255
_LAST = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], m = 1, 1
    while m < n:
        q = min(m, n - m)
        out[m : m + q] = out[:q] * np.uint64(pow(base, m, 1 << 64))
        m += q
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of all k-byte strings of ``b``."""
    n = len(b) + 1
    if n > len(_tables.get(0, ((),))[0]):
        _tables[0] = (_powers(_BASE, max(n, BLOCK + 4096)), _powers(pow(_BASE, -1, 1 << 64), max(n, BLOCK + 4096)))
    up, down = _tables[0]
    c = np.zeros(n, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[: len(b)], out=c[1:])
    h = (c[k:] - c[:-k]) * up[: n - k]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (w - s)], h[w - s :]) if s < w else h


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, index of the text, first window and number of windows of every segment of ``texts``."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    if not len(texts) or sizes.max() < length:
        return none
    if len(texts) == 1 and sizes[0] > 2 * BLOCK:  # a long text, in overlapping blocks
        parts = []
        for at in range(0, int(sizes[0]) - length + 1, BLOCK):
            v, d, s, n = segments([texts[0][at : at + BLOCK + length - 1]], length, gram)
            parts.append((v, d, s + at, n))
        return tuple(np.concatenate(x) for x in zip(*parts))
    b = np.frombuffer(b"".join(texts), np.uint8)
    g = gram_hashes(b, gram)
    v = _sliding_min(g, length - gram + 1)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(texts)), sizes)[: len(v)]
    ok = np.arange(len(v)) <= ends[own] - length
    new = ~ok
    new[0] = True
    new[1:] |= (v[1:] != v[:-1]) | (own[1:] != own[:-1]) | (v[:-1] == g[: len(v) - 1])  # the last: the minimizer was the window's start
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(v)))
    keep = ok[at]
    at, n = at[keep], n[keep]
    return v[at], own[at], at - (ends - sizes)[own[at]], n


# --- two-stage suffix sorting


def _word_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[np.minimum(at, len(words) - 1)]


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, the first byte highest."""
    padded = np.concatenate([t, np.zeros(16, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(t) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)] << np.uint64(8 * (7 - k))
    return out


def _direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` sorted by their first ``depth`` bytes at least."""
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    for step in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub, g = order[tied], group[tied]
        key = _word_at(words, sub + step)
        o = np.lexsort((key, g))
        sub, key = sub[o], key[o]
        order[tied] = sub
        split = np.zeros(len(order), bool)
        split[1:] = group[1:] != group[:-1]
        inner = np.flatnonzero((key[1:] != key[:-1]) & (g[o][1:] == g[o][:-1])) + 1
        split[tied[inner]] = True
        group = np.cumsum(split)
    return order


def suffix_array(t: np.ndarray, words: np.ndarray, depth: int = LENGTH + 4) -> np.ndarray:
    """The suffixes of ``t`` in order of their first ``depth`` bytes at least."""
    n = len(t)
    smaller = np.zeros(n, bool)  # than the successor
    if n > 1:
        differ = np.flatnonzero(t[:-1] != t[1:])
        nxt = np.searchsorted(differ, np.arange(n - 1))
        known = nxt < len(differ)
        k = differ[nxt[known]]
        smaller[: n - 1][known] = t[k] < t[k + 1]
    first = _direct(words, np.flatnonzero(smaller), depth)
    lead = t[first]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    cuts = np.searchsorted(lead, np.arange(257))
    for c in range(256):
        cur = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        bucket = [cur]
        while len(cur):
            p = cur[cur > 0] - 1
            cur = p[t[p] == c]
            bucket.append(cur)
        bucket.append(first[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        p = whole[whole > 0] - 1
        p = p[t[p] > c]
        if len(p):
            ch = t[p]
            o = np.argsort(ch, kind="stable")
            p, ch = p[o], ch[o]
            for part in np.split(p, np.flatnonzero(ch[1:] != ch[:-1]) + 1):
                induced[t[part[0]]].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(words: np.ndarray, sa: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in order, ``limit`` at most."""
    out = np.zeros(len(sa), np.int64)
    k = np.arange(1, len(sa))
    for step in range(0, limit, 8):
        if not len(k):
            break
        x = _word_at(words, sa[k] + step) ^ _word_at(words, sa[k - 1] + step)
        same = x == 0
        part = k[~same]
        y = x[~same]
        out[part] = step + sum((y < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))
        k = k[same]
    out[k] = limit
    return np.minimum(out, limit)


def earliest_windows(found: list[tuple[bytes, int, int]], length: int = LENGTH, hashes: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(document, first, end) ranges of the windows of segments ``found`` that no earlier one equals.

    A segment is its bytes, document and place; documents compare as numbers. With ``hashes``, one for each
    segment, documents are told apart by number and hash, and ranges are (document, hash, first, end).
    """
    t = np.frombuffer(b"\xff".join(s for s, _, _ in found) + b"\xff", np.uint8)  # no byte of UTF-8 text is 0xff
    sizes = np.array([len(s) for s, _, _ in found], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    seg = np.repeat(np.arange(len(found)), sizes + 1)
    inside = np.arange(len(t)) - starts[seg]
    window = inside <= sizes[seg] - length
    words = _words(t)
    sa = suffix_array(t, words, length + 4)
    sa_window = window[sa]
    equal = common_prefixes(words, sa, length) >= length
    run = np.cumsum(~equal)[sa_window]
    at = sa[sa_window]
    doc = np.array([d for _, d, _ in found], np.int64)[seg[at]]
    place = np.array([p for _, _, p in found], np.int64)[seg[at]] + inside[at]
    text = np.array(hashes or [0] * len(found), np.int64)[seg[at]]
    o = np.lexsort((place, text, doc, run))
    first = np.concatenate([[True], run[o][1:] != run[o][:-1]]) if len(o) else np.empty(0, bool)
    stays = np.zeros(len(t), bool)
    stays[at[o[first]]] = True
    edge = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for a, b in zip(begins.tolist(), ends.tolist()):  # a separator stands between the windows of two segments
        _, d, p = found[seg[a]]
        own = (d,) if hashes is None else (d, hashes[seg[a]])
        out.append((*own, p + int(inside[a]), p + int(inside[a]) + b - a))
    return out


# --- the distributed steps


def _tasks(df: DataFrame, text: str) -> int:
    """Tasks that the segment numbers of ``df`` need, from the bytes of its texts."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return int(total // TASK_TEXT) + 1


def _told_apart(keyed: DataFrame) -> DataFrame:
    """``keyed`` (_d, _t) with ``_h``: zero, or for ids with several texts the text's number, in order of hash and digest.

    Ids of one text, which most are, cost a pass of narrow rows; only where others are found do texts meet their numbers.
    """
    digest = F.sha2("_t", 256)
    docs = cut(keyed.select("_d", F.hash("_t").alias("_o"), digest.alias("_m")).distinct())
    several = cut(docs.groupBy("_d").agg(F.count("*").alias("n")).filter("n > 1").select("_d"))
    if several.isEmpty():
        return keyed.withColumn("_h", F.lit(0))
    # Rows in order over all tasks: an id holds its task's number above 33 bits and its place in the task below.
    pairs = docs.join(several, "_d", "left_semi").repartitionByRange("_d", "_o", "_m").sortWithinPartitions("_d", "_o", "_m")
    pairs = cut(pairs.select("_d", "_m", F.monotonically_increasing_id().alias("_i")))
    task = F.call_function("shiftright", F.col("_i"), F.lit(33))
    sizes = sorted((r["t"], r["n"]) for r in pairs.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect())  # a row for each task
    if sum(n for _, n in sizes) >= 1 << 31:
        raise ValueError("more than 2^31 different texts share their doc_ids")
    before, offsets = 1, []
    for t, n in sizes:
        offsets.append((t, before))
        before += n
    start = F.broadcast(keyed.sparkSession.createDataFrame(offsets, "_task long, _first long"))  # a row for each task
    numbered = pairs.withColumn("_task", task).join(start, "_task").select("_d", "_m", (F.col("_first") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("_h"))
    return keyed.withColumn("_m", digest).join(numbered, ["_d", "_m"], "left").withColumn("_h", F.coalesce("_h", F.lit(0))).drop("_m")


def _numbers(df: DataFrame, text: str, lots: int = LOTS) -> DataFrame:
    """(lot, numbers): the segments of ``df``, packed, by a lot of their minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def send() -> pa.RecordBatch:
            rec = np.concatenate(held)
            # What repeats here already is dealt by document, and one mark tells the minimizer's lot: so a hot minimizer's lot gets a row from each send.
            _, first, place, times = np.unique(rec["v"], return_index=True, return_inverse=True, return_counts=True)
            marks = rec[first[times > 1]].copy()
            marks["n"] = _MARK
            again = (times > 1)[place]
            lot = np.concatenate([np.where(again, rec["d"].view(np.uint64) * np.uint64(_BASE) >> np.uint64(40), rec["v"]) % np.uint64(lots), marks["v"] % np.uint64(lots)]).astype(np.int32)
            rec["known"] = again
            rec = np.concatenate([rec, marks])
            o = np.argsort(lot, kind="stable")
            rec, lot = rec[o], lot[o]
            edges = np.flatnonzero(np.diff(lot)) + 1
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(lot)]])
            return pa.RecordBatch.from_arrays([pa.array(lot[starts]), pa.array([rec[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary())], names=["lot", "numbers"])

        for batch in batches:
            for piece in pieces(batch, text, BLOCK):
                texts = piece.column(text).cast(pa.binary()).to_pylist()
                v, own, s, n = segments(texts)
                rec = np.empty(len(v), _NUMBERS)
                rec["v"], rec["s"], rec["n"] = v, s, n
                rec["d"] = piece.column("_d").to_numpy(zero_copy_only=False)[own]
                rec["h"] = piece.column("_h").to_numpy(zero_copy_only=False)[own]
                rec["known"] = 0
                held.append(rec)
                total += len(rec)
                if total >= _GATHER:
                    yield send()
                    held, total = [], 0
        if total:
            yield send()

    return df.select("_d", "_h", text).mapInArrow(run, "lot int, numbers binary")


def _repeated(numbers: DataFrame, tasks: int = 1, most: int = 4 << 20) -> DataFrame:
    """(d, h, s, n, v) of the segments whose minimizer is met more than once.

    Rows stream by; those known to repeat pass through. Of minimizers known to repeat only the value is held,
    of others the one row: a share of the text's size, which ``tasks`` keeps to ``TASK_TEXT`` for each task.
    """
    usual = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        passing: list[np.ndarray] = []
        once = fresh = 0
        twice = np.empty(0, np.uint64)

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rec = np.concatenate(held) if held else np.empty(0, _NUMBERS)
            rec = rec[np.argsort(rec["v"], kind="stable")]
            v = rec["v"]
            again = rec["n"] == _MARK
            again[1:] |= v[1:] == v[:-1]
            again[:-1] |= v[1:] == v[:-1]
            if len(twice):
                at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
                again |= twice[at] == v
            return rec[again & (rec["n"] != _MARK)], rec[~again], np.union1d(twice, v[again])

        def out(rec: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rec), 1 << 16):
                r = rec[i : i + (1 << 16)]
                cols = [r["d"], r["h"], r["s"], r["n"].astype(np.int32), np.ascontiguousarray(r["v"]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["d", "h", "s", "n", "v"])

        for batch in batches:
            for blob in batch.column("numbers"):
                rec = np.frombuffer(blob.as_buffer(), _NUMBERS)
                known = rec["known"] == 1
                mark = rec["n"] == _MARK
                passing.append(rec[known & ~mark])
                rec = rec[mark | ~known]
                held.append(rec)
                fresh += len(rec)
                if fresh >= max(most, once):
                    found, single, twice = settle()
                    yield from out(found)
                    held, once, fresh = [single], len(single), 0
            if sum(map(len, passing)) >= 1 << 16:
                yield from out(np.concatenate(passing))
                passing = []
        found, _, _ = settle()
        yield from out(np.concatenate([found, *passing]))

    dealt = numbers.repartition(tasks, "lot") if tasks > usual else numbers.repartition("lot")
    return dealt.mapInArrow(run, "d bigint, h int, s int, n int, v bigint")


def _bytes(joined: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """(v, seg, d, h, s): bytes and first place of the segments listed in ``segs``; equal ones of a task are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.binary()), pa.array([p[0] for _, p in part], pa.int64()), pa.array([p[1] for _, p in part], pa.int32()), pa.array([p[2] for _, p in part], pa.int32())],
                    names=["v", "seg", "d", "h", "s"],
                )

        for batch in batches:
            for piece in pieces(batch, text, BLOCK):
                segs = piece.column("segs")
                ends = segs.offsets.to_numpy()
                flat = segs.values
                s, n, v = (flat.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(3))
                for i, (t, d, h) in enumerate(zip(piece.column(text).cast(pa.binary()).to_pylist(), piece.column("_d").to_pylist(), piece.column("_h").to_pylist())):
                    for k in range(int(ends[i]), int(ends[i + 1])):
                        key = (v[k], t[s[k] : s[k] + n[k] + length - 1])
                        old = held.get(key)
                        if old is None:
                            size += len(key[1])
                            held[key] = (d, h, s[k])
                        elif (d, h, s[k]) < old:
                            held[key] = (d, h, s[k])
                if size > 16 << 20:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return joined.mapInArrow(run, "v bigint, seg binary, d bigint, h int, s int")


def _kept(found: DataFrame, hot: int, length: int = LENGTH) -> DataFrame:
    """(d, h, a, b, seg): the ranges of windows that stay, of the first place of each different segment; with ``seg`` where a hot minimizer's segment is left to ``_kept_hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple[bytes, int, int, int]] = []  # segments to compare
        lot_size = 0
        group: list[tuple[bytes, int, int, int]] = []  # different segments of the minimizer at hand
        group_v, group_size, over = None, 0, False
        rows: list[tuple[int, int, int, int, bytes | None]] = []

        def out(rows: list) -> pa.RecordBatch:
            d, h, a, b, seg = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(seg, pa.binary())], names=["d", "h", "a", "b", "seg"])

        def as_hot(x: tuple[bytes, int, int, int]) -> tuple[int, int, int, int, bytes]:
            return x[1], x[2], x[3], x[3] + len(x[0]) - length + 1, x[0]

        def compared() -> Iterator[tuple[int, int, int, int, None]]:
            for r in earliest_windows([(seg, d, s) for seg, d, _, s in lot], length, [x[2] for x in lot]):
                yield (*r, None)

        def close() -> None:
            nonlocal group, group_size, over, lot_size
            if over:
                rows.extend(map(as_hot, group))
            elif len(group) == 1:
                rows.append((*as_hot(group[0])[:4], None))
            else:
                lot.extend(group)
                lot_size += group_size
            group, group_size, over = [], 0, False

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for v, seg, d, h, s in zip(*cols):
                if v != group_v:
                    close()
                    group_v = v
                    if lot_size >= TEXT:
                        rows.extend(compared())
                        lot, lot_size = [], 0
                elif group and group[-1][0] == seg:
                    continue  # rows are sorted: the first place came first
                group.append((seg, d, h, s))
                group_size += len(seg)
                if len(group) > hot or group_size > HOT_BYTES:
                    over = True
                    rows.extend(map(as_hot, group[:-1]))
                    group = group[-1:]
                    group_size = len(seg)
            if len(rows) >= 10_000:
                yield out(rows)
                rows = []
        close()
        if lot:
            rows.extend(compared())
        if rows:
            yield out(rows)

    return found.repartition("v").sortWithinPartitions("v", "seg", "d", "h", "s").mapInArrow(run, "d bigint, h int, a int, b int, seg binary")


def _kept_hot(left: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, h, a, b): the earliest of each different window of the segments that were left."""
    one = left.select("d", "h", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("b") - F.col("a") - 1), lambda i: F.substring("seg", i + 1, F.lit(length)))).alias("i", "w"), "a")
    least = one.groupBy("w").agg(F.min(F.struct("d", "h", (F.col("a") + F.col("i")).alias("a"))).alias("x"))
    return least.select("x.d", "x.h", "x.a", (F.col("x.a") + 1).alias("b"))


def removed_bytes(total: int, repeated: np.ndarray, kept: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of ``total`` bytes go: those of the windows in ranges ``repeated`` but not in ``kept``."""
    gone = np.zeros(total + 1, bool)
    for a, b in repeated.tolist():
        gone[a:b] = True
    for a, b in kept.tolist():
        gone[a:b] = False
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(gone[: max(0, total - length + 1)])
    edge[at] += 1
    np.subtract.at(edge, at + length, 1)
    return np.cumsum(edge[:total]) > 0


def dedup_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (of bytes removed) and ``kept`` (the bytes left)."""
    spark = df.sparkSession
    plain = text_or_empty(df, text)
    keyed = _told_apart(df.withColumns({"_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "_t": plain}))
    tasks = _tasks(keyed, "_t")
    numbers = _numbers(keyed.select("_d", "_h", "_t"), "_t", max(LOTS, 4 * tasks))
    per_doc = _repeated(numbers, tasks).groupBy("d", "h").agg(F.collect_set(F.struct("s", "n", "v")).alias("segs"))
    per_doc = cut(per_doc)
    release(spark)
    texts = keyed.select("_d", "_h", "_t").join(per_doc, (F.col("_d") == F.col("d")) & (F.col("_h") == F.col("h"))).select("_d", "_h", "_t", "segs")
    kept = cut(_kept(_bytes(texts, "_t"), hot))
    release(spark)
    hot_rows = kept.filter("seg is not null")
    all_kept = kept.filter("seg is null").select("d", "h", "a", "b")
    if hot_rows.limit(1).count():
        all_kept = all_kept.unionByName(_kept_hot(hot_rows))
    kept_doc = all_kept.groupBy("d", "h").agg(F.collect_list(F.struct("a", "b")).alias("_stay"))
    ranges = per_doc.select("d", "h", F.transform("segs", lambda x: F.struct(x["s"].alias("a"), (x["s"] + x["n"]).alias("b"))).alias("_again"))
    both = ranges.join(kept_doc, ["d", "h"], "left").select(F.col("d").alias("_rd"), F.col("h").alias("_rh"), "_again", "_stay")
    full = keyed.join(both, (F.col("_d") == F.col("_rd")) & (F.col("_h") == F.col("_rh")), "left").drop("_d", "_h", "_rd", "_rh")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = T.StructType(
        [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]
    )

    def make():
        def pairs(x) -> np.ndarray:
            if not x.is_valid:
                return np.empty((0, 2), np.int64)
            v = x.values
            return np.column_stack([v.field(0).to_numpy(zero_copy_only=False), v.field(1).to_numpy(zero_copy_only=False)]).astype(np.int64)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in added.fields}
            for t, again, stay in zip(batch.column("_t").cast(pa.binary()).to_pylist(), batch.column("_again"), batch.column("_stay")):
                spans: list[dict] = []
                left = t
                if again.is_valid:
                    gone = removed_bytes(len(t), pairs(again), pairs(stay))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
                    left = np.frombuffer(t, np.uint8)[~gone].tobytes() if spans else t
                for k, v in (("n_bytes", len(t)), ("n_removed", len(t) - len(left)), ("n_spans", len(spans)), ("spans", spans), ("kept", left)):
                    out[k].append(v)
            return out

        return work

    return map_arrow(full, "_t", make, added).drop("_t", "_again", "_stay")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_passages(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
