"""Scans that skip what they have found: of spans in order, those that start at or after the end of the last one kept.

Whether a span is kept hangs on all before it, yet no task needs more than a block of places. Within a block the walk
from any span on is followed to the place where it leaves the block (its skip function). The blocks' functions are composed by
pointer doubling over the spans by which blocks are entered: each round, the spans known to be reached reach those that their pointers
name, and pointers are squared, so a key over b blocks takes about log2(b) rounds. Last, each block that is reached is walked from where it is entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sedgeway.runtime import cut, discard

#: Places of a block; a task holds the starts of one.
BLOCK = 1 << 16


def uncovered(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """The rows of ``spans`` that a scan of each key in order keeps: the first, then each that starts at or after the end of the last one kept.

    Starts are whole numbers, one row for each start of a key; ends are greater than starts; key columns aren't null.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    narrow = spans.select(*named, F.floor(F.col(start) / block).cast("long").alias("_b"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    each = cut(_walked(narrow, ks))
    heads = cut(each.groupBy(*ks).agg(F.min("_s").alias("_s")))
    reached = heads
    jump = cut(_targets(each, heads, ks, block))
    while not jump.isEmpty():
        further = reached.join(jump, [*ks, "_s"]).select(*ks, F.col("_to").alias("_s"))
        beyond = jump.select(*ks, F.col("_s").alias("_to"), F.col("_to").alias("_far"))
        old = reached, jump
        reached = cut(reached.unionByName(further).distinct())
        jump = cut(jump.join(beyond, [*ks, "_to"]).select(*ks, "_s", F.col("_far").alias("_to")))
        discard(*old)
    entered = reached.select(*ks, F.floor(F.col("_s") / block).cast("long").alias("_b"), F.col("_s").alias("_in"))
    kept = _walked(each.join(entered, [*ks, "_b"]).select(*ks, "_b", "_s", "_e", "_in"), ks, choose=True)
    kept = kept.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(ks)], F.col("_s").alias("_rs"))
    same = F.col(start) == F.col("_rs")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_r{i}")
    return spans.join(kept, same, "left_semi")


def _walked(spans: DataFrame, ks: list[str], choose: bool = False) -> DataFrame:
    """Block by block: every span with ``_x``, the place from which the walk that it begins is free beyond the block; or, with ``choose``, the spans of the walk from ``_in``."""
    fields = [*[spans.schema[k] for k in ks], *[T.StructField(c, T.LongType()) for c in (("_s",) if choose else ("_b", "_s", "_e", "_x"))]]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    n = len(ks)

    def follow(first: pa.RecordBatch, s: np.ndarray, e: np.ndarray, entry: int) -> pa.RecordBatch:
        after = np.searchsorted(s, e)
        if choose:
            at, i = [], int(np.searchsorted(s, entry))
            while i < len(s):
                at.append(i)
                i = int(after[i])
            s = s[at]
            columns = [s]
        else:
            x = e.copy()
            for i in range(len(s) - 1, -1, -1):
                if after[i] < len(s):
                    x[i] = x[after[i]]
            columns = [np.full(len(s), first.column(n)[0].as_py()), s, e, x]
        zero = pa.array(np.zeros(len(s), np.int64))
        return pa.RecordBatch.from_arrays([*[first.column(i).take(zero) for i in range(n)], *map(pa.array, columns)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, entry, s, e = None, None, 0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*[batch.column(i).to_pylist() for i in range(n + 1)]))
            edges = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            starts, ends = (batch.column(i).to_numpy() for i in (n + 1, n + 2))
            for a, b in zip(edges, edges[1:]):
                if key[a] != at:
                    if at is not None:
                        yield follow(first, np.concatenate(s), np.concatenate(e), entry)
                    at, first, s, e = key[a], batch.slice(a, 1), [], []
                    entry = batch.column(n + 3)[a].as_py() if choose else 0
                s.append(starts[a:b])
                e.append(ends[a:b])
        if at is not None:
            yield follow(first, np.concatenate(s), np.concatenate(e), entry)

    return spans.repartition(*ks, "_b").sortWithinPartitions(*ks, "_b", "_s").mapInArrow(run, schema)


def _targets(each: DataFrame, heads: DataFrame, ks: list[str], block: int) -> DataFrame:
    """(keys, _s, _to) of the ``heads`` and of all spans that some walk enters its block by: the first span at or after the place to which the span's own walk leaves its block; no row where there is none.

    Only these spans can be reached from block to block; most blocks have few. Places and spans are put in one order within
    blocks; a place after its block's last span takes the first span of the next block that has one.
    """
    asked = cut(each.select(*ks, F.floor(F.col("_x") / block).cast("long").alias("_b"), F.col("_x").alias("_at"), F.lit(None).cast("long").alias("_to")).distinct())
    spots = each.select(*ks, "_b", F.col("_s").alias("_at"), F.col("_s").alias("_to"))
    here = Window.partitionBy(*ks, "_b").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = asked.unionByName(spots).withColumn("_near", F.min("_to").over(here)).filter("_to is null").select(*ks, "_b", "_at", "_near")
    firsts = spots.groupBy(*ks, "_b").agg(F.min("_at").alias("_first")).unionByName(asked.select(*ks, "_b").distinct().withColumn("_first", F.lit(None).cast("long")))
    later = Window.partitionBy(*ks).orderBy("_b").rangeBetween(1, Window.unboundedFollowing)  # a row or two for each block
    beyond = firsts.withColumn("_later", F.min("_first").over(later)).groupBy(*ks, "_b").agg(F.min("_later").alias("_later"))
    to = cut(near.join(beyond, [*ks, "_b"]).select(*ks, F.col("_at").alias("_x"), F.coalesce("_near", "_later").alias("_to")).filter("_to is not null"))
    entries = to.select(*ks, F.col("_to").alias("_s")).unionByName(heads).distinct()
    return each.select(*ks, "_s", "_x").join(entries, [*ks, "_s"], "left_semi").join(to, [*ks, "_x"]).select(*ks, "_s", "_to")
