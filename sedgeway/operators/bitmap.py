"""The allocation bitmap in blocks with a rank index.

A block is a row of ``BLOCK`` clusters: their bits in words of 64, the clusters in use before each word, and those before the
block. How many clusters of a run are in use is then the difference of two ranks: two lookups by block, however long the
run is and however broken up the space. A volume of n clusters has n / 4096 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Clusters of a word and of a block; blocks of a lot, in which ranks are summed and free runs joined before volumes are.
WORD, BLOCK, LOT = 64, 4096, 4096
_SCHEMA = "volume_id string, block bigint, words array<bigint>, ranks array<int>, taken int"


def _folded(fragments: DataFrame) -> DataFrame:
    """Blocks from fragments (volume_id, block, at, n, data): ``n`` clusters in use from place ``at``, or the bits of ``data`` from there on, the lowest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, None
        done: list[tuple] = []

        def close() -> None:
            packed = np.packbits(bits, bitorder="little").view("<i8")
            counts = np.bitwise_count(packed.view("<u8")).astype(np.int32)
            done.append((*at, packed.tolist(), (np.cumsum(counts) - counts).tolist(), int(counts.sum())))

        def out() -> pa.RecordBatch:
            volume, block, words, ranks, taken = zip(*done) if done else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(volume, pa.string()), pa.array(block, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())), pa.array(taken, pa.int32())], names=["volume_id", "block", "words", "ranks", "taken"])

        for batch in batches:
            for volume, block, place, n, data in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (volume, block) != at:
                    if at is not None:
                        close()
                    at, bits = (volume, block), np.zeros(BLOCK, bool)
                if data is None:
                    bits[place : place + n] = True
                else:
                    own = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: BLOCK - place].astype(bool)
                    bits[place : place + len(own)] |= own
            if len(done) >= 1024:
                yield out()
                done = []
        if at is not None:
            close()
        yield out()

    rows = fragments.select(F.col("volume_id").cast("string"), F.col("block").cast("long"), F.col("at").cast("int"), F.col("n").cast("int"), F.col("data").cast("binary"))
    return rows.repartition("volume_id", "block").sortWithinPartitions("volume_id", "block").mapInArrow(run, _SCHEMA)


def _blocks(fragments: DataFrame, totals: DataFrame) -> DataFrame:
    """(volume_id, block, words, ranks, taken, before, total) of every block of the volumes in ``totals`` (volume_id, total); what lies past a volume's end counts as in use."""
    none = F.lit(None).cast("binary")
    last = F.floor(F.col("total") / BLOCK)
    every = totals.select("volume_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("data"))
    past = totals.select("volume_id", last.alias("block"), (F.col("total") % BLOCK).alias("at"), F.lit(BLOCK).alias("n"), none.alias("data"))
    inside = fragments.join(totals, "volume_id").filter(F.col("block") <= last).drop("total")
    blocks = _folded(inside.unionByName(every).unionByName(past)).withColumn("_lot", F.floor(F.col("block") / LOT))
    lots = blocks.groupBy("volume_id", "_lot").agg(F.sum("taken").alias("_sum"))
    earlier = lots.withColumn("_lots", F.coalesce(F.sum("_sum").over(Window.partitionBy("volume_id").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy("volume_id", "_lot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.withColumn("_in", F.coalesce(F.sum("taken").over(within), F.lit(0))).join(earlier, ["volume_id", "_lot"])
    return ranked.join(totals, "volume_id").select("volume_id", "block", "words", "ranks", "taken", (F.col("_lots") + F.col("_in")).alias("before"), "total")


def from_pieces(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks from pieces (volume_id, first_byte, bytes) of bitmaps, the lowest bit first, and the clusters in all of each volume (volume_id, total).

    Pieces may have any length and begin at any byte; they don't overlap. Clusters that no piece tells of are free.
    """
    size = BLOCK // 8
    end = F.col("first_byte") + F.octet_length("bytes")
    cut = pieces.filter(F.octet_length("bytes") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("first_byte") / size), F.floor((end - 1) / size))))
    start = F.greatest(F.col("first_byte"), F.col("block") * size)
    part = F.substring(F.col("bytes"), (start - F.col("first_byte") + 1).cast("int"), F.lit(size).cast("int"))
    keep = F.substring(part, F.lit(1), (F.least(end, (F.col("block") + 1) * size) - start).cast("int"))
    fragments = cut.select("volume_id", "block", ((start - F.col("block") * size) * 8).alias("at"), F.lit(0).alias("n"), keep.alias("data"))
    return _blocks(fragments, totals)


def from_runs(alloc: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks from runs (volume_id, start_lcn, len) in use, which may overlap, and the clusters in all of each volume (volume_id, total)."""
    end = F.col("start_lcn") + F.col("len")
    cut = alloc.filter("len > 0 and start_lcn >= 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start_lcn") / BLOCK), F.floor((end - 1) / BLOCK))))
    start = F.greatest(F.col("start_lcn"), F.col("block") * BLOCK)
    return _blocks(cut.select("volume_id", "block", (start - F.col("block") * BLOCK).alias("at"), (F.least(end, (F.col("block") + 1) * BLOCK) - start).alias("n"), F.lit(None).cast("binary").alias("data")), totals)


def _rank(offset: Column, before: Column | str = "before") -> Column:
    """Clusters in use before place ``offset`` of a block, and ``before`` it."""
    word, bit = F.floor(offset / WORD).cast("int"), (offset % WORD).cast("int")
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    return (F.col(before) if isinstance(before, str) else before) + F.get("ranks", word) + F.bit_count(F.get("words", word).bitwiseAND(mask))


def allocated_in(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, allocated): clusters in use in the stored runs (id, volume_id, lcn, clusters) of each id; ids without any are left out. Clusters past a volume's end are in use."""
    totals = blocks.filter("block = 0").select("volume_id", "total")
    ends = runs.filter("lcn >= 0 and clusters > 0").select("id", "volume_id", F.explode(F.array(F.struct(F.col("lcn").alias("x"), F.lit(-1).alias("sign")), F.struct((F.col("lcn") + F.col("clusters")).alias("x"), F.lit(1).alias("sign")))).alias("e")).select("id", "volume_id", "e.*")
    placed = ends.join(totals, "volume_id").select("id", "volume_id", "sign", F.least("x", "total").alias("x"), F.greatest(F.lit(0), F.col("x") - F.col("total")).alias("past"))
    met = placed.withColumn("block", F.floor(F.col("x") / BLOCK)).join(blocks.select("volume_id", "block", "words", "ranks", "before"), ["volume_id", "block"])
    return met.groupBy("id").agg(F.sum(F.col("sign") * (_rank(F.col("x") % BLOCK) + F.col("past"))).alias("allocated")).filter("allocated > 0")


def overlaps(runs: DataFrame, alloc: DataFrame) -> DataFrame:
    """(id, allocated): clusters of ``alloc`` (volume_id, start_lcn, len), whose rows may overlap, in the stored runs (id, volume_id, lcn, clusters) of each id; ids without any are left out. There is no volume's end: what isn't told of is free.

    Runs are cut at block borders and meet the blocks that have clusters in use, one row for each, so no pairs of runs are
    formed. What is in use of a piece is the difference of two ranks within its block.
    """

    def cut_up(df: DataFrame, start: Column, end: Column, *keep: str) -> DataFrame:
        b = df.withColumns({"_s": F.greatest(start, F.lit(0)), "_e": end}).filter("_e > _s")
        b = b.withColumn("block", F.explode(F.sequence(F.floor(F.col("_s") / BLOCK), F.floor((F.col("_e") - 1) / BLOCK))))
        return b.select(*keep, "volume_id", "block", (F.greatest("_s", F.col("block") * BLOCK) - F.col("block") * BLOCK).alias("s"), (F.least("_e", (F.col("block") + 1) * BLOCK) - F.col("block") * BLOCK).alias("e"))

    pieces = cut_up(runs.filter("lcn >= 0"), F.col("lcn"), F.col("lcn") + F.col("clusters"), "id")
    used = cut_up(alloc, F.col("start_lcn"), F.col("start_lcn") + F.col("len"))
    blocks = _folded(used.select("volume_id", "block", F.col("s").alias("at"), (F.col("e") - F.col("s")).alias("n"), F.lit(None).cast("binary").alias("data")))
    upto = lambda x: F.when(x == BLOCK, F.col("taken").cast("long")).otherwise(_rank(x, F.lit(0).cast("long")))
    met = pieces.join(blocks, ["volume_id", "block"])
    return met.groupBy("id").agg(F.sum(upto(F.col("e")) - upto(F.col("s"))).alias("allocated")).filter("allocated > 0")


def free_runs_of(blocks: DataFrame) -> DataFrame:
    """(volume_id, start_lcn, len) of the maximal free runs. Runs are found within blocks, joined within lots of blocks, and then over the lots' borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            volumes, starts, ends = [], [], []
            for volume, block, words in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                used = np.unpackbits(np.array(words, "<i8").view(np.uint8), bitorder="little")
                edge = np.flatnonzero(np.diff(np.concatenate([[1], used, [1]])))
                starts += (block * BLOCK + edge[::2]).tolist()
                ends += (block * BLOCK + edge[1::2]).tolist()
                volumes += [volume] * (len(edge) // 2)
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["volume_id", "s", "e"])

    found = blocks.filter(F.col("taken") < BLOCK).select("volume_id", "block", "words").mapInArrow(run, "volume_id string, s bigint, e bigint")
    size = BLOCK * LOT

    def joined(runs: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("s")
        marked = runs.withColumn("_new", (F.coalesce(F.lag("e").over(order), F.lit(-1)) != F.col("s")).cast("int"))
        return marked.withColumn("_g", F.sum("_new").over(order)).groupBy(*by, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("volume_id", "s", "e")

    parts = joined(found.withColumn("_lot", F.floor(F.col("s") / size)), "volume_id", "_lot")
    edge = (F.col("s") % size == 0) | (F.col("e") % size == 0)
    whole = parts.filter(~edge).unionByName(joined(parts.filter(edge), "volume_id"))  # two rows at most for each lot
    return whole.select("volume_id", F.col("s").alias("start_lcn"), (F.col("e") - F.col("s")).alias("len"))
