"""Copies of recovered and carved files of any size: their SHA-256, what was lost, and the grade that is left.

A file's clusters are dealt to one task, in the order of its own numbering, and folded as they pass: one hash, the zeros
between them, and for compressed files the clusters of one unit. Nothing of a file is gathered, so its size only takes
time. (A SHA-256 is sequential: each file is one task's work, different files are not.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sedgeway.functions.binary import lznt1
from sedgeway.operators.bitmap import allocated_in, overlaps
from sedgeway.operators.recovery import COMPRESSION_UNITS, FLAG_COMPRESSED, FLAG_ENCRYPTED, good_runs
from sedgeway.runtime import cut
from sedgeway.schemas import RUNS

#: Grades by loss in a copy; others stay as they are. Fixed values.
LOSS = ("Excellent", "Good", "Partial", "Zeroed", "Overwritten")
#: Extensions of programs, whose copies get a name that doesn't run. Fixed values.
PROGRAMS = (".exe", ".dll", ".scr", ".msi", ".bat", ".cmd", ".ps1", ".js", ".vbs", ".lnk", ".com", ".jar", ".hta")
_ZEROS = bytes(1 << 16)


def carved_files(carved: DataFrame, cluster: int = 4096) -> DataFrame:
    """Carved files (volume_id, start_lcn, size) as files for ``copies``: one run each, known by their first cluster."""
    run = F.struct(F.lit(0).cast("long").alias("vcn"), F.col("start_lcn").alias("lcn"), F.ceil(F.col("size") / cluster).cast("long").alias("clusters"))
    return carved.select(
        "volume_id", F.col("start_lcn").alias("record_no"), F.lit(False).alias("is_dir"), F.col("size").alias("real_size"), F.col("size").alias("initialized_size"), F.lit(0).alias("data_flags"), F.lit(0).alias("compression_unit"),
        F.lit(False).alias("resident"), F.lit(None).cast("binary").alias("resident_data"), F.array(run).alias("runs"), F.lit("Excellent").alias("grade"),
    )


def copy_name(name: Column) -> Column:
    """The name under which a file is copied: programs get an extension that nothing runs."""
    return F.when(F.lower(F.regexp_extract(name, r"(\.[^.\\]*)$", 1)).isin(*PROGRAMS), F.concat(name, F.lit(".recovered"))).otherwise(name)


def _planned(files: DataFrame, cluster: int, total_clusters: int | None) -> DataFrame:
    """``files`` with why they can't be copied, the size that their runs can hold, and the clusters that matter."""
    none = F.array().cast(RUNS)
    runs = F.coalesce("runs", none)
    flags = F.coalesce("data_flags", F.lit(0))
    resident, packed = F.coalesce("resident", F.lit(False)), flags.bitwiseAND(F.lit(FLAG_COMPRESSED)) != 0
    bad = ~good_runs(F.col("runs"), total_clusters)
    wrong = (
        F.when(flags.bitwiseAND(F.lit(FLAG_ENCRYPTED)) != 0, "encrypted files can't be copied").when(F.coalesce("is_dir", F.lit(False)), "a folder is copied through what it holds").when(resident, None)
        .when(bad, "the runs can't be followed").when(packed & ~F.coalesce("compression_unit", F.lit(0)).isin(*COMPRESSION_UNITS), "unsupported compression unit").when(F.coalesce("real_size", F.lit(-1)) < 0, "no size")
    )
    held = F.aggregate(F.when(bad, none).otherwise(runs), F.lit(0).cast("long"), lambda a, r: a + r["clusters"])
    out = files.withColumns({"_wrong": wrong, "_held": held, "_unit": F.when(packed, F.when(F.col("compression_unit") == 0, 4).otherwise(F.col("compression_unit"))).otherwise(0), "_resident": resident})
    out = out.withColumn("_size", F.when(resident, F.least("real_size", F.coalesce(F.octet_length("resident_data"), F.lit(0)))).otherwise(F.least("real_size", F.col("_held") * cluster)).cast("long"))
    out = out.withColumn("_init", F.when(F.col("initialized_size") > 0, F.least("initialized_size", "_size")).otherwise(F.col("_size")))
    need = F.when(F.col("_unit") > 0, F.col("_held")).otherwise(F.ceil(F.col("_init") / cluster))
    part = lambda r: F.struct(r["vcn"].alias("vcn"), r["lcn"].alias("lcn"), F.greatest(F.lit(0), F.least(r["clusters"], F.col("_need") - r["vcn"])).cast("long").alias("clusters"))
    return out.withColumn("_need", need).withColumn("_parts", F.when(F.col("_wrong").isNull() & ~F.col("_resident"), F.filter(F.transform(runs, part), lambda r: (r["lcn"] >= 0) & (r["clusters"] > 0))).otherwise(none))


def _byte_runs(cluster: int) -> Column:
    """(offset, length, position) of a copy's bytes on the volume; for compressed files a run for each unit, at its first cluster."""
    row = lambda offset, length, position: F.struct(offset.cast("long").alias("offset"), length.cast("long").alias("length"), position.cast("long").alias("position"))
    plain = F.transform("_parts", lambda r: row(r["vcn"] * cluster, F.least(r["clusters"] * cluster, F.col("_init") - r["vcn"] * cluster), r["lcn"] * cluster))
    step = F.shiftleft(F.lit(1), 4)
    at = lambda u: F.get(F.filter("_parts", lambda r: (r["vcn"] <= u) & (u < r["vcn"] + r["clusters"])), 0)
    units = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("_held") - 1), step.cast("long")), lambda u: row(u * cluster, F.least(step * cluster, F.col("_init") - u * cluster), (at(u)["lcn"] + u - at(u)["vcn"]) * cluster))
    return F.filter(F.when(F.col("_unit") > 0, units).otherwise(plain), lambda r: (r["length"] > 0) & r["position"].isNotNull())


def _folded(planned: DataFrame, clusters: DataFrame, cluster: int) -> DataFrame:
    """(volume_id, record_no, bytes, sha256, lost, fault) of the files with runs that can be copied."""
    schema = T.StructType.fromDDL("volume_id string, record_no bigint, bytes bigint, sha256 string, lost bigint, fault string")
    arrow = to_arrow_schema(schema)

    class Copy:
        """A file as its clusters pass."""

        def __init__(self, key: tuple, size: int, init: int, unit: int):
            self.key, self.size, self.init, self.step = key, size, init, 1 << unit if unit else 0
            self.hash, self.at, self.lost, self.fault = hashlib.sha256(), 0, 0, None
            self.unit, self.stored = -1, []  # clusters of the compressed unit at hand

        def put(self, offset: int, data: bytes) -> None:
            self.zeros(offset)
            data = data[: max(0, self.init - offset)]
            self.hash.update(data)
            self.at += len(data)

        def zeros(self, upto: int) -> None:
            while self.at < upto:
                n = min(len(_ZEROS), upto - self.at)
                self.hash.update(_ZEROS[:n])
                self.at += n

        def add(self, vcn: int, data: bytes | None) -> None:
            if data is None:
                self.lost += 1
            if not self.step:
                if data is not None:
                    self.put(vcn * cluster, data.ljust(cluster, b"\0"))
                return
            if vcn // self.step != self.unit:
                self.flush()
                self.unit = vcn // self.step
            self.stored.append((vcn, data))

        def flush(self) -> None:
            stored, self.stored = self.stored, []
            first = self.unit * self.step
            if [v for v, _ in stored] != list(range(first, first + len(stored))):
                self.fault = self.fault or "a compressed unit has data after its sparse part"
            if not stored or self.fault or any(d is None for _, d in stored):
                return  # zeros
            whole = b"".join(d.ljust(cluster, b"\0") for _, d in stored)
            if len(stored) < self.step:
                try:
                    whole = lznt1(whole, self.step * cluster)
                except ValueError as e:
                    self.fault = self.fault or str(e)
                    return
            self.put(first * cluster, whole.ljust(self.step * cluster, b"\0"))

        def close(self) -> tuple:
            self.flush()
            self.zeros(self.size)
            return (*self.key, None, None, self.lost, self.fault) if self.fault else (*self.key, self.size, self.hash.hexdigest(), self.lost, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            volume, record, vcn, size, init, unit = (batch.column(i).to_pylist() for i in range(6))
            data = batch.column(6)
            for i in range(batch.num_rows):
                if vcn[i] < 0:  # each file begins with what is known of it
                    if now is not None:
                        done.append(now.close())
                    now = Copy((volume[i], record[i]), size[i], init[i], unit[i])
                else:
                    now.add(vcn[i], data[i].as_py())
            if len(done) >= 4096:
                yield out()
                done = []
        if now is not None:
            done.append(now.close())
        yield out()

    whole = planned.filter("_wrong is null and not _resident")
    none = F.lit(None)
    heads = whole.select("volume_id", "record_no", F.lit(-1).cast("long").alias("vcn"), "_size", "_init", "_unit", none.cast("binary").alias("data"))
    runs = whole.select("volume_id", "record_no", F.explode("_parts").alias("r"))
    each = runs.select("volume_id", "record_no", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.clusters") - 1)).alias("i")).select("volume_id", "record_no", (F.col("r.vcn") + F.col("i")).alias("vcn"), (F.col("r.lcn") + F.col("i")).alias("lcn"))
    rows = each.join(clusters.select("volume_id", "lcn", "data"), ["volume_id", "lcn"], "left").select("volume_id", "record_no", "vcn", none.cast("long").alias("_size"), none.cast("long").alias("_init"), none.cast("int").alias("_unit"), "data")
    return heads.unionByName(rows).repartition("volume_id", "record_no").sortWithinPartitions("volume_id", "record_no", "vcn").mapInArrow(run, schema)


def copies(files: DataFrame, clusters: DataFrame, alloc: DataFrame | None = None, cluster: int = 4096, total_clusters: int | None = None) -> DataFrame:
    """(volume_id, record_no, bytes, sha256, final_grade, lost_clusters, byte_runs, error) of the copies of ``files``.

    ``files`` are file records with a ``grade`` (``recovery.grade``) or ``carved_files``; ``clusters`` (volume_id, lcn, data)
    is the volume, each cluster once; ``alloc`` what is in use when they are copied, as runs or in blocks. Sizes are cut to
    what the runs can hold; sparse runs, and what lies past the initialized size, are zeros; compressed units are expanded.
    Clusters that aren't there become zeros and are counted. The grade goes down to Partial or Overwritten for
    clusters in use now, to Partial for lost ones and to Zeroed if all are lost; it never goes up. What can't be copied has an error and no digest.
    """
    planned = _planned(files, cluster, total_clusters)
    planned = cut(planned.select("volume_id", "record_no", "grade", "resident_data", *[c for c in planned.columns if c.startswith("_")]))  # read by every step below
    done = _folded(planned, clusters, cluster).select(F.col("volume_id").alias("f_vol"), F.col("record_no").alias("f_rec"), "bytes", F.col("sha256").alias("f_sha"), "lost", "fault")
    out = planned.withColumn("byte_runs", _byte_runs(cluster)).join(done, (F.col("volume_id") == F.col("f_vol")) & (F.col("record_no") == F.col("f_rec")), "left")
    if alloc is None:
        out = out.withColumn("_taken", F.lit(0))
    else:
        each = planned.select(F.struct("volume_id", "record_no").alias("id"), "volume_id", F.explode("_parts").alias("r")).select("id", "volume_id", "r.lcn", "r.clusters")
        taken = (allocated_in(each, alloc) if "words" in alloc.columns else overlaps(each, alloc)).select(F.col("id.volume_id").alias("t_vol"), F.col("id.record_no").alias("t_rec"), F.col("allocated").alias("_taken"))
        out = out.join(taken, (F.col("volume_id") == F.col("t_vol")) & (F.col("record_no") == F.col("t_rec")), "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    stored = F.aggregate("_parts", F.lit(0).cast("long"), lambda a, r: a + r["clusters"])
    rank = lambda g: F.array_position(F.array(*[F.lit(x) for x in LOSS]), g)
    now = F.greatest(
        F.when(F.col("_taken") <= 0, 1).when(F.col("_taken") >= stored, LOSS.index("Overwritten") + 1).otherwise(LOSS.index("Partial") + 1),
        F.when(F.coalesce("lost", F.lit(0)) <= 0, 1).when(F.col("lost") >= stored, LOSS.index("Zeroed") + 1).otherwise(LOSS.index("Partial") + 1),
    )
    left = F.element_at(F.array(*[F.lit(x) for x in LOSS]), F.greatest(rank(F.col("grade")), now.cast("long")).cast("int"))
    error = F.coalesce("_wrong", "fault")
    content = F.substring("resident_data", F.lit(1), F.col("_size").cast("int"))
    return out.select(
        "volume_id", "record_no", F.when(error.isNull(), F.col("_size")).alias("bytes"), F.when(error.isNull(), F.when(F.col("_resident"), F.sha2(F.coalesce(content, F.lit(b"")), 256)).otherwise(F.col("f_sha"))).alias("sha256"),
        F.when(error.isNotNull() | (rank(F.col("grade")) == 0), F.col("grade")).otherwise(left).alias("final_grade"), F.coalesce("lost", F.lit(0)).cast("long").alias("lost_clusters"), "byte_runs", error.alias("error"),
    )
