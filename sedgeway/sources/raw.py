"""Tables decoded from raw bytes: journal buffers, file records, Recycle Bin metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sedgeway import schemas as S
from sedgeway.functions.binary import bin_metadata, file_record, journal_records, unprotect


def _decode(df: DataFrame, keep: list[str], schema: T.StructType, decode: Callable[[dict], list[dict]]) -> DataFrame:
    names = [f.name for f in schema.fields]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{k: r[k] for k in keep} | out for r in pdf.to_dict("records") for out in decode(r)]
            frame = pd.DataFrame([{n: x.get(n) for n in names} for x in rows], columns=names)
            for f in schema.fields:
                if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    frame[f.name] = frame[f.name].astype("Int64")
                elif isinstance(f.dataType, T.TimestampNTZType):
                    frame[f.name] = pd.to_datetime(frame[f.name], errors="coerce")
            yield frame

    return df.mapInPandas(work, schema)


def read_journal(buffers: DataFrame) -> DataFrame:
    """Journal records from rows (volume_id, buffer)."""
    return _decode(buffers.select("volume_id", "buffer"), ["volume_id"], S.JOURNAL, lambda r: journal_records(bytes(r["buffer"] or b"")))


def read_file_records(records: DataFrame, protected: bool = True) -> DataFrame:
    """File records from rows (volume_id, record_no, record); torn and malformed ones are left out."""

    def one(r: dict) -> list[dict]:
        raw = bytes(r["record"] or b"")
        raw = unprotect(raw) if protected else raw
        out = file_record(raw) if raw else None
        if out is None:
            return []
        return [out | {"runs": [{"vcn": a, "lcn": b, "clusters": c} for a, b, c in out["runs"]]}]

    return _decode(records.select("volume_id", "record_no", "record"), ["volume_id", "record_no"], S.MFT_RECORDS, one)


def read_bin(files: DataFrame) -> DataFrame:
    """Recycle Bin items from ``$I`` files as rows (sid, name, content)."""
    schema = T.StructType.fromDDL("sid string, name string, version bigint, size bigint, deleted_at timestamp_ntz, original_path string")
    return _decode(files.select("sid", "name", "content"), ["sid", "name"], schema, lambda r: [x] if (x := bin_metadata(bytes(r["content"] or b""))) else [])


def first_readable(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, str, str | None]:
    """The table of the first reader that works, its name, and why those before it didn't."""
    from pyspark.errors import PySparkException

    reason = None
    for name, read in readers.items():
        try:
            df = read()
            df.limit(1).collect()
            return df, name, reason
        except (PySparkException, OSError, NotImplementedError, ValueError) as e:
            reason = f"{name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}"
    raise OSError(reason or "no readers")


def parse_snapshots(text: DataFrame, column: str = "value") -> DataFrame:
    """(snapshot_id, device, created_text), the newest first, from the text of a shadow copy listing, one listing a row, in which it stands last.

    A listing gives the time of a set before the copies of it; copies take the last time above them.
    """
    lines = text.withColumn("_t", F.xxhash64(column)).select("_t", F.posexplode(F.split(F.col(column), r"\r?\n")).alias("_i", "_l"))
    pick = lambda p: F.nullif(F.regexp_extract("_l", p, 1), F.lit(""))
    seen = Window.partitionBy("_t").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)  # a listing is one text
    carried = lines.select(
        F.last(pick(r"Shadow Copy ID: (\{[0-9a-fA-F-]+\})"), ignorenulls=True).over(seen).alias("snapshot_id"), F.last(pick(r"creation time: (.+?)\s*$"), ignorenulls=True).over(seen).alias("created_text"),
        pick(r"Shadow Copy Volume: (\S+)").alias("device"), "_t", "_i",
    )
    return carried.filter("device is not null and snapshot_id is not null").orderBy("_t", F.desc("_i")).select("snapshot_id", "device", "created_text")


def read_image(spark: SparkSession, path: str, cluster: int = 4096, chunk: int = 1 << 20, partitions: int = 8) -> DataFrame:
    """(lcn, data) of the clusters of a volume image that every executor can open; a task reads ranges of ``chunk`` bytes.

    A file's end within a cluster is filled with zeros.
    """
    import os

    size, step = os.path.getsize(path), max(cluster, chunk // cluster * cluster)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as image:
            for pdf in batches:
                for k in pdf["id"]:
                    image.seek(int(k) * step)
                    data = image.read(step)
                    first = int(k) * step // cluster
                    parts = [data[i : i + cluster].ljust(cluster, b"\0") for i in range(0, len(data), cluster)]
                    yield pd.DataFrame({"lcn": range(first, first + len(parts)), "data": parts})

    return spark.range(0, -(-size // step), 1, partitions).mapInPandas(read, "lcn bigint, data binary")


def boot_geometry(sector: bytes) -> dict[str, int]:
    """Cluster and record sizes, clusters in all and the first cluster of the file table, from an NTFS boot sector; ValueError for any other."""
    if len(sector) < 512 or sector[3:11] != b"NTFS    ":
        raise ValueError("no NTFS boot sector")
    per_sector, per_cluster = int.from_bytes(sector[11:13], "little"), sector[13]
    per_cluster = 1 << (256 - per_cluster) if per_cluster > 0x80 else per_cluster
    size = per_sector * per_cluster
    if per_sector not in (256, 512, 1024, 2048, 4096) or not size or size & (size - 1) or size > 2 << 20:
        raise ValueError("impossible sector or cluster size")
    exponent = int.from_bytes(sector[64:65], "little", signed=True)
    record = 1 << -exponent if exponent < 0 else exponent * size
    if not 256 <= record <= 64 << 10:
        raise ValueError("impossible record size")
    number = lambda at: int.from_bytes(sector[at : at + 8], "little")
    return {"cluster": size, "record": record, "clusters": number(40) * per_sector // size, "table_lcn": number(48), "mirror_lcn": number(56)}


def read_file_table(clusters: DataFrame, runs: list[tuple[int, int, int]], record: int = 1024, cluster: int = 4096, volume_id: str = "C") -> DataFrame:
    """Raw records (volume_id, record_no, record) of a file table that lies in ``runs`` (vcn, lcn, clusters) of ``clusters`` (lcn, data).

    Clusters meet the runs by number, so every task cuts the clusters it has; a record larger than a cluster is put together from its own.
    ``read_file_records`` decodes them. The runs of a table are few and are broadcast.
    """
    extents = clusters.sparkSession.createDataFrame(runs, "vcn long, start long, n long")
    placed = clusters.join(F.broadcast(extents), (F.col("lcn") >= F.col("start")) & (F.col("lcn") < F.col("start") + F.col("n"))).select((F.col("vcn") + F.col("lcn") - F.col("start")).alias("vcn"), "data")
    if record <= cluster:
        each = cluster // record
        parts = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.struct((F.col("vcn") * each + i).alias("record_no"), F.substring("data", (i * record + 1).cast("int"), F.lit(record)).alias("record")))
        return placed.select(F.lit(volume_id).alias("volume_id"), F.inline(parts))
    each = record // cluster
    whole = placed.groupBy(F.floor(F.col("vcn") / each).alias("record_no")).agg(F.array_sort(F.collect_list(F.struct("vcn", "data"))).alias("x"))
    return whole.select(F.lit(volume_id).alias("volume_id"), "record_no", F.aggregate(F.transform("x", lambda p: p["data"]), F.lit(b""), lambda acc, d: F.concat(acc, d)).alias("record"))
