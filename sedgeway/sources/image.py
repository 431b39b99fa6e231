"""Volume images as data sources: their clusters, and the records of their file table.

``spark.read.format("volume_clusters")`` gives (volume_id, lcn, data), ``format("volume_records")`` (volume_id,
record_no, record) after ``register(spark)``; both take ``path`` (a file, or a URI of a store that pyarrow opens, which every executor can
reach), ``volume_id``, ``partition_bytes`` and ``ranges``, the numbers to read, like "0-99,512-600": no other bytes are read. (Filters
aren't pushed: this version of Spark keeps the partitions of a pushed filter for later uses of the same frame without it.)

The table is found from the image alone: boot sector, record 0, its runs. With ``in_use`` the records are visited from the
top of each range down, by the table's own bitmap, so that free records and holes are passed over without a read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedgeway.functions.binary import data_runs, file_record, unprotect
from sedgeway.sources.raw import boot_geometry, read_file_records

#: Bytes that a task reads at most, and that one batch holds.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


class Opened:
    """A file that any worker can open by its path, read at any place; what lies past its end is zeros."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        data = self.file.read_at(min(n, max(0, self.size - offset)), offset) if offset < self.size else b""
        return data.ljust(n, b"\0")

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


# --- ranges of a numbered column


@dataclass
class Span(InputPartition):
    low: int
    high: int


def asked_ranges(text: str | None) -> list[tuple[int, int]] | None:
    """(low, high) of "a-b,c": numbers from a to b, and c; None for no text. ValueError for anything else."""
    if not text:
        return None
    out = []
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        out.append((int(low), int(high or low) + 1))
    return out


def parts_of(ranges: Iterable[tuple[int, int]], most: int) -> list[Span]:
    """The ranges in pieces of ``most`` numbers at most; neighbours are put together first."""
    whole: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if whole and a <= whole[-1][1]:
            whole[-1] = whole[-1][0], max(b, whole[-1][1])
        else:
            whole.append((a, b))
    return [Span(x, min(b, x + most)) for a, b in whole for x in range(a, b, most)]


class _Ranged(DataSourceReader):
    """Reads numbered pieces of an image, in the ranges that are asked for."""

    column = ""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("an image needs a path")
        self.path, self.volume = options["path"], options.get("volume_id", "C")
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.asked = asked_ranges(options.get("ranges"))
        self.ranges: list[tuple[int, int]] = []
        self.each = 1  # bytes of a piece

    def there(self, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """What is asked for of the ranges that there are."""
        if self.asked is None:
            return ranges
        whole = [(s.low, s.high) for s in parts_of(self.asked, 1 << 62)]
        both = [(max(a, c), min(b, d)) for a, b in ranges for c, d in whole]
        return [(a, b) for a, b in both if a < b]

    def partitions(self) -> list[Span]:
        return parts_of(self.ranges, max(1, self.partition_bytes // self.each)) or [Span(0, 0)]

    def batch(self, numbers: list[int], data: list[bytes], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.volume] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], names=["volume_id", self.column, name])


# --- clusters


class ClusterReader(_Ranged):
    column = "lcn"

    def __init__(self, options: dict):
        super().__init__(options)
        with Opened(self.path) as image:
            self.each = int(options["cluster"]) if options.get("cluster") else boot_geometry(image.at(0, 512))["cluster"]
            self.ranges = self.there([(0, -(-image.size // self.each))])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // self.each)
        with Opened(self.path) as image:
            for first in range(partition.low, partition.high, step):
                n = min(step, partition.high - first)
                data = image.at(first * self.each, n * self.each)
                yield self.batch(list(range(first, first + n)), [data[i * self.each : (i + 1) * self.each] for i in range(n)], "data")


class VolumeClusters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_clusters"

    def schema(self) -> str:
        return "volume_id string, lcn bigint, data binary"

    def reader(self, schema) -> ClusterReader:
        return ClusterReader(self.options)


# --- the file table


def attributes(record: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, bytes) of the attributes of a record whose sectors were put back."""
    at, used = struct.unpack_from("<H", record, 20)[0], struct.unpack_from("<I", record, 24)[0]
    end = min(used, len(record))
    while at + 16 <= end:
        kind, length = struct.unpack_from("<II", record, at)
        if kind == 0xFFFFFFFF or not 16 <= length <= end - at:
            return
        yield kind, record[at : at + length]
        at += length


@dataclass
class Table:
    """Where an image's file table lies: bytes of a cluster and of a record, how many records, its runs, and those of its bitmap (or the bitmap itself)."""

    cluster: int
    record: int
    records: int
    runs: list[tuple[int, int, int]]
    bitmap: bytes | list[tuple[int, int, int]] | None

    def read(self, image: Opened, runs: list[tuple[int, int, int]], offset: int, n: int) -> bytes:
        """``n`` bytes from ``offset`` of what lies in ``runs``; sparse parts and what no run holds are zeros."""
        out = bytearray(n)
        for vcn, lcn, count in runs:
            a, b = max(offset, vcn * self.cluster), min(offset + n, (vcn + count) * self.cluster)
            if a < b and lcn >= 0:
                out[a - offset : b - offset] = image.at(lcn * self.cluster + a - vcn * self.cluster, b - a)
        return bytes(out)

    def stored(self) -> list[tuple[int, int]]:
        """Ranges of records of which some byte is stored."""
        out = []
        for vcn, lcn, count in self.runs:
            if lcn >= 0:
                out.append((vcn * self.cluster // self.record, min(self.records, -(-(vcn + count) * self.cluster // self.record))))
        return [(s.low, s.high) for s in parts_of([x for x in out if x[0] < x[1]], 1 << 62)]


def find_table(image: Opened) -> Table:
    """The file table of an image from its boot sector and record 0; ValueError for layouts that can't be followed."""
    shape = boot_geometry(image.at(0, 512))
    raw = unprotect(image.at(shape["table_lcn"] * shape["cluster"], shape["record"]))
    zero = raw and file_record(raw)
    if not zero or not zero["in_use"]:
        raise ValueError("record 0 can't be read")
    kinds = list(attributes(raw))
    if any(kind == 0x20 for kind, _ in kinds):
        raise ValueError("the table's own record is spread over others")
    runs = zero["runs"]
    if not runs or runs[0][0] < 0:
        raise ValueError("record 0 names no runs of the table")
    valid = zero["initialized_size"] or zero["real_size"] or 0
    if sum(n for _, _, n in runs) * shape["cluster"] < valid or valid <= 0:
        raise ValueError("the runs in record 0 don't hold the whole table")
    bitmap: bytes | list | None = None
    for kind, a in kinds:
        if kind == 0xB0 and not a[9]:
            if a[8]:
                bitmap = data_runs(a[struct.unpack_from("<H", a, 32)[0] :])
            else:
                n, o = struct.unpack_from("<IH", a, 16)
                bitmap = a[o : o + n]
    return Table(shape["cluster"], shape["record"], valid // shape["record"], runs, bitmap)


def downward(low: int, high: int, fetch: Callable[[int], int]) -> Iterator[int]:
    """The records in use in [low, high) from the top down; ``fetch`` gives the highest one at or below a number, -1 if there is none."""
    n = high - 1
    while n >= low:
        found = fetch(n)
        if not low <= found <= n:
            return
        yield found
        n = found - 1


class RecordReader(_Ranged):
    column = "record_no"

    def __init__(self, options: dict):
        super().__init__(options)
        self.in_use = str(options.get("in_use", "false")).lower() == "true"
        with Opened(self.path) as image:
            self.table = find_table(image)
        if self.in_use and self.table.bitmap is None:
            raise ValueError("record 0 names no bitmap of records in use")
        self.each, self.ranges = self.table.record, self.there(self.table.stored())

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with Opened(self.path) as image:
            yield from self.visited(image, partition) if self.in_use else self.all_of(image, partition)

    def all_of(self, image: Opened, p: Span) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // self.each)
        for first in range(p.low, p.high, step):
            n = min(step, p.high - first)
            data = self.table.read(image, self.table.runs, first * self.each, n * self.each)
            yield self.batch(list(range(first, first + n)), [data[i * self.each : (i + 1) * self.each] for i in range(n)], "record")

    def visited(self, image: Opened, p: Span) -> Iterator[pa.RecordBatch]:
        byte = p.low // 8
        need = -(-p.high // 8) - byte
        t = self.table
        bits = t.bitmap[byte : byte + need].ljust(need, b"\0") if isinstance(t.bitmap, bytes) else t.read(image, t.bitmap, byte, need)

        def fetch(n: int) -> int:
            k = n // 8 - byte
            below = bits[k] & ((2 << n % 8) - 1)
            if not below:
                k -= 1
                while k >= 0 and not bits[k]:
                    k -= 1
                below = bits[k] if k >= 0 else 0
            return 8 * (byte + k) + below.bit_length() - 1 if below else -1

        numbers, data = [], []
        for n in downward(p.low, p.high, fetch):
            numbers.append(n)
            data.append(t.read(image, t.runs, n * self.each, self.each))
            if len(numbers) * self.each >= BATCH_BYTES:
                yield self.batch(numbers, data, "record")
                numbers, data = [], []
        if numbers:
            yield self.batch(numbers, data, "record")


class VolumeRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_records"

    def schema(self) -> str:
        return "volume_id string, record_no bigint, record binary"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the two formats known to a session."""
    spark.dataSource.register(VolumeClusters)
    spark.dataSource.register(VolumeRecords)


def image_clusters(spark: SparkSession, path: str, volume_id: str = "C", **options) -> DataFrame:
    """The clusters of an image; ``ranges`` and ``partition_bytes`` among the options."""
    register(spark)
    return spark.read.format("volume_clusters").options(path=path, volume_id=volume_id, **options).load()


def image_records(spark: SparkSession, path: str, volume_id: str = "C", in_use: bool = False, **options) -> DataFrame:
    """The file records of an image, decoded; torn and malformed ones are left out."""
    register(spark)
    raw = spark.read.format("volume_records").options(path=path, volume_id=volume_id, in_use=str(in_use).lower(), **options).load()
    return read_file_records(raw)
