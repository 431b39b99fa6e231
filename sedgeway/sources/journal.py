"""A volume's change journal as a source: by batch, and as a stream that resumes at (journal id, USN).

``path`` is a folder with the journal's two streams as files: ``$J``, in which a record's place is its USN, and ``$Max``, which
names the journal and its first valid USN. The folder may lie in any store that pyarrow opens and every executor can
reach. ``spark.readStream.format("change_journal")`` reads on from ``start_usn`` of ``journal_id``, from the first valid record,
or with ``start=latest`` from the end; afterwards from the stream's checkpoint.

Where the journal isn't the one of the last position any more, or no longer holds it, changes are lost: the stream then gives one
row with ``rescan`` set, whose usn is where it goes on, and nothing of before. ``journal_stream.maintain`` scans such a volume again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sedgeway import schemas as S
from sedgeway.functions.binary import journal_records
from sedgeway.sources.image import Opened

#: Bytes of a page, which no record crosses. Fixed value.
PAGE = 4096
#: Bytes that a task reads at most, and at a time.
PARTITION_BYTES, READ_BYTES = 64 << 20, 1 << 20
SCHEMA = T.StructType([*S.JOURNAL.fields, T.StructField("journal_id", T.LongType()), T.StructField("rescan", T.BooleanType())])


@dataclass
class Position:
    """A journal as it is now: its id, the first USN that is still there, and the one after its last whole record."""

    journal_id: int
    first: int
    next: int


def position(path: str) -> Position:
    """The state of the journal in a folder; ValueError if its head is cut short."""
    with Opened(f"{path}/$Max") as head:
        if head.size < 32:
            raise ValueError("the head of the journal is cut short")
        journal_id, first = struct.unpack_from("<qq", head.at(0, 32), 16)
    with Opened(f"{path}/$J") as j:
        page = max(0, j.size - 1) // PAGE * PAGE
        last = [*_records(j.at(page, j.size - page), page)] if j.size else []
        after = last[-1][1] if last else page
    return Position(journal_id, first, max(first, after))


def _records(data: bytes, usn: int) -> Iterator[tuple[dict, int]]:
    """(record, USN after it) of the records from place ``usn`` on; a page counts up to its first record that isn't whole or stands elsewhere."""
    at = 0
    while at < len(data):
        stop = min(len(data), ((usn + at) // PAGE + 1) * PAGE - usn)
        place = at
        for r in journal_records(data[at:stop]):
            if r["usn"] != usn + place:
                break
            place += struct.unpack_from("<I", data, place)[0]
            yield r, usn + place
        at = stop


@dataclass
class Range(InputPartition):
    """The records from ``low`` to before ``high``; ``lost``: none can be had, all is to be scanned again."""

    journal_id: int
    low: int
    high: int
    lost: bool = False


def _ranges(journal_id: int, low: int, high: int, most: int) -> list[Range]:
    edges = [low, *range((low // PAGE * PAGE // most + 1) * most, high, most), high]
    return [Range(journal_id, a, b) for a, b in zip(edges, edges[1:]) if a < b]


class _Journal:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a journal needs a path")
        self.path, self.volume = options["path"], options.get("volume_id", "C")
        self.most = max(PAGE, int(options.get("partition_bytes", PARTITION_BYTES)) // PAGE * PAGE)
        self.options = dict(options)

    def rows(self, p: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(SCHEMA)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow], schema=arrow)

        if p.lost:
            yield batch([{"volume_id": self.volume, "usn": p.high, "journal_id": p.journal_id, "rescan": True}])
            return
        with Opened(f"{self.path}/$J") as j:
            low = p.low
            while low < p.high:  # a few pages at a time
                high = min(p.high, low // PAGE * PAGE + READ_BYTES)
                found = [r | {"volume_id": self.volume, "journal_id": p.journal_id, "rescan": False} for r, _ in _records(j.at(low, high - low), low)]
                if found:
                    yield batch(found)
                low = high


class JournalReader(_Journal, DataSourceReader):
    def partitions(self) -> list[Range]:
        now = position(self.path)
        low = max(now.first, int(self.options.get("start_usn", now.first)))
        high = min(now.next, int(self.options.get("until_usn", now.next)))
        return _ranges(now.journal_id, low, high, self.most) or [Range(now.journal_id, low, low)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class JournalStream(_Journal, DataSourceStreamReader):
    """Offsets are (journal id, USN): of the first record that hasn't been read."""

    def initialOffset(self) -> dict:
        now = position(self.path)
        if "start_usn" in self.options:
            return {"journal_id": int(self.options.get("journal_id", now.journal_id)), "usn": int(self.options["start_usn"])}
        return {"journal_id": now.journal_id, "usn": now.next if self.options.get("start") == "latest" else now.first}

    def latestOffset(self) -> dict:
        now = position(self.path)
        return {"journal_id": now.journal_id, "usn": now.next}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        now = position(self.path)
        if start["journal_id"] != end["journal_id"] or end["journal_id"] != now.journal_id or start["usn"] < now.first or start["usn"] > end["usn"]:
            return [Range(end["journal_id"], end["usn"], end["usn"], lost=True)]
        return _ranges(end["journal_id"], start["usn"], end["usn"], self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing: the journal drops its own past."""


class ChangeJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_journal"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options)

    def streamReader(self, schema) -> JournalStream:
        return JournalStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ChangeJournal)
