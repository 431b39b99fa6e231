import struct

import pytest

from sedgeway import schemas as S
from sedgeway.operators.journal import resume_points
from sedgeway.sources import journal as J
from sedgeway.streaming.journal_stream import maintain


class Folder:
    """A journal on disk: records at the places that are their USNs, padded to pages."""

    def __init__(self, path, journal_id=7, first=0):
        self.path, self.data, self.journal_id, self.first = path, bytearray(first), journal_id, first
        path.mkdir(exist_ok=True)
        self.write()

    def add(self, record, name, reason=S.FILE_CREATE | S.CLOSE, parent=5):
        text = name.encode("utf-16-le")
        n = (60 + len(text) + 7) // 8 * 8
        if len(self.data) % J.PAGE + n > J.PAGE:
            self.data += bytes(J.PAGE - len(self.data) % J.PAGE)
        usn = len(self.data)
        self.data += struct.pack("<IHHQQqqIIIIHH", n, 2, 0, 1 << 48 | record, parent, usn, 132_000_000_000_000_000, reason, 0, 0, 0x20, len(text), 60).ljust(60, b"\0") + text + bytes(n - 60 - len(text))
        return usn

    def write(self, half=b""):
        (self.path / "$J").write_bytes(bytes(self.first) + bytes(self.data[self.first :]) + half)
        (self.path / "$Max").write_bytes(struct.pack("<qqqq", 1 << 25, 1 << 20, self.journal_id, self.first))
        return self


def run(spark, folder, tmp_path, **options):
    """The rows that a run of the stream gives, from its checkpoint on."""
    J.register(spark)
    rows = []
    stream = spark.readStream.format("change_journal").options(path=str(folder.path), volume_id="C", **options).load()
    query = stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows


def test_a_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    folder = Folder(tmp_path / "j")
    usns = [folder.add(100 + i, f"file {i} " + "x" * (i % 50)) for i in range(300)]
    folder.write(half=struct.pack("<IHH", 200, 2, 0) + b"half of a record")
    first = run(spark, folder, tmp_path, partition_bytes="8192")
    assert sorted(r.usn for r in first) == usns and {(r.volume_id, r.journal_id, r.rescan) for r in first} == {("C", 7, False)}
    assert {r.usn: (r.record_no, r.name, r.sequence) for r in first}[usns[9]] == (109, "file 9 " + "x" * 9, 1)
    assert run(spark, folder, tmp_path) == []  # nothing new
    more = [folder.add(900 + i, f"later {i}") for i in range(50)]
    folder.write()
    assert sorted(r.usn for r in run(spark, folder, tmp_path)) == more
    # The journal has been made anew: one row says so, and the stream goes on in the new one.
    other = Folder(tmp_path / "j", journal_id=8)
    other.add(1, "unseen")
    other.write()
    lost = run(spark, other, tmp_path)
    assert [(r.rescan, r.journal_id, r.usn, r.name) for r in lost] == [(True, 8, len(other.data), None)]
    seen = other.add(2, "seen")
    other.write()
    assert [(r.usn, r.name, r.rescan) for r in run(spark, other, tmp_path)] == [(seen, "seen", False)]
    # It has wrapped past the position.
    for i in range(400):
        other.add(i, "much more")
    other.first = 5 * J.PAGE
    other.write()
    assert [r.rescan for r in run(spark, other, tmp_path)] == [True]


def test_a_stream_starts_where_it_is_told_to(spark, tmp_path):
    folder = Folder(tmp_path / "j", first=2 * J.PAGE)
    usns = [folder.add(i, f"n{i}") for i in range(20)]
    folder.write()
    assert J.position(str(folder.path)) == J.Position(7, 2 * J.PAGE, len(folder.data))
    assert [r.usn for r in run(spark, folder, tmp_path / "a", start_usn=str(usns[15]), journal_id="7")] == usns[15:]
    assert [r.rescan for r in run(spark, folder, tmp_path / "b", start_usn=str(usns[15]), journal_id="6")] == [True]
    assert [r.rescan for r in run(spark, folder, tmp_path / "c", start_usn="100")] == [True]
    assert run(spark, folder, tmp_path / "d", start="latest") == []
    batch = spark.read.format("change_journal").options(path=str(folder.path)).load()
    assert sorted(r.usn for r in batch.collect()) == usns and spark.read.format("change_journal").options(path=str(folder.path), until_usn=str(usns[3])).load().count() == 3
    empty = Folder(tmp_path / "e")
    assert J.position(str(empty.path)) == J.Position(7, 0, 0) and spark.read.format("change_journal").options(path=str(empty.path)).load().count() == 0
    (empty.path / "$Max").write_bytes(b"short")
    with pytest.raises(ValueError):
        J.position(str(empty.path))


def test_lost_changes_are_scanned_again(spark, tmp_path):
    folder = Folder(tmp_path / "j")
    folder.add(50, "new.txt")
    folder.write()
    J.register(spark)
    cols = "volume_id string, entry_id long, parent_id long, name string, is_dir boolean, hidden boolean, system boolean, reparse boolean, deleted boolean, metadata_known boolean, size long, modified timestamp_ntz, record_no long, full_path string"
    row = lambda i, name: ("C", i, 0, name, False, False, False, False, False, True, 1, None, i, f"C:\\{name}")
    saved = {"now": spark.createDataFrame([row(1, "old.txt")], cols)}
    seen = []

    def save(entries, deletions, batch_id):
        rows = entries.select("volume_id", "record_no", "name").collect()
        seen.append(sorted(r.name for r in rows))
        saved["now"] = spark.createDataFrame([row(r.record_no, r.name) for r in rows], cols)

    def go(rescan=None):
        stream = spark.readStream.format("change_journal").options(path=str(folder.path), volume_id="C").load()
        maintain(stream, lambda: saved["now"], save, str(tmp_path / "checkpoint"), rescan=rescan).awaitTermination()

    go()
    assert seen == [["new.txt", "old.txt"]]
    folder = Folder(tmp_path / "j", journal_id=9)
    go(rescan=lambda volumes: spark.createDataFrame([row(3, "scanned.txt")], cols).filter(f"volume_id in ('{volumes[0]}')"))
    assert seen[-1] == ["scanned.txt"]


def test_resume_points(spark):
    volumes = spark.createDataFrame([("A", "Turbo", 1, 50), ("B", "Turbo", 1, 50), ("C", "Turbo", 1, 5), ("D", "Standard", 1, 50), ("E", "Turbo", 1, 50), ("F", None, None, None), ("G", "Turbo", None, 50)], "volume_id string, mode string, journal_id long, next_usn long")
    journals = spark.createDataFrame([("A", 1, 50, 90), ("B", 2, 10, 90), ("C", 1, 10, 90), ("D", 1, 10, 90), ("F", 1, 10, 90), ("G", 1, 10, 90)], "volume_id string, journal_id long, first_usn long, next_usn long")
    got = {r.volume_id: (r.resume, r.start_usn, r.reason) for r in resume_points(volumes, journals).collect()}
    assert got == {
        "A": (True, 50, None), "B": (False, 90, "another journal"), "C": (False, 90, "records are gone"), "D": (False, 90, "not indexed by journal"), "E": (False, None, "no journal"), "F": (False, 90, "not indexed by journal"), "G": (False, 90, "another journal"),
    }
