"""Trees, journal, recovery, sources, exports and the stream."""

import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sedgeway import schemas as S
from sedgeway.functions import binary as B
from sedgeway.functions import names as N
from sedgeway.operators import carve, export
from sedgeway.operators import journal as J
from sedgeway.operators import recovery as R
from sedgeway.operators.tree import build, delete_subtrees, exclude_folders, resolve
from sedgeway.sources import entries as E
from sedgeway.sources import raw

T0 = datetime(2026, 1, 1)


def test_names(spark):
    cases = {"a.PDF": ("pdf", "Document"), ".hidden": ("", "Other"), "x.": ("", "Other"), "a.b.PS1": ("ps1", "App"), "dir.pdf": ("pdf", "Folder"), "noext": ("", "Other"), "x.key": ("key", "Document")}
    df = E.derive(spark.createDataFrame([(n, n == "dir.pdf") for n in cases], "name string, is_dir boolean"))
    assert {r.name: (r.ext, r.category) for r in df.collect()} == cases
    sizes = [(-1, "—"), (0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (150 * 1024, "150 KB"), (5 * 1024**3, "5.0 GB"), (3 * 1024**5, "3.0 PB")]
    out = spark.createDataFrame(sizes, "size long, want string").select("want", N.size_text(F.col("size")).alias("got")).collect()
    assert all(r.want == r.got for r in out)
    df = spark.createDataFrame([("$RABC123.txt", 1), ("$RABC12", 1), ("0000000000000007", 7), ("000100000000000700000000", 7), ("0000000000000007:x", 7), ("0000000000000008", 7)], "name string, record_no long")
    got = [(r.a, r.b) for r in df.select(N.is_recycled_name(F.col("name")).alias("a"), N.is_delete_marker(F.col("name"), F.col("record_no")).alias("b")).collect()]
    assert got == [(True, False), (False, False), (False, True), (False, True), (False, True), (False, False)]
    row = spark.createDataFrame([("a<b>?.txt. ", "  ", 'q"x,y')], "a string, b string, c string").select(N.safe_file_name(F.col("a")), N.safe_file_name(F.col("b")), N.csv_field(F.col("c"))).first()
    assert tuple(row) == ("a_b__.txt.", "unnamed", '"q""x,y"')
    noise = spark.createDataFrame([("~$a.doc", "C:\\x", False), ("a.TMP", "C:\\x", False), ("a.txt", "C:\\u\\Cache", False), ("a.txt", "C:\\x", False), ("a.tmp", "C:\\x", True)], "n string, p string, d boolean")
    assert [r[0] for r in noise.select(N.is_noise(F.col("n"), F.col("p"), F.col("d"))).collect()] == [True, True, True, False, False]


def test_trees(spark):
    rows = [(1, 0, "a", False), (2, 1, "b", True), (3, 2, "c", False), (10, 99, "lost", False), (11, 10, "under", False), (20, 21, "x", False), (21, 20, "y", False)]
    rows += [(100 + i, 1 if i == 0 else 99 + i, f"d{i}", False) for i in range(300)]
    df = spark.createDataFrame(rows, "entry_id long, parent_id long, name string, deleted boolean").repartition(3)
    roots = spark.createDataFrame([(0, "C:")], "root_id long, root string")
    got = {r.id: r for r in resolve(df, roots).collect()}
    assert got[3].full_path == "C:\\a\\b\\c" and got[3].depth == 3 and got[3].gone and not got[1].gone and got[2].gone
    assert got[10].state == got[11].state == "orphan" and got[20].state == got[21].state == "cycle" and got[11].depth == 1
    assert got[399].depth == 255 and got[399].full_path.endswith("d298\\d299") and len(got) == len(rows)
    assert {r.entry_id for r in delete_subtrees(df, roots).filter("deleted").collect()} == {2, 3, 10, 11, 20, 21}
    built = build(spark.createDataFrame([(100, 50, "child.txt"), (50, 5, "dir"), (200, 999, "orphan.txt")], "record_no long, parent_record_no long, name string")).collect()
    assert {r.record_no: (r.full_path, r.deleted) for r in built} == {100: ("\\dir\\child.txt", False), 50: ("\\dir", False), 200: ("orphan.txt", True)}
    paths = spark.createDataFrame([("c:\\a",), ("c:\\a\\b",), ("c:\\ab",)], "fold_path string")
    assert [r.fold_path for r in exclude_folders(paths, ["C:\\A\\"]).collect()] == ["c:\\ab"]


def entry(i, parent, name, is_dir=False, path=None, size=5):
    return ("C", i, parent, name, is_dir, False, False, False, False, True, size, T0, i, path or f"C:\\{name}")


ENTRY = "volume_id string, entry_id long, parent_id long, name string, is_dir boolean, hidden boolean, system boolean, reparse boolean, deleted boolean, metadata_known boolean, size long, modified timestamp_ntz, record_no long, full_path string"


def change(usn, record, name, reason, parent=30, attributes=0, seconds=0):
    return ("C", usn, T0 + timedelta(seconds=seconds), record, 1, parent, reason | S.CLOSE, attributes, name)


def test_a_batch_of_changes(spark):
    entries = spark.createDataFrame([entry(30, 0, "Docs", True), entry(40, 30, "a.txt", path="C:\\Docs\\a.txt"), entry(41, 30, "b.txt", path="C:\\Docs\\b.txt"), entry(42, 30, "c.txt", path="C:\\Docs\\c.txt"), entry(43, 30, "d.txt", path="C:\\Docs\\d.txt")], ENTRY)
    journal = spark.createDataFrame(
        [
            change(1, 40, "a.txt", S.FILE_DELETE), change(2, 41, "b2.txt", S.RENAME_NEW_NAME), change(3, 42, "$RABC123.txt", S.RENAME_NEW_NAME, parent=777), change(4, 50, "new.txt", S.FILE_CREATE),
            change(5, 43, "d.txt", S.DATA_EXTEND), change(6, 60, "far.txt", S.FILE_CREATE, parent=888), change(7, 61, "gone.txt", S.FILE_DELETE, parent=888),
        ],
        S.JOURNAL,
    )
    after, log = J.apply_batch(entries, journal)
    assert {r.record_no: r.name for r in after.collect()} == {30: "Docs", 41: "b2.txt", 50: "new.txt", 43: "d.txt"}
    assert {r.name: (r.kind, r.parent_path, r.size) for r in log.collect()} == {"a.txt": ("Deleted", "C:\\Docs", 5), "c.txt": ("Recycled", "C:\\Docs", 5)}
    assert J.refresh_due(journal).count() == 1 and J.has_gap(journal, 0) and not J.has_gap(journal, 1) and J.until(journal, 3).count() == 2
    again = J.retag(log.unionByName(log.withColumn("usn", F.col("usn") + 10)), log.select("volume_id", "record_no", "sequence", F.lit("Replaced").alias("kind")))
    assert sorted((r.usn, r.kind) for r in again.filter("name = 'a.txt'").collect()) == [(1, "Deleted"), (11, "Replaced")]


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for i in range(60):
        rows.append(change(2 * i, 100 + i % 7, f"f{i % 5}.txt", S.FILE_DELETE if i % 3 else S.FILE_CREATE, seconds=i * (1 if i % 4 else 3)))
    rows.append(change(1000, 999, "end.txt", S.FILE_CREATE, seconds=100_000))
    df = spark.createDataFrame(rows, S.JOURNAL)
    for k in range(3):
        df.filter(F.floor(F.col("usn") / 40) == k if k < 2 else F.col("usn") >= 80).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    from sedgeway.streaming import journal_stream as J2

    source = spark.readStream.schema(S.JOURNAL).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = J2.deletions_with_kind(source, seconds=4).writeStream.format("memory").queryName("kinds").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.usn, r.kind) for r in spark.table("kinds").collect()}
    event = F.when(J.has(S.FILE_DELETE), "delete").otherwise("create")
    want = {(r.usn, r.kind) for r in J.replaced(df.withColumn("event", event), seconds=4).collect()}
    assert len(want) > 10 and {k for _, k in want} == {"Deleted", "Replaced"} and got == want


def test_maintained_entries(spark, tmp_path):
    from sedgeway.streaming import journal_stream as J2

    spark.createDataFrame([change(1, 40, "a.txt", S.FILE_DELETE), change(2, 50, "new.txt", S.FILE_CREATE)], S.JOURNAL).write.parquet(f"{tmp_path}/in")
    entries = spark.createDataFrame([entry(30, 0, "Docs", True), entry(40, 30, "a.txt")], ENTRY)
    saved = {}
    q = J2.maintain(J2.read_stream(spark, f"{tmp_path}/in"), lambda: entries, lambda e, d, i: saved.update({i: ({r.name for r in e.collect()}, {r.name for r in d.collect()})}), f"{tmp_path}/ck")
    q.awaitTermination()
    assert saved == {0: ({"Docs", "new.txt"}, {"a.txt"})}


def record(no, name="f", runs=((0, 10, 4),), real=16384, initialized=0, flags=0, resident=False, is_dir=False, unit=0, parent=5, pseq=1, seq=1, in_use=False):
    return ("C", no, seq, in_use, is_dir, 0, parent, pseq, name, real, initialized, None, flags, unit, resident, b"hello" if resident else None, list(runs), None, None)


def test_grades(spark):
    alloc = spark.createDataFrame([("C", 100, 4), ("C", 200, 2), ("C", 4090, 10)], "volume_id string, start_lcn long, len long")
    cases = [
        (record(20), "Excellent", 100), (record(21, flags=R.FLAG_ENCRYPTED), "Encrypted", 0), (record(22, is_dir=True), "Excellent", 100), (record(23, resident=True, real=5), "Excellent", 100), (record(24, runs=((0, -5, 4),)), "Unknown", 0),
        (record(25, runs=(), real=0), "Excellent", 100), (record(26, runs=()), "Unknown", 0), (record(27, flags=1, unit=99), "Unknown", 0), (record(28, runs=((0, -1, 4),)), "Excellent", 100), (record(29, runs=((0, 100, 4),)), "Overwritten", 0),
        (record(30, runs=((0, 200, 4),)), "Partial", 50), (record(31, runs=((0, 300, 4),)), "Zeroed", 0), (record(32, runs=((0, 400, 4),)), "Good", 100), (record(33, runs=((0, 200, 4),), initialized=1), "Overwritten", 0),
        (record(34, runs=((0, 4088, 8),), real=32768), "Partial", 25), (record(35, runs=((0, 9_998, 4),)), "Unknown", 0), (record(36, runs=((0, 300, 4), (4, -1, 9_997))), "Unknown", 0),
        (record(37, flags=1, unit=4, runs=((0, 500, 16),)), "Excellent", 100), (record(38, flags=1, unit=3, runs=((0, 500, 16),)), "Unknown", 0),
    ]
    heads = spark.createDataFrame([("C", 300, True, None), ("C", 400, False, False), ("C", 10, False, True)], "volume_id string, lcn long, zero boolean, header_ok boolean")
    got = {r.record_no: (r.grade, r.percent_intact) for r in R.grade(spark.createDataFrame([c[0] for c in cases], S.MFT_RECORDS), alloc, heads, total_clusters=10_000).collect()}
    assert got == {c[0][1]: c[1:] for c in cases}


def test_folders_of_deleted_files(spark):
    records = spark.createDataFrame(
        [record(20, "a", parent=30, pseq=3), record(30, "d1", is_dir=True, seq=4, parent=31, pseq=1), record(31, "d2", is_dir=True, seq=1, parent=40), record(21, "b", parent=40), record(22, "c", parent=77), record(23, "e", parent=30, pseq=9)],
        S.MFT_RECORDS,
    )
    live = spark.createDataFrame([("C", 40, "C:\\Live")], "volume_id string, record_no long, full_path string")
    got = {r.name: r.original_folder for r in R.with_folders(records, live, records).collect()}
    assert got == {"a": "C:\\Live\\d2\\d1", "d1": "C:\\Live\\d2", "d2": "C:\\Live", "b": "C:\\Live", "c": None, "e": None}
    assert {r.name for r in R.deleted_records(spark.createDataFrame([record(20), record(21, in_use=True), record(3), record(22, "$x"), record(23, "$x", parent=9), record(24, None)], S.MFT_RECORDS)).collect()} == {"f", "$x"}


def test_bitmap_runs(spark):
    bits = R.bitmap_bits(spark.createDataFrame([("C", 0, b"\x03\xf0"), ("C", 2, b"\xff\x00")], "volume_id string, first_byte long, bytes binary"))
    assert sorted((r.start_lcn, r.len) for r in R.free_runs(bits).collect()) == [(2, 10), (24, 8)]
    alloc = spark.createDataFrame([("C", 0, 2), ("C", 12, 12)], "volume_id string, start_lcn long, len long")
    assert sorted((r.start_lcn, r.len) for r in R.free_runs_from_alloc(alloc, 32).collect()) == [(2, 10), (24, 8)]


def test_lists(spark):
    plan = spark.createDataFrame([("C:\\x", "a.txt"), ("C:\\x", "A.txt"), ("C:\\x", "a.TXT"), ("C:\\y", "a.txt")], "folder string, name string")
    assert sorted(r.target for r in R.unique_names(plan).collect()) == ["A.txt", "a (restored) 2.txt", "a (restored).TXT", "a.txt"]
    c = spark.createDataFrame([("x", "Partial", 50, 100, "f"), ("y", "Excellent", 100, 0, "f")], "name string, grade string, percent_intact int, size long, original_folder string")
    assert [r.name for r in c.orderBy(*R.candidate_order()).collect()] == ["y", "x"] and R.worst_grade(c).first().worst == "Partial" and R.intact_estimate(c).first().percent == 50
    e = spark.createDataFrame([(1, "c:\\a\\b", "b", False), (2, "c:\\a\\b", "b", False), (1, "c:\\a\\d", "d", True), (1, "c:\\z", "z", False)], "snapshot_id int, fold_path string, fold string, is_dir boolean")
    snaps = spark.createDataFrame([(1, T0), (2, T0 + timedelta(1))], "snapshot_id int, created timestamp_ntz")
    assert [r.snapshot_id for r in R.versions_of(e, snaps, "C:\\A\\B").collect()] == [2, 1] and [r.fold for r in R.list_folder(e, 1, "C:\\a").collect()] == ["d", "b"]


def journal_bytes(major, ref, parent, usn, reason, name):
    text = name.encode("utf-16-le")
    if major == 2:
        body = struct.pack("<QQqqIIIIHH", ref, parent, usn, 132_000_000_000_000_000, reason, 0, 0, 0x20, len(text), 60) + text
    else:
        body = struct.pack("<QQQQqqIIIIHH", ref, 0, parent, 0, usn, 132_000_000_000_000_000, reason, 0, 0, 0x20, len(text), 76) + text
    n = (8 + len(body) + 7) // 8 * 8
    return (struct.pack("<IHH", n, major, 0) + body).ljust(n, b"\0")


def test_raw_journals_and_bins(spark):
    buffer = journal_bytes(2, 7 << 48 | 42, 5, 1000, S.FILE_DELETE, "é.txt") + journal_bytes(3, 9, 42, 1001, S.FILE_CREATE, "b") + b"\x01\0\0\0bad....."
    rows = raw.read_journal(spark.createDataFrame([("C", buffer), ("D", None)], "volume_id string, buffer binary")).collect()
    assert [(r.volume_id, r.usn, r.record_no, r.sequence, r.parent_record_no, r.name, r.ts.year) for r in rows] == [("C", 1000, 42, 7, 5, "é.txt", 2019), ("C", 1001, 9, 0, 42, "b", 2019)]
    path = "C:\\x\\é.txt\0".encode("utf-16-le")
    v2 = struct.pack("<qqqI", 2, 77, 132_000_000_000_000_000, len(path) // 2) + path
    v1 = struct.pack("<qqq", 1, 5, 132_000_000_000_000_000) + "C:\\old.txt".encode("utf-16-le").ljust(520, b"\0")
    assert B.bin_metadata(v2)["original_path"] == "C:\\x\\é.txt" and B.bin_metadata(v1)["size"] == 5 and B.bin_metadata(v2[:30]) is None and B.bin_metadata(b"") is None
    files = spark.createDataFrame([("S", "$Iabc.txt", v2), ("S", "$Ibad.txt", b"x")], "sid string, name string, content binary")
    assert [r.original_path for r in raw.read_bin(files).collect()] == ["C:\\x\\é.txt"]


def file_record_bytes(no_sectors=2, torn=False):
    name = "a.txt".encode("utf-16-le")
    fn = struct.pack("<QqqqqqqIIBB", 3 << 48 | 5, 0, 0, 0, 0, 0, 700, 0, 0, 5, 1) + name
    attr1 = struct.pack("<IIBBHHHIHH", 0x30, (24 + len(fn) + 7) // 8 * 8, 0, 0, 24, 0, 0, len(fn), 24, 0) + fn
    attr1 = attr1.ljust((len(attr1) + 7) // 8 * 8, b"\0")
    runs = bytes([0x21, 0x04, 0x34, 0x12, 0x01, 0x02, 0])
    attr2 = struct.pack("<IIBBHHHqqHHIqqq", 0x80, 72, 1, 0, 64, 0, 0, 0, 5, 64, 0, 0, 24576, 20000, 19000) + runs + b"\0"
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, no_sectors + 1, 0, 9, 1, 56, 0, 56 + len(attr1) + len(attr2) + 4, 1024, 0, 0, 0, 0)
    body = bytearray((head + struct.pack("<HHH", 7, 0xAAAA, 0xBBBB) + b"\0\0" + attr1 + attr2 + b"\xff\xff\xff\xff").ljust(512 * no_sectors, b"\0"))
    for i in range(no_sectors):
        body[512 * (i + 1) - 2 : 512 * (i + 1)] = struct.pack("<H", 8 if torn and i else 7)
    return bytes(body)


def test_raw_file_records(spark):
    df = spark.createDataFrame([("C", 64, file_record_bytes()), ("C", 65, file_record_bytes(torn=True)), ("C", 66, b"x")], "volume_id string, record_no long, record binary")
    r = raw.read_file_records(df).collect()
    assert len(r) == 1 and r[0].name == "a.txt" and r[0].parent_record == 5 and r[0].parent_sequence == 3 and r[0].sequence == 9 and not r[0].in_use
    assert (r[0].real_size, r[0].initialized_size) == (20000, 19000) and [(x.vcn, x.lcn, x.clusters) for x in r[0].runs] == [(0, 0x1234, 4), (4, -1, 2)]


def test_carving_and_recovery(spark):
    import gzip
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", bytes(6000)) + chunk(b"IEND", b"")
    gz = gzip.compress(bytes(range(256)) * 10)
    image = bytearray(64 * 4096)
    image[4 * 4096 : 4 * 4096 + len(png)] = png
    image[20 * 4096 : 20 * 4096 + len(gz)] = gz
    clusters = spark.createDataFrame([("C", i, bytes(image[i * 4096 : (i + 1) * 4096])) for i in range(64)], "volume_id string, lcn long, data binary")
    runs = spark.createDataFrame([("C", 2, 10), ("C", 16, 20)], "volume_id string, start_lcn long, len long")
    found = {r.start_lcn: (r.type_id, r.size, r.info, r.suggested_name) for r in carve.scan(clusters, runs).collect()}
    assert found == {4: ("png", len(png), "3×2", "png_4.png"), 20: ("gz", len(gz), None, "gz_20.gz")}
    records = spark.createDataFrame([record(20, runs=((0, 4, 2),), real=len(png)), record(21, runs=((0, 20, 1), (1, -1, 1)), real=5000, initialized=len(gz)), record(22, resident=True, real=5, runs=())], S.MFT_RECORDS)
    got = {r.record_no: bytes(r.content) for r in carve.recover(records, clusters).collect()}
    assert got == {20: png, 21: gz.ljust(5000, b"\0"), 22: b"hello"}
    heads = spark.createDataFrame([("a.png", png[:16]), ("a.png", b"xxxx"), ("a.zzz", b"x"), ("b", bytes(8))], "name string, head binary")
    assert [(r.header_ok, r.zero) for r in carve.header_check(heads).collect()] == [(True, False), (False, False), (None, False), (None, True)]
    bmp = b"BM" + struct.pack("<IIIIii", 1000, 0, 54, 40, 2, 2) + bytes(10)
    native = spark.createDataFrame([(bmp,), (b"7z\xbc\xaf\x27\x1c" + bytes(6) + struct.pack("<QQ", 5, 6) + bytes(8),), (b"zz",)], "b binary").select(carve.header_size(F.col("b")).alias("h")).collect()
    assert [(r.h and (r.h.type_id, r.h.size)) for r in native] == [("bmp", 1000), ("7z", 43), None]


def test_compressed_units():
    import pytest

    packed = struct.pack("<H", 0xB000 | 6) + bytes([0b00001000]) + b"abc" + struct.pack("<H", 2 << 12 | 3) + b"z"
    assert B.lznt1(packed, 100) == b"abcabcabcz" and B.lznt1(struct.pack("<H", 0x3003) + b"wxyz", 3) == b"wxy" and B.lznt1(b"\0\0junk", 9) == b""
    with pytest.raises(ValueError):
        B.lznt1(struct.pack("<H", 0xB002) + bytes([1]) + struct.pack("<H", 5), 100)
    unit = packed.ljust(4096, b"\0")
    assert carve.rebuild(10, None, [(0, 7, 1), (1, -1, 15)], {7: unit}, 4096, unit=4) == b"abcabcabcz"
    with pytest.raises(ValueError):
        B.data_runs(bytes([0x09, 1]))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(5, 3, 5, 'a,"b".txt', "C:\\Docs", 10, False, T0, "Deleted", 77)], "record_no long, sequence int, parent_record_no long, name string, parent_path string, size long, is_dir boolean, deleted_at timestamp_ntz, kind string, usn long")
    line = '2026-01-01T00:00:00Z,"a,""b"".txt",C:\\Docs,10,false,Deleted,5,3,77'
    assert export.csv_lines(df, export.DELETION_COLUMNS).first().line == line
    assert export.header_line(export.DELETION_COLUMNS) == "deleted_utc,name,parent_path,size,is_directory,kind,record_no,sequence,usn"
    export.write_csv(df.coalesce(1), export.DELETION_COLUMNS, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == export.header_line(export.DELETION_COLUMNS) + "\n" + line + "\n"
    rec = spark.createDataFrame([("C:\\a.txt", "D:\\a.txt", 5, "ab" * 32, "Excellent", "Undelete", None, False, None, T0, [(0, 4096, 8192), (4096, 4096, -1)])], "original_path string, recovered_path string, bytes long, sha256 string, final_grade string, source string, error string, is_dir boolean, modified timestamp_ntz, deleted_at timestamp_ntz, runs array<struct<file_offset:long,len:long,img_offset:long>>")
    xml = export.dfxml(rec, "C:", T0, T0)
    assert '<byte_run file_offset="0" len="4096" img_offset="8192" />' in xml and '<byte_run file_offset="4096" len="4096" />' in xml and '<hashdigest type="sha256">' + "ab" * 32 in xml and "<dtime>2026-01-01T00:00:00Z</dtime>" in xml


def test_snapshots_and_scans(spark, tmp_path):
    cols = [f.name for f in S.ENTRIES.fields]
    entries = spark.createDataFrame([entry(1, 0, "a"), entry(2, 0, "b")], ENTRY).select(*cols)
    E.save_snapshot(entries, f"{tmp_path}/snap")
    assert sorted(map(tuple, E.load_snapshot(spark, f"{tmp_path}/snap").collect())) == sorted(map(tuple, entries.collect()))
    entries.limit(1).write.mode("overwrite").partitionBy("volume_id").parquet(f"{tmp_path}/snap/entries")
    assert E.load_snapshot(spark, f"{tmp_path}/snap") is None and E.load_snapshot(spark, f"{tmp_path}/none") is None
    top = tmp_path / "tree"
    (top / "x" / "y").mkdir(parents=True)
    (top / "$Recycle.Bin").mkdir()
    (top / "x" / "y" / "f.txt").write_text("hello")
    (top / "g.txt").write_text("hi")
    rows = {r.name: (r.is_dir, r.size) for r in E.scan_tree(spark, str(top)).collect()}
    assert rows == {"x": (True, 0), "y": (True, 0), "f.txt": (False, 5), "g.txt": (False, 2)}
    df, name, why = raw.first_readable(spark, {"missing": lambda: spark.read.parquet(f"{tmp_path}/nope"), "range": lambda: spark.range(3)})
    assert name == "range" and why.startswith("missing") and df.count() == 3
    found = E.fill_metadata(spark.createDataFrame([(1, 9, "A.txt", False, 0, None)], "entry_id long, parent_id long, name string, metadata_known boolean, size long, modified timestamp_ntz"), spark.createDataFrame([(9, "a.TXT", 42, T0)], "parent_id long, name string, size long, modified timestamp_ntz")).first()
    assert (found.size, found.metadata_known) == (42, True)


def test_files_of_more_than_64_mib_are_carved(spark, monkeypatch):
    def bmp(size):
        return (b"BM" + struct.pack("<IHHI", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 16, 64, 1, 32, 0, 0, 0, 0, 0, 0)).ljust(size, b"x")

    big = 65 << 20
    assert [(c, f.id, n) for c, f, n, _ in carve.scan_bytes(bytes(4096) + bmp(big) + bytes(8192))] == [(1, "bmp", big)]
    assert carve.MAX_WINDOW == 512 << 20  # as the reference's
    # Files longer than what is read of a place at first, and one inside another over the border of a block.
    data = (bytes(512 * 3) + bmp(512 * 13) + bmp(512 * 12)).ljust(512 * 200, b"\0")
    inner = 512 * 60
    data = data[:inner] + bmp(512 * 12)[: 512 * 7] + bmp(512 * 2) + bytes(512 * 3) + data[inner + 512 * 12 :]
    clusters = spark.createDataFrame([("v", i, data[512 * i : 512 * i + 512]) for i in range(200)], "volume_id string, lcn long, data binary")
    runs = spark.createDataFrame([("v", 0, 200)], "volume_id string, start_lcn long, len long")
    expected = [(c, n) for c, _, n, _ in carve.scan_bytes(data, 512)]
    assert expected == [(3, 512 * 13), (16, 512 * 12), (60, 512 * 12)]
    for block in (8, 16, 64, 1 << 16):
        assert sorted((r.start_lcn, r.size) for r in carve.scan(clusters, runs, 512, block=block).collect()) == expected


def test_names_that_are_taken_are_passed_over(spark):
    plan = spark.createDataFrame([("f", "a.txt"), ("f", "A.txt"), ("f", "a (restored).txt"), ("f", "b"), ("g", "b")], "folder string, name string")
    taken = spark.createDataFrame([("f", "B"), ("f", "b (restored)")], "folder string, name string")
    rows = R.unique_names(plan, taken=taken).collect()
    targets = [(r.folder, r.target.lower()) for r in rows]
    assert len(set(targets)) == 5 and not {("f", "b"), ("f", "b (restored)")} & set(targets) and ("g", "b") in targets and ("f", "b (restored) 2") in targets


def test_free_runs_over_block_borders(spark):
    import random

    rng = random.Random(5)
    bits = [(v, i, rng.random() < 0.3 if v == "C" else 10 <= i < 12) for v in "CD" for i in range(200)]
    want = []
    for v in "CD":
        row = [b for x, _, b in bits if x == v] + [True]
        at = None
        for i, b in enumerate(row):
            if not b and at is None:
                at = i
            elif b and at is not None:
                want.append((v, at, i - at))
                at = None
    df = spark.createDataFrame(bits, "volume_id string, lcn long, allocated boolean")
    for block in (1, 7, 8, 1000):
        assert sorted((r.volume_id, r.start_lcn, r.len) for r in R.free_runs(df, block).collect()) == sorted(want)
    assert {r.volume_id: r.free_bytes for r in R.free_bytes(R.free_runs(df)).collect()}["D"] == 198 * 4096


def test_slots_from_the_nearest_record_in_use(spark):
    used = [3, 70_000, 70_001, 200_000]
    asked = [2, 3, 4, 69_999, 70_000, 70_002, 150_000, 200_000, 300_000]
    got = R.slots_as_of(spark.createDataFrame([("C", r) for r in asked] + [("D", 1)], "volume_id string, record_no long"), spark.createDataFrame([("C", r) for r in used], "volume_id string, record_no long")).collect()
    want = {("C", r): "Reused" if r in used else "Free" if any(u < r for u in used) else "Unknown" for r in asked} | {("D", 1): "Unknown"}
    assert {(r.volume_id, r.record_no): r.slot for r in got} == want


def test_a_batch_is_applied_in_order(spark):
    files = [entry(40 + i, 30, f"{c}.txt", path=f"C:\\Docs\\{c}.txt") for i, c in enumerate("abcde")]
    entries = spark.createDataFrame([entry(30, 0, "Docs", True), entry(31, 0, "Old", True), *files], ENTRY)
    journal = spark.createDataFrame(
        [
            change(1, 40, "a.txt", S.FILE_DELETE), change(2, 40, "again.txt", S.FILE_CREATE),  # deleted, then its record is used anew
            change(3, 41, "b2.txt", S.RENAME_NEW_NAME), change(4, 41, "b2.txt", S.FILE_DELETE),  # logged under its new name
            change(5, 42, "c.txt", S.RENAME_NEW_NAME, parent=999), change(6, 42, "c.txt", S.RENAME_NEW_NAME),  # moved out and back
            change(7, 60, "New", S.FILE_CREATE, attributes=S.ATTR_DIRECTORY), change(8, 61, "in.txt", S.FILE_CREATE, parent=60),  # a folder of the batch and its file
            change(9, 62, "short.txt", S.FILE_CREATE), change(10, 62, "short.txt", S.FILE_DELETE),
            change(11, 43, "d.txt", S.DATA_EXTEND), change(12, 63, "lost.txt", S.FILE_CREATE, parent=998),
        ],
        S.JOURNAL,
    )
    after, log = J.apply_batch(entries, journal)
    rows = {r.record_no: r for r in after.collect()}
    assert {k: r.name for k, r in rows.items()} == {30: "Docs", 31: "Old", 40: "again.txt", 42: "c.txt", 60: "New", 61: "in.txt", 43: "d.txt", 44: "e.txt"}
    assert rows[61].parent_id == 60 and rows[42].parent_id == 30 and not rows[43].metadata_known and rows[44].metadata_known and rows[40].size == 0 and rows[42].size == 0
    assert sorted((r.usn, r.name, r.kind, r.parent_path, r.size) for r in log.collect()) == [
        (1, "a.txt", "Deleted", "C:\\Docs", 5), (4, "b2.txt", "Deleted", "C:\\Docs", 5), (5, "c.txt", "Deleted", "C:\\Docs", 5), (10, "short.txt", "Deleted", "C:\\Docs", -1),
    ]


def test_unknown_records_are_adopted_by_name(spark):
    one = entry(77, 30, "Walked.TXT")
    at = ENTRY.fieldNames().index("record_no") if hasattr(ENTRY, "fieldNames") else [x.split()[0] for x in ENTRY.split(", ")].index("record_no")
    walked = tuple(None if i == at else v for i, v in enumerate(one))
    entries = spark.createDataFrame([entry(30, 0, "Docs", True), walked], ENTRY)
    after, log = J.apply_batch(entries, spark.createDataFrame([change(1, 500, "walked.txt", S.DATA_EXTEND), change(2, 500, "moved.txt", S.RENAME_NEW_NAME)], S.JOURNAL))
    assert {(r.entry_id, r.record_no, r.name) for r in after.collect()} == {(30, 30, "Docs"), (77, 500, "moved.txt")} and log.count() == 0


def test_advance_removes_what_hangs_from_deleted_folders(spark):
    entries = spark.createDataFrame([entry(30, 0, "Docs", True), entry(31, 30, "Sub", True), entry(40, 31, "a.txt"), entry(41, 0, "b.txt")], ENTRY)
    roots = spark.createDataFrame([(0, "C:")], "root_id long, root string")
    after, log = J.advance(entries, spark.createDataFrame([change(1, 30, "Docs", S.FILE_DELETE, parent=5), change(2, 41, "c.txt", S.RENAME_NEW_NAME, parent=5)], S.JOURNAL), roots)
    assert [(r.entry_id, r.full_path) for r in after.collect()] == [(41, "C:\\c.txt")] and log.count() == 1
    loop = spark.createDataFrame([change(1, 30, "Docs", S.RENAME_NEW_NAME, parent=31, attributes=S.ATTR_DIRECTORY)], S.JOURNAL)
    assert {r.entry_id for r in J.advance(entries, loop, roots)[0].collect()} == {41}


def test_deletion_log_is_merged_on_disk(spark, tmp_path):
    rows = [("C", i, 1, 5, f"f{i}", "C:", 1, False, None, T0, "Deleted", i) for i in range(30)]
    log = spark.createDataFrame(rows, S.DELETIONS)
    assert J.load_log(spark, f"{tmp_path}/log") is None
    J.save_log(log.filter("usn < 20"), f"{tmp_path}/log", 25)
    J.save_log(log.filter("usn >= 10"), f"{tmp_path}/log", 25)
    assert sorted(r.usn for r in J.load_log(spark, f"{tmp_path}/log").collect()) == list(range(5, 30))


def test_candidates_of_every_source_and_their_routes(spark):
    from sedgeway.operators import candidates as K

    log = spark.createDataFrame([("C", 1, 1, 5, "gone.txt", "", 3, False, None, T0, "Deleted", 1)], S.DELETIONS)
    pairs = R.recycle_pairs(
        spark.createDataFrame([("s", "$Iabc.txt", "C:\\Docs\\old.txt", 9, T0), ("s", "$Ixyz", "C:\\alone", 1, T0)], "sid string, name string, original_path string, size long, deleted_at timestamp_ntz"),
        spark.createDataFrame([("s", "$RABC.txt", False), ("s", "$Rqqq.bin", False)], "sid string, name string, is_dir boolean"),
    )
    graded = spark.createDataFrame([("r.doc", 7, T0, "Partial", 40, False), ("dir", 0, T0, "Excellent", 100, True)], "name string, size long, modified timestamp_ntz, grade string, percent_intact int, is_dir boolean")
    versions = spark.createDataFrame([("C:\\Docs\\v.txt", 4, T0, False, T0)], "full_path string, size long, modified timestamp_ntz, is_dir boolean, created timestamp_ntz")
    carved = spark.createDataFrame([("png_5.png", 11, "PNG image", "1x1", 5), ("mp3_9.mp3", 12, "MP3 audio", None, 9)], "suggested_name string, size long, label string, info string, start_lcn long")
    every = K.all_candidates(K.from_log(log), K.from_bin(pairs), K.from_undelete(graded), K.from_versions(versions), K.from_carving(carved))
    assert [f.name for f in every.schema] == [f.name for f in S.CANDIDATES]
    rows = {(r.source, r.name): r for r in every.collect()}
    assert rows["DeletionLog", "gone.txt"].original_folder is None and rows["DeletionLog", "gone.txt"].grade == "Unknown"
    assert rows["RecycleBin", "old.txt"].grade == "Excellent" and rows["RecycleBin", "old.txt"].original_folder == "C:\\Docs" and rows["RecycleBin", "alone"].detail == "its data is gone"
    assert rows["RecycleBin", "$Rqqq.bin"].detail.startswith("its name") and rows["ShadowCopy", "v.txt"].original_folder == "C:\\Docs" and rows["Carving", "png_5.png"].detail == "PNG image · 1x1" and rows["Carving", "mp3_9.mp3"].detail == "MP3 audio"
    done = {(r.source, r.name): r for r in K.route(every, "D:\\out", "C:\\").collect()}
    assert done["DeletionLog", "gone.txt"].error.startswith("an entry of the log") and done["Undelete", "dir"].action == "copy_folder" and done["Undelete", "r.doc"].target == "D:\\out\\r.doc" and done["ShadowCopy", "v.txt"].target.startswith("D:\\out\\v (from ")
    same = {(r.source, r.name): (r.action, r.error) for r in K.route(every, "C:\\out", "C:\\").collect()}
    assert same["RecycleBin", "old.txt"] == ("copy_bin", None) and "C:" in same["Carving", "png_5.png"][1] and same["Carving", "png_5.png"][0] is None
    volumes = spark.createDataFrame([("C:\\", 1), ("E:\\", 1), ("F:\\", 2)], "root string, serial long")
    assert [K.different_volume(d, "C:\\", volumes)[0] for d in ("E:\\x", "F:\\x", "D:\\x", "\\\\server\\x", "x")] == [False, True, True, False, False]


def test_children_of_deleted_folders(spark):
    from sedgeway.operators import candidates as K

    records = spark.createDataFrame(
        [record(30, "d", is_dir=True, seq=4), record(31, "sub", is_dir=True, seq=2, parent=30, pseq=3), record(32, "a", parent=30, pseq=4), record(33, "b", parent=31, pseq=2), record(34, "no", parent=30, pseq=9), record(35, "loop", is_dir=True, seq=1, parent=36, pseq=1), record(36, "pool", is_dir=True, seq=1, parent=35, pseq=1), record(37, "used", parent=30, pseq=4, in_use=True)],
        S.MFT_RECORDS,
    )
    tree = K.below_deleted(records, records.filter("record_no in (30, 35)").select("volume_id", "record_no", "sequence"))
    assert {(r.top, r.record_no, r.level, r.path) for r in tree.collect()} == {(30, 31, 1, "sub"), (30, 32, 1, "a"), (30, 33, 2, "sub\\b"), (35, 36, 1, "pool")}
    copied = spark.createDataFrame([("C", 32, 10, "Good", None), ("C", 33, 5, "Partial", None), ("C", 31, 0, "Excellent", "broken")], "volume_id string, record_no long, bytes long, final_grade string, error string")
    r = K.folder_results(tree, copied).first()
    assert (r.bytes, r.final_grade, r.error) == (15, "Partial", "1 of 3 items failed")
    pairs = spark.createDataFrame([("Excellent", "Partial"), ("Partial", "Good"), ("Good", "Good")], "a string, b string").select(K.final_grade(F.col("a"), F.col("b")).alias("g"))
    assert [x.g for x in pairs.collect()] == ["Partial", "Partial", "Good"]


def test_drives_are_reconciled(spark):
    from sedgeway.operators import candidates as K

    known = spark.createDataFrame([("C", 1, True), ("D", 2, True), ("E", 3, False), ("F", 4, False), ("G", 5, True)], "drive_letter string, serial long, online boolean")
    present = spark.createDataFrame([("C", 1), ("E", 3), ("F", 9), ("G", 6), ("H", 7)], "drive_letter string, serial long")
    assert {(r.drive_letter, r.change) for r in K.reconcile_drives(known, present).collect()} == {("D", "gone"), ("E", "back"), ("F", "added"), ("G", "gone"), ("H", "added")}


def test_texts_of_the_recovery_lists(spark):
    df = spark.createDataFrame([(b"{\\rtf1\\b Hello {World}\r\n\r\nnext\x00\xe9 line", 13_314_398_618, 440_234_147_840, 12.0)], "head binary, done long, total long, s double")
    r = df.select(N.snippet(F.col("head")).alias("t"), N.progress_text(F.col("done"), F.col("total"), F.col("s")).alias("p"), N.progress_text(F.lit(10), F.lit(20), F.lit(0.5)).alias("q"), N.progress_text(F.lit(10), F.lit(20), F.lit(5)).alias("z"), N.grade_chip(F.lit("Partial"), F.lit(40), F.lit(None).cast("string")).alias("g"), N.log_chip(F.lit("Deleted"), F.lit("Free")).alias("l")).first()
    assert r.t == "Hello World next line" and r.p == "12.4 GB of 410 GB · ETA 7 min" and r.q == "10 B of 20 B" and r.z == "10 B of 20 B · almost done"
    assert r.g.text == "Partially overwritten (40%)" and "40%" in r.g.tooltip and r.l == "Recoverable (slot intact)"


def test_shadow_copy_listing(spark):
    text = "Contents of shadow copy set ID: {aa}\r\n   Contained 1 shadow copies at creation time: 1/2/2026 3:04:05 AM\r\n      Shadow Copy ID: {0a-1}\r\n         Shadow Copy Volume: \\\\?\\GLOBALROOT\\Copy1\r\nContents of shadow copy set ID: {bb}\r\n   Contained 1 shadow copies at creation time: 2/2/2026\r\n      Shadow Copy ID: {0b-2}\r\n         Shadow Copy Volume: \\\\?\\GLOBALROOT\\Copy2\r\n"
    got = [(r.snapshot_id, r.device[-5:], r.created_text) for r in raw.parse_snapshots(spark.createDataFrame([(text,)], "value string")).collect()]
    assert got == [("{0b-2}", "Copy2", "2/2/2026"), ("{0a-1}", "Copy1", "1/2/2026 3:04:05 AM")]  # the newest first


def test_volume_image(spark, tmp_path):
    sector = bytearray(512)
    sector[3:11], sector[11:13], sector[13] = b"NTFS    ", (512).to_bytes(2, "little"), 8
    sector[40:48], sector[48:56], sector[56:64], sector[64:65] = (800).to_bytes(8, "little"), (4).to_bytes(8, "little"), (2).to_bytes(8, "little"), (-10).to_bytes(1, "little", signed=True)
    shape = raw.boot_geometry(bytes(sector))
    assert shape == {"cluster": 4096, "record": 1024, "clusters": 100, "table_lcn": 4, "mirror_lcn": 2}
    for bad in (b"", bytes(512), bytes(sector[:13]) + b"\0" + bytes(sector[14:])):
        try:
            raw.boot_geometry(bad)
        except ValueError:
            continue
        raise AssertionError("taken for a boot sector")
    image = bytearray(20 * 4096 + 100)
    image[:512] = sector
    for i, lcn in enumerate((4, 5, 9)):  # a table in two extents
        for k in range(4):
            image[lcn * 4096 + k * 1024 : lcn * 4096 + k * 1024 + 8] = b"REC" + (i * 4 + k).to_bytes(5, "little")
    (tmp_path / "image").write_bytes(image)
    clusters = raw.read_image(spark, str(tmp_path / "image"), chunk=8192, partitions=3)
    assert clusters.count() == 21 and clusters.filter("lcn = 20").first().data == bytes(4096)
    table = raw.read_file_table(clusters, [(0, 4, 2), (2, 9, 1)])
    assert {r.record_no: bytes(r.record[:8]) for r in table.collect()} == {i: b"REC" + i.to_bytes(5, "little") for i in range(12)}
    wide = raw.read_file_table(clusters, [(0, 4, 2)], record=8192)
    assert [(r.record_no, len(r.record), bytes(r.record[:4])) for r in wide.collect()] == [(0, 8192, b"REC\0")]


def test_manifest_grows_with_one_header(spark, tmp_path):
    rows = spark.createDataFrame([("C:\\a,b", "D:\\a", 5, "00", "Good", "Undelete", None)], "original_path string, recovered_path string, bytes long, sha256 string, final_grade string, source string, error string")
    export.append_manifest(rows, f"{tmp_path}/m")
    export.append_manifest(rows, f"{tmp_path}/m")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/m").collect())
    assert len(lines) == 3 and lines.count(export.header_line(export.MANIFEST_COLUMNS)) == 1 and lines[0].startswith('"C:')


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from sedgeway import __main__ as cli

    for name in ("report_1.pdf", "sub/report_2.txt", "sub/deep/notes.md"):
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * 10)
    assert cli.main(["scan", str(tmp_path / "tree"), str(tmp_path / "snap")]) == 0 and "5 entries" in capsys.readouterr().out
    cli.main(["search", str(tmp_path / "snap"), "report", "--top", "1"])
    out = capsys.readouterr().out
    assert "report_1.pdf" in out and "2 matches" in out
    cli.main(["stats", str(tmp_path / "snap")])
    assert "3 files, 2 folders, 30 bytes" in capsys.readouterr().out


def test_files_in_parts_equal_whole_files(spark):
    import random

    rng = random.Random(2)
    clusters = spark.createDataFrame([("C", i, rng.randbytes(512)) for i in range(200)], "volume_id string, lcn long, data binary")
    files = [record(20, runs=((0, 10, 40), (40, -1, 20), (60, 100, 30)), real=90 * 512 - 7), record(21, runs=((0, 5, 3),), real=1200, initialized=700), record(22, runs=((0, -1, 50),), real=20_000), record(23, runs=((0, 150, 70),), real=1000), record(24, runs=((0, 60, 40),), real=40 * 512, initialized=20 * 512)]
    df = spark.createDataFrame(files, S.MFT_RECORDS)
    whole = {r.record_no: (r.content, r.error) for r in carve.recover(df, clusters, 512, total_clusters=200).collect()}
    assert whole[23] == (None, "the runs can't be followed") and whole[20][1] is None
    parts = {}
    for r in carve.recover_parts(df, clusters, 512, total_clusters=200, part_clusters=16).orderBy("record_no", "part").collect():
        parts[r.record_no] = parts.get(r.record_no, b"") + bytes(r.content)
    assert parts == {k: bytes(c) for k, (c, e) in whole.items() if e is None} and set(parts) == {20, 21, 22, 24}


def test_lookups_and_dated_snapshots(spark, tmp_path):
    from sedgeway.operators.search import by_path, child_of

    records = spark.createDataFrame([("C", 40, 5, "Docs", S.ATTR_DIRECTORY), ("C", 41, 40, "A.txt", S.ATTR_HIDDEN), ("C", 42, 40, "a.TXT", 0)], "volume_id string, record_no long, parent_record_no long, name string, attributes long")
    entries = E.from_enumeration(records)
    assert {(r.name, r.is_dir, r.hidden, r.metadata_known) for r in entries.collect()} == {("Docs", True, False, False), ("A.txt", False, True, False), ("a.TXT", False, False, False)}
    full = E.derive(entries.withColumn("full_path", F.concat(F.lit("C:\\"), "name")))
    assert by_path(full, "c:\\DOCS\\").first().entry_id == 40 and child_of(full, 40, "a.txt").first().entry_id == 41 and child_of(full, 40, "b").count() == 0
    times = [T0, T0 + timedelta(days=1)]
    E.freeze(entries, str(tmp_path), times[0])
    E.freeze(entries.filter("entry_id < 42"), str(tmp_path), times[1])
    got = E.frozen(spark, str(tmp_path), [*times, T0 + timedelta(days=9)])
    assert sorted((r.created, r["count"]) for r in got.groupBy("created").count().collect()) == [(times[0], 3), (times[1], 2)]
    assert "png" in carve.types_of("Image") and "mp3" not in carve.types_of("Image")
