from pyspark.sql import functions as F

from sedgeway.operators import candidates as K
from sedgeway.operators.carve import batches, publish
from sedgeway.operators.recovery import scan_bin

BIN = "C:\\$Recycle.Bin\\S-1-5-1\\"


def test_bins_are_scanned_by_user(spark):
    rows = [
        (BIN + "$Iabc.txt", False, 544), (BIN.lower() + "$rABC.TXT", False, 7), (BIN + "$Rlone", True, 0), (BIN + "$Ilost.doc", False, 1), (BIN + "$Ino", False, 1), (BIN + "$Rno", False, 9), (BIN + "desktop.ini", False, 1),
        (BIN + "$R", False, 1), (BIN + "$Rfolder\\inner", False, 1), ("C:\\$Recycle.Bin\\x-1\\$Rq", False, 1), ("C:\\other\\S-1-5-1\\$Rq", False, 1), ("D:\\$RECYCLE.BIN\\s-1-5-2\\$Rabc.txt", False, 3), (None, False, 1), (BIN + "$Idir", True, 0),
    ]
    entries = spark.createDataFrame(rows, "full_path string, is_dir boolean, size long")
    metas = spark.createDataFrame([(BIN.upper() + "$IABC.TXT", "E:\\docs\\was.txt", 70, None), (BIN + "$Ilost.doc", "E:\\gone\\", 5, None)], "full_path string, original_path string, size long, deleted_at timestamp_ntz")
    got = {(r.drive, r.sid, r.id): (r.name, r.folder, r.size, r.is_dir, r.grade, r.detail) for r in scan_bin(entries, metas).collect()}
    assert got == {
        ("C:", "S-1-5-1", "abc.txt"): ("was.txt", "E:\\docs", 70, False, "Excellent", None), ("C:", "S-1-5-1", "lone"): ("$Rlone", None, 0, True, "Unknown", "its name and folder are unknown"),
        ("C:", "S-1-5-1", "lost.doc"): ("gone", "E:", 5, False, "Unknown", "its data is gone"), ("C:", "S-1-5-1", "no"): ("$Rno", None, 9, False, "Unknown", "its name and folder are unknown"),
        ("D:", "S-1-5-2", "abc.txt"): ("$Rabc.txt", None, 3, False, "Unknown", "its name and folder are unknown"),
    }
    assert {r.sid for r in scan_bin(entries, metas, "s-1-5-2").collect()} == {"S-1-5-2"} and scan_bin(entries.limit(0), metas).count() == 0


def test_finds_are_published_in_order(spark, tmp_path):
    found = spark.range(1050).select(F.lit("v").alias("volume_id"), (F.col("id") * 37 % 1050 * 100).alias("start_lcn"), F.lit("png").alias("type_id")).unionByName(spark.createDataFrame([("w", 5, "gif")], "volume_id string, start_lcn long, type_id string"))
    got = {(r.volume_id, r.batch): [x.start_lcn for x in r.finds] for r in batches(found, block=7000).collect()}
    assert got == {("v", k): list(range(20_000 * k, min(20_000 * k + 20_000, 105_000), 100)) for k in range(6)} | {("w", 0): [5]}
    found.write.parquet(f"{tmp_path}/found")
    sent = []
    stream = spark.readStream.schema(found.schema).parquet(f"{tmp_path}/found")
    publish(stream, lambda df, i: sent.extend((i, r.volume_id, len(r.finds)) for r in df.collect()), f"{tmp_path}/checkpoint", most=500).awaitTermination()
    assert sorted(n for _, v, n in sent if v == "v") == [50, 500, 500]


def test_reports_of_any_number_of_files(spark, tmp_path):
    import xml.etree.ElementTree as ET
    from datetime import datetime

    import pytest
    from pyspark.errors import AnalysisException

    from sedgeway.operators import export

    when = datetime(2024, 1, 2, 3, 4, 5)
    rows = [(f"C:\\a & <{i}>", f"D:\\{i}", i, "ab" * 32 if i % 2 else None, "Good", "Undelete", "cut\nshort" if i == 3 else None, when if i else None, [(0, 10, 4096), (10, 5, -1)] if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "original_path string, recovered_path string, bytes long, sha256 string, final_grade string, source string, error string, modified timestamp_ntz, runs array<struct<file_offset: bigint, len: bigint, img_offset: bigint>>").repartition(3)
    export.write_dfxml(df, f"{tmp_path}/report", "C:", when, when)
    names = sorted(p for p in (tmp_path / "report").iterdir() if p.suffix in (".txt", ".xml"))
    whole = ET.fromstring("".join(p.read_text() for p in names))
    one = ET.fromstring(export.dfxml(df, "C:", when, when))
    parts = lambda top: sorted(ET.tostring(o, encoding="unicode").split() for o in top if o.tag.endswith("fileobject"))
    assert len(names) == 5 and len(parts(whole)) == 40 and "".join(sum(parts(whole), [])) == "".join(sum(parts(one), []))
    with pytest.raises(AnalysisException):
        export.write_dfxml(df, f"{tmp_path}/report", "C:", when, when)
    export.write_dfxml(df.limit(0), f"{tmp_path}/none", "C:", when, when)
    assert len(ET.fromstring("".join(p.read_text() for p in sorted((tmp_path / "none").iterdir()) if p.suffix in (".txt", ".xml")))) == 3


def test_children_of_deleted_folders_deeper_than_one_level(spark):
    rows = [("C", 10 + i, 2, i < 4, 9 + i if i else 5, 1 if i else 1, f"n{i}") for i in range(5)]
    records = spark.createDataFrame([(v, n, s, False, d, 0, up, useq, name) for v, n, s, d, up, useq, name in rows], "volume_id string, record_no long, sequence int, in_use boolean, is_dir boolean, base_record long, parent_record long, parent_sequence int, name string")
    top = records.filter("record_no = 10").select("volume_id", "record_no", "sequence")
    got = sorted((r.record_no, r.level) for r in K.below_deleted(records, top).collect())
    assert [n for n, _ in got] == [11, 12, 13, 14] and [b - a for (_, a), (_, b) in zip(got, got[1:])] == [1, 1, 1]
