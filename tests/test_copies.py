import hashlib

from pyspark.sql import functions as F

from sedgeway import schemas as S
from sedgeway.operators.carve import first_clusters
from sedgeway.operators.copies import carved_files, copies, copy_name
from sedgeway.operators.recovery import grade

SCHEMA = "volume_id string, record_no long, name string, is_dir boolean, real_size long, initialized_size long, data_flags int, compression_unit int, resident boolean, resident_data binary, runs " + S.RUNS.simpleString() + ", grade string"
CHUNK = bytes([0x05, 0xB0, 0x08]) + b"ABC" + bytes([0x03, 0x20])  # ABCABCABC as a compressed chunk


def sha(data):
    return hashlib.sha256(data).hexdigest()


def file(i, size, runs, init=0, flags=0, unit=0, resident=None, is_dir=False, grade="Excellent"):
    return ("v", i, f"f{i}", is_dir, size, init, flags, unit, resident is not None, resident, runs, grade)


def test_copies_of_every_kind(spark):
    image = {100: b"\x07" * 512, 101: b"\x09" * 512, 200: CHUNK.ljust(512, b"\0"), 120: b"\x03" * 512, 300: b"a" * 512, 301: b"b" * 512, 50: b"end"}
    image |= {240 + i: bytes([i]) * 512 for i in range(16)}
    files = [
        file(1, 1200, [(0, 100, 2), (2, -1, 1)]),  # cut within a sparse run
        file(2, 9, [(0, 200, 1), (1, -1, 15)], flags=1, unit=4), file(3, 8192, [(0, 240, 16)], flags=1, unit=4), file(4, 100, [(0, 200, 1), (1, -1, 1), (2, 201, 1), (3, -1, 13)], flags=1, unit=0), file(5, 10, [(0, 120, 1)], flags=1, unit=31),
        file(6, 1 << 50, [(0, 120, 1)], init=1 << 50), file(7, 600, [(0, 300, 2)], init=520), file(8, 1024, [(0, 300, 1), (1, 999, 1)]), file(9, 512, [(0, 998, 1)], grade="Good"), file(10, 5, [], resident=b"hello!!"), file(11, 0, []),
        file(12, 512, [(0, 300, 1)], flags=0x4000, grade="Encrypted"), file(13, 0, [], is_dir=True), file(14, 100, [(0, 100000, 1)], grade="Unknown"), file(15, 5, None), file(16, 600, [(0, 49, 2)]), file(17, None, [(0, 49, 2)]), file(18, 8192 + 5, [(0, 240, 16), (16, 200, 1), (17, -1, 15)], flags=1, unit=0),
    ]
    clusters = spark.createDataFrame([("v", k, d) for k, d in image.items()], "volume_id string, lcn long, data binary").repartition(3)
    alloc = spark.createDataFrame([("v", 301, 1), ("v", 100, 3)], "volume_id string, start_lcn long, len long")
    df = spark.createDataFrame([(*f, "own") for f in files], SCHEMA + ", sha256 string")
    got = {r.record_no: r for r in copies(df, clusters, alloc, 512, 1000).collect()}
    told = {k: (r.bytes, r.sha256, r.final_grade, r.lost_clusters) for k, r in got.items() if not r.error}
    assert told == {
        1: (1200, sha(image[100] + image[101] + bytes(176)), "Overwritten", 0), 2: (9, sha(b"ABCABCABC"), "Excellent", 0), 3: (8192, sha(b"".join(image[240 + i] for i in range(16))), "Excellent", 0), 6: (512, sha(image[120]), "Excellent", 0),
        7: (600, sha(b"a" * 512 + b"b" * 8 + bytes(80)), "Partial", 0), 8: (1024, sha(b"a" * 512 + bytes(512)), "Partial", 1), 9: (512, sha(bytes(512)), "Zeroed", 1), 10: (5, sha(b"hello"), "Excellent", 0), 11: (0, sha(b""), "Excellent", 0),
        15: (0, sha(b""), "Excellent", 0), 16: (600, sha(bytes(512) + b"end" + bytes(85)), "Partial", 1), 18: (8197, sha(b"".join(image[240 + i] for i in range(16)) + b"ABCAB"), "Excellent", 0),
    }
    assert {k for k, r in got.items() if r.error} == {4, 5, 12, 13, 14, 17} and all(got[k].sha256 is None and got[k].bytes is None for k in (4, 5, 12, 13, 14, 17))
    assert [tuple(x) for x in got[1].byte_runs] == [(0, 1024, 51200)] and [tuple(x) for x in got[18].byte_runs] == [(0, 8192, 240 * 512), (8192, 5, 200 * 512)] and got[10].byte_runs == []
    assert got[12].final_grade == "Encrypted" and got[14].final_grade == "Unknown"
    assert copies(df.limit(0), clusters, alloc, 512).count() == 0


def test_a_file_of_many_batches_is_hashed_as_it_passes(spark):
    n = 30_000
    clusters = spark.range(n).select(F.lit("v").alias("volume_id"), (F.col("id") * 7919 % n).alias("lcn"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("data"))
    carved = spark.createDataFrame([("v", 3, 64 * (n - 3) - 7), ("v", 5, 10), ("v", 6, 64 * n), ("v", 7, 0)], "volume_id string, start_lcn long, size long")
    got = {r.record_no: r for r in copies(carved_files(carved, 64), clusters, None, 64, n).collect()}
    place = {i * 7919 % n: i for i in range(n)}
    body = b"".join(sha(str(place[k]).encode()).encode() for k in range(3, n))
    assert got[3].sha256 == sha(body[:-7]) and got[5].sha256 == sha(body[128:138])
    assert got[6].error and got[7].error  # a range outside the volume, and an empty one


def test_names_of_programs_and_evidence_of_first_clusters(spark):
    names = [r[0] for r in spark.createDataFrame([("a.EXE",), ("b.txt",), ("c",), ("x.js",)], "n string").select(copy_name(F.col("n"))).collect()]
    assert names == ["a.EXE.recovered", "b.txt", "c", "x.js.recovered"]
    clusters = spark.createDataFrame([("v", 10, b"%PDF-1.4".ljust(64, b"x")), ("v", 11, bytes(64)), ("v", 12, bytes(20) + b"x" * 44)], "volume_id string, lcn long, data binary")
    rows = [("v", 20 + i, n, False, 10, 0, 0, 0, False, None, [(0, -1, 1), (1, at, 2)], None) for i, (n, at) in enumerate([("a.pdf", 10), ("b.jpg", 10), ("c", 10), ("d.pdf", 11), ("e.pdf", 12), ("f.pdf", 99)])]
    df = spark.createDataFrame(rows, SCHEMA).drop("grade")
    seen = {r.record_no: (r.zero, r.header_ok) for r in first_clusters(df, clusters).collect()}
    assert seen == {20: (False, True), 21: (False, False), 22: (False, None), 23: (True, False), 24: (True, False)}
    none = spark.createDataFrame([], "volume_id string, start_lcn long, len long")
    graded = {r.record_no: r.grade for r in grade(df.withColumn("initialized_size", F.lit(128).cast("long")).withColumn("real_size", F.lit(128).cast("long")), none, cluster_size=64, evidence=first_clusters(df, clusters)).collect()}
    assert graded == {20: "Excellent", 21: "Good", 22: "Excellent", 23: "Zeroed", 24: "Zeroed", 25: "Excellent"}


def test_files_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([file(i, 512, [(0, i, 1)]) for i in range(1, 41)], SCHEMA).mapInArrow(count, SCHEMA)
    image = spark.createDataFrame([("v", i, bytearray([i]) * 512) for i in range(50)], "volume_id string, lcn long, data binary")
    alloc = spark.createDataFrame([("v", 1, 2)], "volume_id string, start_lcn long, len long")
    assert copies(files, image, alloc, 512, 1000).filter("final_grade = 'Overwritten'").count() == 2
    assert seen.value == 40
