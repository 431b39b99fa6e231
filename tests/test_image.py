import struct

import pytest

from sedgeway.sources import image as I

CLUSTER, RECORD = 4096, 1024


def attribute(kind, body, outside=False):
    if outside:
        runs, allocated, real, initialized = body
        raw = struct.pack("<IIBBHHHqqHHIqqq", kind, 64 + (len(runs) + 8) // 8 * 8, 1, 0, 64, 0, 0, 0, 0, 64, 0, 0, allocated, real, initialized) + runs
        return raw.ljust(64 + (len(runs) + 8) // 8 * 8, b"\0")
    return (struct.pack("<IIBBHHHIHH", kind, (24 + len(body) + 7) // 8 * 8, 0, 0, 24, 0, 0, len(body), 24, 0) + body).ljust((24 + len(body) + 7) // 8 * 8, b"\0")


def named(name, parent=5, size=0):
    text = name.encode("utf-16-le")
    return attribute(0x30, struct.pack("<QqqqqqqIIBB", 1 << 48 | parent, 0, 0, 0, 0, 0, size, 0, 0, len(name), 1) + text)


def record(*attrs, in_use=True, torn=False):
    body = b"".join(attrs) + b"\xff\xff\xff\xff"
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, 1, 1, 56, int(in_use), 56 + len(body), RECORD, 0, 0, 0, 0)
    raw = bytearray((head + struct.pack("<HHH", 9, 0, 0) + b"\0\0" + body).ljust(RECORD, b"\0"))
    for i in (1, 2):
        raw[46 + 2 * i + 2 : 48 + 2 * i + 2] = raw[512 * i - 2 : 512 * i]
        raw[512 * i - 2 : 512 * i] = struct.pack("<H", 8 if torn else 9)
    return bytes(raw)


def runs_of(*runs):
    out, at = b"", 0
    for lcn, n in runs:
        out += bytes([0x01, n]) if lcn is None else bytes([0x21, n]) + struct.pack("<h", lcn - at)
        at = at if lcn is None else lcn
    return out + b"\0"


def volume(path, extents=((4, 2), (9, 1), (None, 2), (30, 1)), zero=None, bitmap=None):
    """An image of 40 clusters whose table has 24 records in three extents and a hole."""
    sector = bytearray(512)
    sector[3:11], sector[11:13], sector[13] = b"NTFS    ", (512).to_bytes(2, "little"), 8
    sector[40:48], sector[48:56], sector[56:64], sector[64:65] = (320).to_bytes(8, "little"), (4).to_bytes(8, "little"), (2).to_bytes(8, "little"), (-10).to_bytes(1, "little", signed=True)
    data = bytearray(40 * CLUSTER)
    data[:512] = sector
    data[12 * CLUSTER : 12 * CLUSTER + 8] = b"cluster!"
    used = sum(1 << i for i in (0, 1, 5, 7, 10, 11, 20, 23))
    body = attribute(0xB0, used.to_bytes(3, "little")) if bitmap is None else bitmap
    records = {i: record(named(f"f{i}"), in_use=bool(used >> i & 1), torn=i == 6) for i in range(24)}
    records[0] = record(named("$MFT"), attribute(0x80, (runs_of(*extents), 6 * CLUSTER, 6 * CLUSTER, 6 * CLUSTER), True), body) if zero is None else zero
    vcn = 0
    for lcn, n in ((4, 2), (9, 1), (None, 2), (30, 1)):
        for k in range(n * 4):
            if lcn is not None:
                data[lcn * CLUSTER + k * RECORD : lcn * CLUSTER + (k + 1) * RECORD] = records[vcn * 4 + k]
        vcn += n
    path.write_bytes(data)
    return str(path)


def test_the_table_is_read_from_the_image_alone(spark, tmp_path):
    path = volume(tmp_path / "image")
    I.register(spark)
    raw = spark.read.format("volume_records").options(path=path, volume_id="D", partition_bytes="5000").load()
    assert {r.record_no for r in raw.collect()} == {*range(12), *range(20, 24)}  # nothing of the hole
    found = {r.record_no: (r.volume_id, r.name, r.in_use) for r in I.image_records(spark, path, "D").collect()}
    assert found == {i: ("D", "$MFT" if i == 0 else f"f{i}", i in (0, 1, 5, 7, 10, 11, 20, 23)) for i in [*range(6), *range(7, 12), *range(20, 24)]}  # but for the torn one
    assert {r.record_no for r in I.image_records(spark, path, in_use=True, partition_bytes="4096").collect()} == {0, 1, 5, 7, 10, 11, 20, 23}
    assert sorted(r.record_no for r in I.image_records(spark, path, ranges="7-9, 14, 19-20").collect()) == [7, 8, 9, 20]
    assert I.image_records(spark, path, ranges="100-200").count() == 0
    assert raw.filter("record_no >= 21").count() == 3 and raw.count() == 16


def test_clusters_are_read_in_ranges(spark, tmp_path):
    path = volume(tmp_path / "image")
    I.register(spark)
    clusters = spark.read.format("volume_clusters").options(path=path, partition_bytes=str(5 * CLUSTER)).load()
    assert clusters.count() == 40 and clusters.filter("lcn = 12").first().data.startswith(b"cluster!")
    assert sorted(r.lcn for r in clusters.filter("lcn > 36 or lcn = 2").collect()) == [2, 37, 38, 39]
    assert sorted(r.lcn for r in I.image_clusters(spark, path, ranges="38-90,2,1-2").collect()) == [1, 2, 38, 39]
    with I.Opened(path) as image:
        assert image.size == 40 * CLUSTER and image.at(39 * CLUSTER + 4000, 200) == bytes(200)
    file = f"file://{path}"
    assert spark.read.format("volume_clusters").options(path=file, cluster="8192").load().count() == 20
    assert [(p.low, p.high) for p in I.parts_of([(10, 12), (0, 10), (3, 4)], 5)] == [(0, 5), (5, 10), (10, 12)]
    with pytest.raises(ValueError):
        I.asked_ranges("1-x")


def test_records_in_use_are_visited_downward(tmp_path):
    used = {3, 7, 8, 20}
    fetch = lambda n: max((x for x in used if x <= n), default=-1)
    assert list(I.downward(0, 30, fetch)) == [20, 8, 7, 3] and list(I.downward(8, 20, fetch)) == [8] and list(I.downward(9, 20, fetch)) == [] and list(I.downward(4, 4, fetch)) == []
    wide = attribute(0xB0, (runs_of((20, 1)), CLUSTER, 8, 8), True)  # a bitmap that lies in a cluster
    path = volume(tmp_path / "image", bitmap=wide)
    with open(path, "r+b") as f:
        f.seek(20 * CLUSTER)
        f.write(bytes([0b10000001, 0, 0b10000000]))
    reader = I.RecordReader({"path": path, "in_use": "true"})
    assert [n for p in reader.partitions() for b in reader.read(p) for n in b.column(1).to_pylist()] == [7, 0, 23]


@pytest.mark.parametrize(
    "zero, why",
    [
        (record(named("$MFT"), torn=True), "record 0"), (record(named("$MFT"), in_use=False), "record 0"), (record(named("$MFT")), "no runs"), (record(attribute(0x20, bytes(8)), named("$MFT")), "spread"),
        (record(named("$MFT"), attribute(0x80, (runs_of((4, 2)), 0, 90 * CLUSTER, 90 * CLUSTER), True)), "whole table"),
    ],
)
def test_layouts_that_cannot_be_followed_are_refused(tmp_path, zero, why):
    path = volume(tmp_path / "image", zero=zero)
    with I.Opened(path) as image, pytest.raises(ValueError, match=why):
        I.find_table(image)
