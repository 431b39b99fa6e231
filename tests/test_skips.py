import random

from pyspark.sql import functions as F

from sedgeway.operators.carve import scan
from sedgeway.operators.skips import _targets, _walked, uncovered


def kept(rows):
    out, free = [], {}
    for k, v, s, e, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if s >= free.get((k, v), s):
            out.append((k, v, s, e, x))
            free[k, v] = e
    return sorted(out)


def test_spans_kept_equal_a_scan_in_order(spark):
    rng = random.Random(11)
    rows = []
    for k in range(4):
        for start in sorted(rng.sample(range(-50, 3000), 600 if k else 1500)):
            rows.append((f"v{k}", k, start, start + (rng.choice([1, 2, 3, 900]) if k == 2 else rng.randint(1, 9)), f"x{start}"))
    rows += [("far", 9, 5, 10**9, "first"), ("far", 9, 10**9 - 1, 10**9 + 1, "in it"), ("far", 9, 10**9, 10**9 + 3, "after it"), ("far", 9, 10**12, 10**12 + 1, "last")]
    df = spark.createDataFrame(rows, "volume string, run long, start long, end long, mine string")
    for block in (16, 1 << 16):
        assert sorted(map(tuple, uncovered(df, ["volume", "run"], block=block).collect())) == kept(rows)
    assert uncovered(df.limit(0), ["volume", "run"]).count() == 0


def test_blocks_are_composed_over_the_spans_that_enter_them(spark):
    spans = spark.range(4000).select(F.lit("k").alias("_k0"), F.floor(F.col("id") / 100).alias("_b"), F.col("id").alias("_s"), (F.col("id") + 1 + F.col("id") % 3).alias("_e"))
    each = _walked(spans, ["_k0"]).cache()
    jump = _targets(each, each.groupBy("_k0").agg(F.min("_s").alias("_s")), ["_k0"], 100)
    assert 39 <= jump.count() <= 3 * 40  # of 4,000


def test_places_in_each_other_and_missing_clusters(spark):
    head = lambda n: b"BM" + (64 * n - 3).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (8).to_bytes(4, "little") * 2 + b"\1\0\x20\0" + bytes(24) + bytes([1]) * 10
    stored = {i: i * 5 % 7 + 1 for i in range(2600) if i % 37 and i % 89}
    clusters = spark.createDataFrame([("V", i, bytearray(head(n))) for i, n in stored.items()], "volume_id string, lcn long, data binary").repartition(3)
    want = []
    for a, b in ((0, 1500), (1500, 2599)):
        at = a
        while at < b:
            n = stored.get(at)
            good = n is not None and at + n <= b and all(at + j in stored for j in range(n))
            if good:
                want.append((at, 64 * n - 3))
            at += n if good else 1
    runs = spark.createDataFrame([("V", 0, 1500), ("V", 1500, 1099)], "volume_id string, start_lcn long, len long")
    assert sorted((r.start_lcn, r.size) for r in scan(clusters, runs, 64, block=128).collect()) == want
