import random

from sedgeway import catalogue
from sedgeway.operators import bitmap as B
from sedgeway.operators.recovery import free_runs_from_alloc


def gaps(used, total):
    out, start = [], None
    for i in range(total + 1):
        free = i < total and i not in used
        if free and start is None:
            start = i
        elif not free and start is not None:
            out.append((start, i - start))
            start = None
    return out


def test_ranks_and_free_runs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    totals = {"a": 3 * 4096 + 100, "b": 2 * 4096, "c": 5 * 4096 + 1, "d": 70}
    used = {v: {i for i in range(n) if rng.random() < 0.4} for v, n in totals.items()}
    used["b"] = set()
    used["c"] -= set(range(4000, 4 * 4096 + 3))
    df = spark.createDataFrame(list(totals.items()), "volume_id string, total long")
    pieces = []
    for v, n in totals.items():
        data = bytearray(-(-n // 8))
        for i in used[v]:
            data[i // 8] |= 1 << i % 8
        cuts = [0, *sorted(rng.sample(range(1, len(data)), min(5, len(data) - 1))), len(data)]
        pieces += [(v, a, bytes(data[a:b])) for a, b in zip(cuts, cuts[1:])]
    pieces.append(("a", 0, b""))
    blocks = B.from_pieces(spark.createDataFrame(pieces, "volume_id string, first_byte long, bytes binary").repartition(3), df).cache()
    assert blocks.count() == sum(n // 4096 + 1 for n in totals.values())
    asked = [(i, v, rng.randrange(totals[v] + 50), rng.choice([1, 7, 64, 300, 9000])) for i in range(120) for v in [rng.choice("abcd")]]
    asked += [(500, "a", 5, 0), (501, "a", -1, 9), (502, "b", 0, 8192), (503, "c", 4096, 8192), (0, "a", 4090, 12)]
    got = {r.id: r.allocated for r in B.allocated_in(spark.createDataFrame(asked, "id long, volume_id string, lcn long, clusters long"), blocks).collect()}
    want = {}
    for i, v, lcn, n in asked:
        if lcn >= 0:
            want[i] = want.get(i, 0) + sum(x >= totals[v] or x in used[v] for x in range(lcn, lcn + n))
    assert got == {i: n for i, n in want.items() if n}
    free = sorted((v, s, n) for v in totals for s, n in gaps(used[v], totals[v]))
    assert sorted(tuple(r) for r in B.free_runs_of(blocks).collect()) == free
    monkeypatch.setattr(B, "LOT", 2)  # borders of lots within the volumes
    assert sorted(tuple(r) for r in B.free_runs_of(blocks).collect()) == free
    runs = [(v, s, 1) for v in "ad" for s in used[v]] + [("a", 4000, 300), ("d", 60, 500)]
    again = B.from_runs(spark.createDataFrame(runs, "volume_id string, start_lcn long, len long"), df)
    used["a"] |= set(range(4000, 4300))
    used["d"] |= set(range(60, 70))
    ranks = {(r.volume_id, r.block): (r.before, r.taken) for r in again.filter("volume_id in ('a', 'd')").collect()}
    assert ranks == {(v, b): (sum(x < b * 4096 for x in used[v]), sum(b * 4096 <= x < b * 4096 + 4096 for x in used[v]) + max(0, (b + 1) * 4096 - totals[v])) for v in "ad" for b in range(totals[v] // 4096 + 1)}


def test_gaps_between_runs(spark):
    alloc = spark.createDataFrame([("C", 0, 5), ("C", 9000, 10), ("D", 4096, 4096)], "volume_id string, start_lcn long, len long")
    assert sorted(tuple(r) for r in free_runs_from_alloc(alloc, 10_000).collect()) == [("C", 5, 8995), ("C", 9010, 990), ("D", 0, 4096), ("D", 8192, 1808)]


def test_grades_by_ranks_of_runs_up_to_the_last_cluster(spark, tmp_path):
    keys = [k for k in range(20_000) if any((k * 37 + i * 1013) % 100_000 > 99_996 for i in range(k % 3 + 1))]
    assert keys
    spark.createDataFrame([(k, f"p{k}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in range(6000)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = (sorted(map(tuple, catalogue.QUERIES[q](spark, str(tmp_path)).collect())) for q in ("q61_grade_by_ranks", "q35_grade"))
    assert got == want


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    alloc = [(v, rng.randrange(20_000), rng.choice([1, 12, 64, 700, 5000])) for v in "ab" for _ in range(25)] + [("a", 8192, 4096), ("c", -3, 5), ("c", 90, 0)]
    used = {(v, i) for v, s, n in alloc for i in range(s, s + n)}
    runs = [(i % 150, v, rng.randrange(26_000), rng.choice([1, 4, 63, 4096, 9000])) for i in range(300) for v in [rng.choice("abd")]] + [(200, "a", 8192, 4096), (201, "a", -1, 50), (202, "c", 0, 9), (203, "c", 90, 9)]
    want = {}
    for i, v, lcn, n in runs:
        if lcn >= 0:
            want[i] = want.get(i, 0) + sum((v, x) in used for x in range(lcn, lcn + n))
    got = B.overlaps(spark.createDataFrame(runs, "id long, volume_id string, lcn long, clusters long"), spark.createDataFrame(alloc, "volume_id string, start_lcn long, len long"))
    assert {r.id: r.allocated for r in got.collect()} == {i: n for i, n in want.items() if n}
