import random

from sedgeway.operators.tree import intervals, totals_below, without_subtrees

COLS = "entry_id long, is_dir boolean, size long, fold_path string, mine string"


def tree():
    rng = random.Random(8)
    folders, rows = ["c:", "d:"], []
    for i in range(1, 400):
        name = rng.choice(["a", "a b", "a!", "a.txt", "b", "ab", "é", "~", "a\\b"[0]]) + rng.choice(["", str(i % 7), str(i)])
        path = f"{rng.choice(folders)}\\{name}"
        if path in {r[3] for r in rows}:
            continue
        is_dir = rng.random() < 0.4
        rows.append((i, is_dir, None if rng.random() < 0.1 else rng.randrange(1000), path, "own"))
        if is_dir:
            folders.append(path)
    return rows


def test_totals_intervals_and_removals_equal_brute_force(spark):
    rows = tree()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    below = {i: [r for r in rows if r[3].startswith(p + "\\")] for i, _, _, p, _ in rows}
    got = {r.entry_id: (r.files, r.folders, r.bytes) for r in totals_below(df).collect()}
    assert got == {i: (sum(not r[1] for r in below[i]), sum(r[1] for r in below[i]), sum(r[2] or 0 for r in below[i] if not r[1])) for i, d, _, _, _ in rows if d}
    at = {r.entry_id: (r.enter, r.leave) for r in intervals(df).collect()}
    for i, d, _, _, _ in rows:
        assert {k for k, (enter, _) in at.items() if at[i][0] <= enter <= at[i][1]} == {i} | {r[0] for r in below[i]}
    gone = [r[0] for r in rows if r[0] % 11 == 0]
    left = without_subtrees(df, spark.createDataFrame([(g,) for g in [*gone, gone[0], 9999]], "entry_id long"))
    out = {r[0] for g in gone for r in below.get(g, [])} | set(gone)
    assert sorted(r.entry_id for r in left.collect()) == sorted(r[0] for r in rows if r[0] not in out) and left.columns == df.columns
    assert totals_below(df.limit(0)).count() == 0 and without_subtrees(df, spark.createDataFrame([], "entry_id long")).count() == len(rows)
