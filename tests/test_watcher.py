import random

import pytest
from pyspark.sql import functions as F

from sedgeway.operators.watcher import Tree, _parted, add_walked, watch_batch

COLS = "volume_id string, entry_id long, parent_id long, name string, is_dir boolean, deleted boolean, metadata_known boolean, size long, full_path string, fold_path string, mine string"
EVENTS = "volume_id string, seq long, kind string, path string, old_path string, is_dir boolean"


def row(i, up, path, is_dir=False):
    return ("C", i, up, path.split("\\")[-1], is_dir, False, True, 5, path, path.lower(), "own")


TREE = [
    row(1, 0, "C:\\D", True), row(2, 1, "C:\\D\\a"), row(3, 1, "C:\\D\\b"), row(4, 0, "C:\\E", True), row(5, 4, "C:\\E\\x"), row(6, 4, "C:\\E\\sub", True), row(7, 6, "C:\\E\\sub\\deep"), row(8, 0, "C:\\Empty", True),
]


def after(spark, events, tree=TREE, **options):
    df = spark.createDataFrame([("C", i, *e) for i, e in enumerate(events)], EVENTS)
    got = watch_batch(spark.createDataFrame(tree, COLS), df, **options)
    assert not got.rescan
    rows = got.entries.collect()
    ids = {r.full_path: r.entry_id for r in rows}
    for r in rows:  # the tree hangs together
        up = r.full_path.rsplit("\\", 1)[0]
        assert r.parent_id == (ids[up] if "\\" in up else 0) and r.name == r.full_path.rsplit("\\", 1)[1] and r.fold_path == r.full_path.lower()
    assert len(ids) == len(rows)
    return {r.full_path: (r.entry_id if 0 < r.entry_id < 100 else "new", r.metadata_known) for r in rows}, sorted(r.path for r in got.walks.collect())


def test_events_in_order(spark):
    same = {r[8]: (r[1], True) for r in TREE}
    got, walks = after(spark, [
        ("created", "C:\\D\\n", None, False), ("changed", "C:\\d\\A", None, False), ("renamed", "C:\\D\\b2", "C:\\D\\b", False), ("deleted", "C:\\E", None, True), ("created", "C:\\D\\t", None, False), ("deleted", "C:\\D\\t", None, False),
    ])
    assert got == {"C:\\D": (1, True), "C:\\D\\a": (2, False), "C:\\D\\b2": (3, True), "C:\\D\\n": ("new", False), "C:\\Empty": (8, True)} and walks == []
    # A folder is renamed, and again; events name what is below it by its new path.
    got, _ = after(spark, [("renamed", "C:\\F", "C:\\E", True), ("changed", "C:\\F\\SUB\\deep", None, False), ("renamed", "C:\\D\\G", "C:\\F", True), ("renamed", "C:\\D\\G\\y", "C:\\D\\G\\x", False)])
    assert got == {k: v for k, v in same.items() if not k.startswith("C:\\E\\") and k != "C:\\E"} | {"C:\\D\\G": (4, True), "C:\\D\\G\\y": (5, True), "C:\\D\\G\\sub": (6, True), "C:\\D\\G\\sub\\deep": (7, False)}
    # Deleted and created: nothing of the old folder stays, and the new one is to be scanned.
    got, walks = after(spark, [("deleted", "C:\\E", None, True), ("created", "C:\\E", None, True)])
    assert got == {k: v for k, v in same.items() if not k.startswith("C:\\E")} | {"C:\\E": ("new", False)} | {"C:\\Empty": (8, True)} and walks == ["C:\\E"]
    # Below what isn't indexed nothing comes in; what is renamed to there goes.
    assert after(spark, [("created", "C:\\no\\x", None, False), ("created", "D:\\x\\y", None, False), ("deleted", "C:\\no\\x", None, False), ("changed", "C:\\no", None, False)]) == (same, [])
    assert after(spark, [("renamed", "C:\\no\\E", "C:\\E", True)])[0] == {k: v for k, v in same.items() if not k.startswith("C:\\E\\") and k != "C:\\E"}
    # A file that is renamed in a folder that then goes doesn't outlive it.
    assert after(spark, [("renamed", "C:\\E\\x2", "C:\\E\\x", False), ("deleted", "C:\\E", None, True)])[0] == {k: v for k, v in same.items() if not k.startswith("C:\\E\\") and k != "C:\\E"}
    # Places change hands; a move into itself drops the folder; a rename of what isn't known brings it in.
    got, walks = after(spark, [("renamed", "C:\\T", "C:\\D", True), ("renamed", "C:\\D", "C:\\E", True), ("renamed", "C:\\E", "C:\\T", True), ("renamed", "C:\\Empty\\in", "C:\\Empty", True), ("renamed", "C:\\new", "C:\\unknown", True)])
    assert got == {"C:\\E": (1, True), "C:\\E\\a": (2, True), "C:\\E\\b": (3, True), "C:\\D": (4, True), "C:\\D\\x": (5, True), "C:\\D\\sub": (6, True), "C:\\D\\sub\\deep": (7, True), "C:\\new": ("new", False)} and walks == ["C:\\new"]
    assert after(spark, []) == (same, [])


def test_too_many_events_ask_for_a_scan_and_walks_add_no_duplicates(spark):
    entries = spark.createDataFrame(TREE, COLS)
    events = spark.createDataFrame([("C", i, "changed", "C:\\D", None, True) for i in range(6)], EVENTS)
    assert watch_batch(entries, events, overflow=5).rescan and not watch_batch(entries, events, overflow=6).rescan
    found = spark.createDataFrame([row(90, 1, "C:\\D\\A"), row(91, 1, "C:\\D\\c"), row(92, 1, "C:\\D\\C")], COLS)
    assert add_walked(entries, found).count() == len(TREE) + 1
    rooted = spark.createDataFrame([("C", 1, "created", "C:\\D\\new", None, False), ("C", 2, "created", "C:\\other", None, False), ("C", 3, "renamed", "C:\\E\\b", "C:\\D\\b", False), ("C", 4, None, None, None, None)], EVENTS)
    inside = watch_batch(entries.filter("full_path like 'C:%D%' and full_path not like '%E%'"), rooted, root="C:\\D\\")
    assert sorted(r.full_path for r in inside.entries.collect()) == ["C:\\D", "C:\\D\\a", "C:\\D\\new"]


def brute(paths, events):
    """All paths as a dictionary from folded path to (id, path); every event rewrites it."""
    now = {p.lower(): (i, p) for i, p in paths}
    fresh = 0

    def up(p):
        return p.rpartition("\\")[0]

    def drop(p):
        for k in [k for k in now if k == p or k.startswith(p + "\\")]:
            del now[k]

    def upsert(p):
        nonlocal fresh
        if p.lower() not in now and (up(p).lower() in now or up(p) == "C:"):
            fresh += 1
            now[p.lower()] = (f"n{fresh}", up(p) if up(p) == "C:" else now[up(p).lower()][1])
            now[p.lower()] = (f"n{fresh}", now[p.lower()][1] + "\\" + p.rpartition("\\")[2])

    for kind, path, old in events:
        if kind == "created":
            upsert(path)
        elif kind == "deleted":
            drop(path.lower())
        elif old.lower() not in now:
            upsert(path)
        else:
            whole = {k: v for k, v in now.items() if k == old.lower() or k.startswith(old.lower() + "\\")}
            top = whole[old.lower()][1]
            drop(old.lower())
            if up(path).lower() in now or up(path) == "C:":
                drop(path.lower())
                to = ("C:" if up(path) == "C:" else now[up(path).lower()][1]) + "\\" + path.rpartition("\\")[2]
                for k, (i, p) in whole.items():
                    now[(to + p[len(top) :]).lower()] = (i, to + p[len(top) :])
    return {p for _, p in now.values()}


@pytest.mark.parametrize("seed", range(3))
def test_random_batches_equal_path_rewriting(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "c", "dd"]
    paths = [("C:\\" + "\\".join(c)) for c in [(x,) for x in names[:3]] + [(x, y) for x in names[:3] for y in names[:2]] + [(x, y, z) for x in names[:2] for y in names[:2] for z in names[:3]]]
    some = lambda: "C:\\" + "\\".join(rng.choice(names) if rng.random() < 0.8 else rng.choice(names).upper() for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))
    events = [(k, some(), some() if k == "renamed" else None) for k in (rng.choice(["created", "deleted", "renamed", "renamed"]) for _ in range(40))]
    ids = {p: i for i, p in enumerate(paths, 1)}
    tree = [row(i, ids.get(p.rpartition("\\")[0], 0), p, True) for p, i in ids.items()]
    got, _ = after(spark, [(k, p, o, True) for k, p, o in events], tree)
    assert set(got) == brute([(i, p) for p, i in ids.items()], events)


def test_names_are_asked_for_before_they_count():
    tree = Tree({"c:\\a": (1, "C:\\A", True)})
    tree.apply("renamed", "C:\\b", "C:\\a", True)
    tree.apply("deleted", "C:\\b\\x", None, False)
    assert tree.asked == {"c:\\b", "c:\\a\\x"}


def test_a_batch_falls_into_parts_that_do_not_meet(spark):
    events = [
        ("renamed", "C:\\a2", "C:\\a"), ("deleted", "C:\\A2\\x", None), ("created", "C:\\a\\\\y\\", None), ("changed", "C:\\b\\c", None), ("created", "C:\\b\\d", None), ("renamed", "C:\\e\\f", "C:\\g"), ("changed", "C:\\G\\h", None), ("created", "C:\\ab", None),
    ]
    df = spark.createDataFrame([("C", i, k, p, o, True) for i, (k, p, o) in enumerate(events)] + [("D", 9, "changed", "C:\\a", None, True)], EVENTS)
    parts = {}
    for r in _parted(df).collect():
        parts.setdefault((r.volume_id, r.part), set()).add(r.seq)
    assert sorted(map(sorted, parts.values())) == [[0, 1, 2], [3], [4], [5, 6], [7], [9]]


def test_drives_in_two_spellings_give_each_entry_once(spark):
    tree = [row(1, 0, "C:\\D", True), row(2, 1, "C:\\D\\a"), row(3, 1, "C:\\D\\b"), row(4, 1, "C:\\D\\c")]
    df = spark.createDataFrame([("C", 1, "changed", "c:\\D\\a", None, False), ("C", 2, "renamed", "C:\\D\\b2", "c:\\D\\b", False), ("C", 3, "created", "C:\\n", None, False)], EVENTS)
    got = watch_batch(spark.createDataFrame(tree, COLS), df).entries
    assert sorted(r.full_path for r in got.collect()) == ["c:\\D", "c:\\D\\a", "c:\\D\\b2", "c:\\D\\c", "c:\\n"]
