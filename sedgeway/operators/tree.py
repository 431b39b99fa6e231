"""Folder trees given by parent ids: paths, depths, orphans, cycles, deleted subtrees.

Paths come from pointer doubling: every round joins each unfinished row to the row that its pointer names,
so a tree of depth d takes about log2(d) joins, not d. Rows that have reached a root leave the rounds. A
folder that holds very many entries makes a skewed join side that Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.runtime import cut

#: Names below the root that no scan lists, folded. Fixed values.
SKIPPED_ROOT_NAMES = (
    "$mft", "$mftmirr", "$logfile", "$volume", "$attrdef", "$bitmap", "$boot", "$badclus", "$secure", "$upcase", "$extend", "$recycle.bin",
    "system volume information",
)
#: Rounds at most: chains of up to 2^12 ancestors.
ROUNDS = 12
MAX_DEPTH = 255
#: Roots that are broadcast at most; more are joined by a shuffle.
MAX_ROOTS = 10_000


def resolve(entries: DataFrame, roots: DataFrame, entry: str = "entry_id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """(entry, full_path, depth, state, gone) for every entry.

    ``roots`` has (root_id, root). ``state`` is ``ok``, ``orphan`` (some ancestor is missing) or ``cycle``;
    rows that aren't ok hang from no root: their path is their name, their depth 1, and they count as gone.
    ``gone`` is true as well where the entry or an ancestor is deleted.
    """
    deleted = F.col("deleted") if "deleted" in entries.columns else F.lit(False)
    base = entries.select(F.col(entry).alias("id"), F.col(parent).alias("up"), F.col(name).alias("path"), F.lit(1).alias("steps"), F.coalesce(deleted, F.lit(False)).alias("gone"))
    top = roots.select(F.col("root_id").alias("up"), "root")
    if roots.limit(MAX_ROOTS + 1).count() <= MAX_ROOTS:
        top = F.broadcast(top)
    done: list[DataFrame] = []
    open_rows = cut(base)
    jumps = open_rows
    for _ in range(ROUNDS):
        reached = open_rows.join(top, "up")
        ended = reached.select("id", F.concat_ws("\\", "root", "path").alias("full_path"), F.least(F.col("steps"), F.lit(MAX_DEPTH)).alias("depth"), F.lit("ok").alias("state"), "gone")
        rest = open_rows.join(top.select("up"), "up", "left_anti")
        above = jumps.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("steps").alias("a_steps"), F.col("gone").alias("a_gone"))
        joined = rest.join(above, F.col("up") == F.col("a_id"), "left")
        lost = joined.filter(F.col("a_id").isNull()).select("id", F.lit("orphan").alias("state"))
        done.append(cut(ended.unionByName(_loose(base, lost))))  # each round's rows are written once
        if done[-1].isEmpty():
            break  # on every way to an end some row ends in each round, so the rest goes in circles
        open_rows = cut(
            joined.filter(F.col("a_id").isNotNull()).select("id", F.col("a_up").alias("up"), F.concat_ws("\\", "a_path", "path").alias("path"), (F.col("steps") + F.col("a_steps")).alias("steps"), (F.col("gone") | F.col("a_gone")).alias("gone"))
        )
        # Rows that are through still serve as steps of others: keep every row's longest jump.
        jumps = cut(open_rows.unionByName(jumps.join(open_rows.select("id"), "id", "left_anti")))
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, _loose(base, open_rows.select("id", F.lit("cycle").alias("state")))])


def _loose(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids, "id").select("id", F.col("path").alias("full_path"), F.lit(1).alias("depth"), "state", F.lit(True).alias("gone"))


def delete_subtrees(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``entries`` with ``deleted`` set for all that lies below a deleted folder or hangs from no root."""
    state = resolve(entries, roots).select("id", "gone")
    return entries.join(state, entries["entry_id"] == state["id"], "left").withColumn("deleted", F.coalesce("gone", F.lit(True))).drop("id", "gone")


def exclude_folders(entries: DataFrame, folders: list[str]) -> DataFrame:
    """``entries`` without the given folders and what they hold."""
    out = entries
    for f in (x.rstrip("\\").lower() for x in folders):
        out = out.filter(~((F.col("fold_path") == f) | F.startswith("fold_path", F.lit(f + "\\"))))
    return out


def build(records: DataFrame, root_record: int = 5) -> DataFrame:
    """Entries with paths from (record_no, parent_record_no, name, is_dir, ...) rows in any order; orphans are deleted.

    The file system's own files below the root are left out, and so is what hangs from them.
    """
    records = records.filter((F.col("parent_record_no") != root_record) | ~F.lower("name").isin(*SKIPPED_ROOT_NAMES))
    roots = records.sparkSession.createDataFrame([(root_record, "")], "root_id long, root string")
    state = resolve(records.withColumnRenamed("record_no", "entry_id").withColumnRenamed("parent_record_no", "parent_id"), roots)
    return records.join(state, records["record_no"] == state["id"]).withColumn("deleted", F.col("gone")).drop("id", "gone")


# --- intervals: every entry's subtree as a range of places in one order


#: Parts of paths in the order of the tree: below a folder comes before what follows it.
_INTO, _OUT_OF = "\x01", "\x02"


def _tour(entries: DataFrame, *kept: str) -> DataFrame:
    """(place, id, out, kept): a walk over the tree by path, with a row where each entry is entered and one where each folder is left.

    The walk is a range sort: tasks hold ranges of paths, and a place holds its task's number above 33 bits.
    """
    key = F.replace(F.col("fold_path"), F.lit("\\"), F.lit(_INTO))
    row = entries.select(F.col("entry_id").alias("id"), "is_dir", key.alias("_key"), *kept)
    both = row.withColumn("out", F.lit(0)).unionByName(row.filter("is_dir").withColumns({"out": F.lit(1), "_key": F.concat("_key", F.lit(_OUT_OF))})).drop("is_dir")
    order = ["_key", "out", "id"]
    return cut(both.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key").withColumn("place", F.monotonically_increasing_id()))


def _running(walk: DataFrame, **sums: Column) -> DataFrame:
    """``walk`` with running sums up to each place: within tasks, after the sums of the tasks before."""
    task = F.call_function("shiftright", F.col("place"), F.lit(33))
    named = walk.withColumns({"_task": task} | {f"_{k}": c.cast("long") for k, c in sums.items()})
    totals = named.groupBy("_task").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    earlier = totals.select("_task", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    upto = Window.partitionBy("_task").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = named.withColumns({f"_r_{k}": F.sum(f"_{k}").over(upto) for k in sums}).join(F.broadcast(earlier), "_task")  # a row for each task
    return out.select(*walk.columns, *[(F.col(f"_r_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def intervals(entries: DataFrame) -> DataFrame:
    """(entry_id, enter, leave): what is below an entry, or itself, has an ``enter`` between the two. Numbers grow with the path's order; those of two calls don't compare."""
    return _tour(entries).groupBy(F.col("id").alias("entry_id")).agg(F.min("place").alias("enter"), F.max("place").alias("leave"))


def totals_below(entries: DataFrame) -> DataFrame:
    """(entry_id, files, folders, bytes) of what is below every folder, at any depth: one sort and running sums, whatever the depth.

    ``entries`` need entry_id, is_dir, size and fold_path, each path once.
    """
    entered = F.col("out") == 0
    walk = _running(_tour(entries.withColumn("_d", F.col("is_dir")), "_d", "size"), files=(entered & ~F.col("_d")).cast("int"), folders=(entered & F.col("_d")).cast("int"), bytes=F.when(entered & ~F.col("_d"), F.coalesce("size", F.lit(0))).otherwise(0))
    both = walk.filter("_d").groupBy(F.col("id").alias("entry_id"))
    return both.agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("files", "folders", "bytes")])


def without_subtrees(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """``entries`` without those in ``gone`` (entry_id) and all that is below them: a running count of the gone folders that a place is in, so no number of them is tested one by one."""
    marked = entries.select("entry_id", "is_dir", "fold_path").join(gone.select("entry_id", F.lit(1).alias("_gone")).distinct(), "entry_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(0)))
    walk = _running(_tour(marked.withColumn("_d", F.col("is_dir")), "_d", "_gone"), inside=F.when(F.col("out") == 1, -F.col("_gone")).when(F.col("_d"), F.col("_gone")).otherwise(0))
    stay = walk.filter("out = 0 and inside = 0 and (_d or _gone = 0)").select(F.col("id").alias("_stay"))
    return entries.join(stay, F.col("entry_id") == F.col("_stay"), "left_semi")
