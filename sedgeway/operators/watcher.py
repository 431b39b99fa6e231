"""Watcher events by path, applied to the entries of a tree in their order.

The events of a batch (``OVERFLOW`` at most, else a new scan is due) are composed first. They fall into parts that don't meet
(``_parted``), and for each part a sparse tree of the paths that it names tells, in order, which folder each path means at that
time; a task holds one part. What comes out is one mapping from old subtrees to their new places, or to none, with the
entries that are new. The entries, however many, then take the mapping of their longest prefix: one join for each depth at
which a mapping starts.

An event's meaning hangs on what was there before: a path below a folder that the batch has renamed is looked up under
its old name. The names that composing asks for and that haven't been looked up yet are looked up, and their parts are composed
again; most batches need one pass or two.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sedgeway.functions.names import fold
from sedgeway.operators.components import connected_components
from sedgeway.runtime import cut, discard
from sedgeway.sources.entries import derive

#: Events of a batch at most. Fixed value.
OVERFLOW = 200_000
_OUT = "volume_id string, part bigint, what string, old_fold string, old_path string, new_path string, is_dir boolean, stale boolean, parent_entry bigint, parent_path string"


class Watched(NamedTuple):
    """Entries after a batch, the folders that came in and are to be scanned (volume_id, path), and whether all of it must be."""

    entries: DataFrame
    walks: DataFrame | None
    rescan: bool


class _Node:
    """A path that the batch names: where it was at the start (``origin``, None if it is new) and where it hangs now."""

    __slots__ = ("name", "up", "below", "origin", "path", "entry", "is_dir", "stale")

    def __init__(self, name: str, up: _Node | None, origin: str | None, path: str | None = None, entry: int | None = None, is_dir: bool = True):
        self.name, self.up, self.origin, self.path, self.entry, self.is_dir = name, up, origin, path, entry, is_dir
        self.below: dict[str, _Node | None] = {}  # None: nothing there any more
        self.stale = False


def _fold(name: str) -> str:
    return name.lower()


class Tree:
    """The tree as far as events name it. ``known`` gives (entry_id, full_path, is_dir) of folded paths, None for paths that aren't there; ``asked`` collects those it lacks."""

    def __init__(self, known: dict[str, tuple[int, str, bool] | None], root: str | None = None):
        self.known, self.asked, self.nodes, self.roots = known, set(), [], {}
        self.root = None if root is None else root.rstrip("\\")

    def _top(self, path: str) -> tuple[_Node | None, list[str]]:
        path = path.rstrip("\\")
        head = path.split("\\", 1)[0] if self.root is None else self.root
        if _fold(path) != _fold(head) and not _fold(path).startswith(_fold(head) + "\\"):
            return None, []
        top = self.roots.setdefault(_fold(head), _Node(head, None, _fold(head), head, 0))
        return top, [x for x in path[len(head) :].split("\\") if x]

    def _child(self, node: _Node, name: str) -> _Node | None:
        key = _fold(name)
        if key in node.below:
            return node.below[key]
        if node.origin is None:
            return None
        origin = f"{node.origin}\\{key}"
        if origin not in self.known:
            self.asked.add(origin)
            return None
        if (found := self.known[origin]) is None:
            return None
        entry, path, is_dir = found
        child = node.below[key] = _Node(path.rsplit("\\", 1)[-1], node, origin, path, entry, is_dir)
        self.nodes.append(child)
        return child

    def find(self, path: str | None) -> _Node | None:
        if not path:
            return None
        node, names = self._top(path)
        for name in names:
            if node is None:
                return None
            node = self._child(node, name)
        return node

    def _folder_of(self, path: str) -> tuple[_Node | None, str]:
        folder, _, name = path.rstrip("\\").rpartition("\\")
        return self.find(folder), name

    def _remove(self, node: _Node) -> None:
        node.up.below[_fold(node.name)] = None
        node.up = None

    def _upsert(self, path: str, is_dir: bool) -> None:
        if (there := self.find(path)) is not None:
            there.stale = True
            return
        folder, name = self._folder_of(path)
        if folder is not None and name:
            node = folder.below[_fold(name)] = _Node(name, folder, None, is_dir=is_dir)
            self.nodes.append(node)

    def apply(self, kind: str, path: str, old_path: str | None, is_dir: bool) -> None:
        if kind == "created":
            self._upsert(path, is_dir)
        elif kind == "changed":
            if (node := self.find(path)) is not None:
                node.stale = True
        elif kind == "deleted":
            if (node := self.find(path)) is not None and node.up is not None:
                self._remove(node)
        elif kind == "renamed":
            node = self.find(old_path)
            if node is None or node.up is None:
                self._upsert(path, is_dir)
                return
            folder, name = self._folder_of(path)
            self._remove(node)
            inside, impossible = folder, folder is None or not name
            while inside is not None and not impossible:
                impossible, inside = inside is node, inside.up
            if impossible:
                return  # left the tree, or moved into itself
            replaced = self._child(folder, name)
            if replaced is not None:
                replaced.up = None
            folder.below[_fold(name)] = node
            node.up, node.name = folder, name

    def place(self, node: _Node) -> str | None:
        """The path at which a node hangs now."""
        names = []
        while node.up is not None:
            names.append(node.name)
            node = node.up
        return "\\".join([node.path, *reversed(names)]) if self.roots.get(node.origin) is node else None

    def rows(self) -> list[tuple]:
        """(what, old_fold, old_path, new_path, is_dir, stale, parent_entry, parent_path): mappings that the one above them doesn't imply, and new entries."""
        out: list[tuple] = []
        maps: dict[str, tuple[str, str | None]] = {}
        for node in sorted((n for n in self.nodes if n.origin), key=lambda n: n.origin.count("\\")):
            new, above, implied = self.place(node), node.origin, node.path
            while "\\" in above:
                above = above.rsplit("\\", 1)[0]
                if above in maps:
                    old, to = maps[above]
                    implied = None if to is None else to + node.path[len(old) :]
                    break
            if new != implied or (node.stale and new is not None):
                maps[node.origin] = node.path, new
                out.append(("map", node.origin, node.path, new, node.is_dir, node.stale, node.up.entry if new else None, self.place(node.up) if new and node.up.entry is None else None))
        for node in self.nodes:
            if node.origin is None and (new := self.place(node)) is not None:
                out.append(("new", None, None, new, node.is_dir, False, node.up.entry, self.place(node.up) if node.up.entry is None else None))
        return out


def _prefixes(path: Column) -> Column:
    """The folded path of every folder down to ``path``, itself the last."""
    parts = F.split(fold(F.regexp_replace(path, r"\\+$", "")), r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "\\"))


def _one_spelling(events: DataFrame) -> DataFrame:
    """``events`` whose paths begin with their drive as the first event of the volume spells it."""
    head = lambda c: F.substring_index(c, "\\", 1)
    paths = events.select("volume_id", F.inline(F.array(*[F.struct("seq", F.lit(i).alias("i"), F.col(c).alias("p")) for i, c in enumerate(("old_path", "path"))]))).filter("p != ''")
    several = paths.groupBy("volume_id", fold(head(F.col("p"))).alias("_head")).agg(F.min_by(head(F.col("p")), F.struct("seq", "i")).alias("_as"), (F.min(head(F.col("p"))) != F.max(head(F.col("p")))).alias("_differ"))
    several = F.broadcast(several.filter("_differ").drop("_differ"))  # drives in two spellings
    for c in ("path", "old_path"):
        at = F.length(head(F.col(c)))
        joined = events.withColumn("_head", fold(head(F.col(c)))).join(several, ["volume_id", "_head"], "left")
        events = joined.withColumn(c, F.when(F.col("_as").isNull(), F.col(c)).otherwise(F.concat("_as", F.substr(F.col(c), at + 1)))).select(events.columns)
    return events


def _parted(events: DataFrame) -> DataFrame:
    """``events`` with ``part``: events of two parts don't meet, whatever their order.

    An event changes what stands at its paths and reads the folders above, so two events can meet only if a path of one is a
    path of the other or lies below it. All paths that lie below one highest path of the batch are of its part, and a rename
    joins the parts of its two paths.
    """
    place = lambda c: fold(F.regexp_replace(F.regexp_replace(c, r"\\+$", ""), r"\\+", r"\\\\"))
    placed = events.withColumns({"_at": place(F.col("path")), "_old": place(F.col("old_path"))})
    paths = cut(placed.select("volume_id", F.explode(F.array("_at", "_old")).alias("_p")).filter("_p is not null").distinct())
    above = paths.select("volume_id", "_p", F.explode(F.filter(_prefixes(F.col("_p")), lambda up: up != F.col("_p"))).alias("_up"))
    taken = cut(above.select("volume_id", "_up").distinct().join(paths.select("volume_id", F.col("_p").alias("_up")), ["volume_id", "_up"], "left_semi"))
    tops = cut(above.join(taken, ["volume_id", "_up"]).groupBy("volume_id", "_p").agg(F.min_by("_up", F.length("_up")).alias("_top")))
    for c, to in (("_at", "a"), ("_old", "b")):
        placed = placed.join(tops.withColumnRenamed("_p", c), ["volume_id", c], "left").withColumn(to, F.when(F.col(c).isNotNull(), F.xxhash64("volume_id", F.coalesce("_top", c)))).drop("_top")
    placed = cut(placed.drop("_at", "_old"))
    roots = connected_components(placed.filter("a != b")).withColumnRenamed("node", "a")
    out = cut(placed.join(roots, "a", "left").withColumn("part", F.coalesce("root", "a")).drop("a", "b", "root"))
    discard(paths, taken, tops, placed)
    return out


def _composed(events: DataFrame, known: DataFrame, root: str | None) -> DataFrame:
    """What each part of the batch asks for, or else its mappings and new entries. A task passes over parts one after another and holds one."""
    arrow = to_arrow_schema(T.StructType.fromDDL(_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, tree = None, None

        def close() -> None:
            rows = [("ask", p, *[None] * 6) for p in sorted(tree.asked)] or tree.rows()
            done.extend((*at, *r) for r in rows)

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for volume, part, kind, path, other, is_dir, entry in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if (volume, part) != at:
                    if at is not None:
                        close()
                    at, tree = (volume, part), Tree({}, root)
                if kind is None:  # what is known comes before the events
                    tree.known[path] = None if entry is None else (entry, other, bool(is_dir))
                else:
                    tree.apply(kind, path, other, is_dir)
            if len(done) >= 4096:
                yield out()
                done = []
        if at is not None:
            close()
        yield out()

    told = known.select("volume_id", "part", F.lit(None).cast("string").alias("kind"), F.col("asked").alias("path"), F.col("full_path").alias("old_path"), "is_dir", "entry_id", F.lit(0).alias("_i"), F.lit(None).cast(events.schema["seq"].dataType).alias("seq"))
    rows = told.unionByName(events.select("volume_id", "part", "kind", "path", "old_path", "is_dir", F.lit(None).cast("long").alias("entry_id"), F.lit(1).alias("_i"), "seq"))
    dealt = rows.repartition("volume_id", "part").sortWithinPartitions("volume_id", "part", "_i", "seq")
    return dealt.select("volume_id", "part", "kind", "path", "old_path", "is_dir", "entry_id").mapInArrow(run, _OUT)


def watch_batch(entries: DataFrame, events: DataFrame, overflow: int = OVERFLOW, root: str | None = None) -> Watched:
    """``entries`` after watcher events (volume_id, seq, kind, path, old_path, is_dir) by full path, in the order of seq.

    ``kind`` is created, changed, deleted or renamed. Folders take along what is below them. An entry comes in only below a
    folder that is indexed, with unknown metadata; one that is renamed to a place that isn't indexed, or into itself, goes; one that
    is renamed without having been known comes in. What stands at the new name of a rename is replaced. ``root`` is the folder that is
    indexed (by default the first part of a path is). Paths are compared in either case. Null paths and other kinds mean nothing.
    A batch of more than ``overflow`` events is not applied: all is to be scanned again.
    """
    spark = entries.sparkSession
    events = events.select("volume_id", "seq", "kind", "path", "old_path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
    if events.count() > overflow:
        return Watched(entries, None, True)
    events = events.filter(F.col("path").isNotNull() & F.col("kind").isin("created", "changed", "deleted", "renamed")).withColumn("old_path", F.when(F.col("kind") == "renamed", F.col("old_path")))
    events = _parted(cut(events if root is not None else _one_spelling(cut(events))))
    live = entries.filter(~F.coalesce("deleted", F.lit(False)))
    asked = cut(events.select("volume_id", "part", F.explode(F.array("path", "old_path")).alias("p")).filter("p is not null").select("volume_id", "part", F.explode(_prefixes(F.col("p"))).alias("asked")).distinct())
    index = live.select("volume_id", F.col("fold_path").alias("asked"), "entry_id", "full_path", "is_dir")
    done: DataFrame | None = None
    while True:
        there = index.join(asked.select("volume_id", "asked").distinct(), ["volume_id", "asked"], "left_semi").dropDuplicates(["volume_id", "asked"])
        told = cut(_composed(events, asked.join(there, ["volume_id", "asked"], "left"), root))
        settled = told.filter("what != 'ask'")
        done = settled if done is None else done.unionByName(settled)
        more = told.filter("what = 'ask'").select("volume_id", "part", F.col("old_fold").alias("asked"))
        if more.isEmpty():
            break
        left = more.select("volume_id", "part").distinct()
        before = events, asked
        events, asked = (cut(df) for df in (events.join(left, ["volume_id", "part"], "left_semi"), asked.join(left, ["volume_id", "part"], "left_semi").unionByName(more)))
        discard(*before)
    maps = done.drop("part").filter("what = 'map'").distinct().withColumn("_depth", F.size(F.split("old_fold", r"\\")))
    new_id = lambda path: F.xxhash64("volume_id", path)
    parent = F.coalesce("parent_entry", new_id("parent_path"))
    maps = cut(maps.select("volume_id", "_depth", F.col("old_fold").alias("_key"), F.struct("old_fold", F.length("old_path").alias("length"), "new_path", "stale", parent.alias("parent")).alias("_hit")))
    depths = sorted(r["_depth"] for r in maps.select("_depth").distinct().collect())  # as many as a path has parts
    out = live.withColumn("_map", F.lit(None).cast(maps.schema["_hit"].dataType))
    for d in depths:  # the deepest decides
        at = maps.filter(F.col("_depth") == d).drop("_depth")  # broadcast by Spark if they are few
        out = out.withColumn("_key", F.substring_index("fold_path", "\\", d)).join(at, ["volume_id", "_key"], "left").withColumn("_map", F.coalesce("_hit", "_map")).drop("_key", "_hit")
    out = out.filter("_map is null or _map.new_path is not null")
    itself = F.coalesce(F.col("_map.old_fold") == F.col("fold_path"), F.lit(False))
    moved = F.concat(F.col("_map.new_path"), F.expr("substring(full_path, _map.length + 1)"))
    changed = {
        "parent_id": F.when(itself, F.col("_map.parent")).otherwise(F.col("parent_id")),
        "name": F.when(itself, F.substring_index("_map.new_path", "\\", -1)).otherwise(F.col("name")),
        "metadata_known": F.col("metadata_known") & ~(itself & F.coalesce("_map.stale", F.lit(False))),
        "full_path": F.coalesce(moved, "full_path"),
    }
    if "depth" in entries.columns:
        changed["depth"] = (F.col("depth") + F.coalesce(F.size(F.split(moved, r"\\")) - F.size(F.split("full_path", r"\\")), F.lit(0))).cast(entries.schema["depth"].dataType)
    out = out.withColumns(changed).drop("_map")
    fresh = done.filter("what = 'new'")
    added = fresh.select(
        "volume_id", new_id("new_path").alias("entry_id"), parent.alias("parent_id"), F.substring_index("new_path", "\\", -1).alias("name"), "is_dir", F.lit(False).alias("deleted"), F.lit(False).alias("metadata_known"),
        F.lit(0).cast("long").alias("size"), F.col("new_path").alias("full_path"),
    )
    if "depth" in entries.columns:
        added = added.withColumn("depth", (F.size(F.split("full_path", r"\\")) - 1).cast(entries.schema["depth"].dataType))
    for c in ("hidden", "system", "reparse"):
        if c in entries.columns:
            added = added.withColumn(c, F.lit(False))
    both = derive(out.unionByName(added, allowMissingColumns=True))
    walks = fresh.filter("is_dir").select("volume_id", F.col("new_path").alias("path"))
    return Watched(both.select(entries.columns), walks, False)


def add_walked(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with the rows of ``found`` (columns of entries) that a scan of the folders in ``Watched.walks`` gave; what is there already stays, once, whatever its case."""
    new = found.join(entries.select("volume_id", "fold_path"), ["volume_id", "fold_path"], "left_anti").dropDuplicates(["volume_id", "fold_path"])
    return entries.unionByName(new.select(*[c for c in entries.columns if c in new.columns]), allowMissingColumns=True)
