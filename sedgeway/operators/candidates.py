"""What can be brought back: candidates from every source in one table, and where each of them goes.

Sources are the deletion log, the Recycle Bin, undeleted records, versions in snapshots and carving. Each
``from_...`` gives the columns of ``schemas.CANDIDATES``; ``route`` decides for a whole list what is done, with
an error in place of an exception, so that one bad candidate ends nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeway import schemas as S
from sedgeway.functions.names import restore_name, safe_file_name
from sedgeway.operators.recovery import COPY_RANK, rank_of, unique_names
from sedgeway.runtime import cut

#: Sources whose data a copy onto the same volume can't overwrite.
SAFE_ON_SAME_VOLUME = ("RecycleBin", "ShadowCopy")
SOURCES = ("DeletionLog", "RecycleBin", "Undelete", "ShadowCopy", "Carving")


def _folder(path: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(path, r"\\+$", ""), r"\\?[^\\]*$", ""), F.lit(""))


def _name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\+$", ""), r"([^\\]*)$", 1)


def _candidates(df: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CANDIDATES.fields], *keep)


def from_log(deletions: DataFrame, *keep: str) -> DataFrame:
    """Deletions of the log: grade Unknown, as nothing is known of the data."""
    return _candidates(
        deletions, keep, source=F.lit("DeletionLog"), name=F.col("name"), original_folder=F.nullif(F.col("parent_path"), F.lit("")), size=F.col("size"), modified=F.col("modified"), deleted_at=F.col("deleted_at"),
        grade=F.lit("Unknown"), percent_intact=F.lit(0), is_dir=F.col("is_dir"),
    )


def from_bin(pairs: DataFrame, *keep: str) -> DataFrame:
    """Recycle Bin items of ``recovery.recycle_pairs``: Excellent with both halves, else Unknown with what is missing."""
    data, info = F.col("data_name").isNotNull(), F.col("info_name").isNotNull()
    whole = data & info
    detail = F.when(~data, "its data is gone").when(~info, "its name and folder are unknown")
    return _candidates(
        pairs, keep, source=F.lit("RecycleBin"), name=F.coalesce(_name(F.col("original_path")), "data_name", "info_name"), original_folder=_folder(F.col("original_path")), size=F.col("size"), deleted_at=F.col("deleted_at"),
        grade=F.when(whole, "Excellent").otherwise("Unknown"), percent_intact=F.when(whole, 100).otherwise(0), is_dir=F.coalesce("is_dir", F.lit(False)), detail=detail,
    )


def from_undelete(graded: DataFrame, *keep: str) -> DataFrame:
    """Graded records, with the folder and the log's details where they were joined."""
    has = lambda c: F.col(c) if c in graded.columns else F.lit(None)
    return _candidates(
        graded, keep, source=F.lit("Undelete"), name=F.col("name"), original_folder=has("original_folder"), size=F.col("size"), modified=F.col("modified"), deleted_at=has("deleted_at"), grade=F.col("grade"),
        percent_intact=F.col("percent_intact"), is_dir=F.col("is_dir"), detail=has("detail"),
    )


def from_versions(versions: DataFrame, *keep: str) -> DataFrame:
    """Versions (full_path, size, modified, is_dir, created) in snapshots: Excellent, dated by the snapshot."""
    return _candidates(
        versions, keep, source=F.lit("ShadowCopy"), name=_name(F.col("full_path")), original_folder=_folder(F.col("full_path")), size=F.col("size"), modified=F.col("modified"), deleted_at=F.col("created"),
        grade=F.lit("Excellent"), percent_intact=F.lit(100), is_dir=F.col("is_dir"), detail=F.concat(F.lit("Snapshot from "), F.date_format("created", "yyyy-MM-dd HH:mm")),
    )


def from_carving(carved: DataFrame, *keep: str) -> DataFrame:
    """Carved files: Excellent, the label and what the structure says as detail."""
    return _candidates(
        carved, keep, source=F.lit("Carving"), name=F.col("suggested_name"), size=F.col("size"), grade=F.lit("Excellent"), percent_intact=F.lit(100), is_dir=F.lit(False), detail=F.concat_ws(" · ", "label", "info"),
    )


def all_candidates(*lists: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), lists)


def different_volume(destination: str, source_root: str, volumes: DataFrame | None = None) -> tuple[bool, str]:
    """Whether ``destination`` may take files recovered from the volume at ``source_root``, and why not.

    Volumes (root, serial) are compared by serial where both are listed, else by their root. Relative and network paths are refused.
    """
    where = destination.replace("/", "\\")
    if where.startswith("\\"):
        return False, "the destination is a network path; it must be a folder of a local drive"
    if len(where) < 3 or where[1:3] != ":\\":
        return False, "the destination is no full path of a folder"
    root, source = where[:3].upper(), source_root[:2].upper() + "\\"
    serials = {} if volumes is None else {r["root"][:2].upper() + "\\": r["serial"] for r in volumes.select("root", "serial").collect() if r["serial"] is not None}  # a row for each drive
    same = serials[root] == serials[source] if root in serials and source in serials else root == source
    return (False, f"the destination lies on drive {source[0]}:, from which files are recovered") if same else (True, "")


def route(candidates: DataFrame, destination: str, source_root: str, volumes: DataFrame | None = None) -> DataFrame:
    """``candidates`` with ``action`` (copy_bin, copy_record, copy_folder, copy_version, copy_range) or an ``error``, and ``target``.

    Undelete and carving never write to the volume they read. The log has no data of its own.
    """
    other, why = different_volume(destination, source_root, volumes)
    source = F.col("source")
    error = F.when(F.lit(not other) & ~source.isin(*SAFE_ON_SAME_VOLUME), F.lit(why)).when(source == "DeletionLog", "an entry of the log holds no data; its record may").when(
        source.isNull() | ~source.isin(*SOURCES), F.concat(F.coalesce(source, F.lit("?")), F.lit(" is no source that can be copied"))
    )
    action = F.when(source == "RecycleBin", "copy_bin").when(source == "ShadowCopy", "copy_version").when(source == "Carving", "copy_range").when(F.col("is_dir"), "copy_folder").otherwise("copy_record")
    named = F.when(source == "ShadowCopy", restore_name(F.col("name"), F.col("deleted_at"))).otherwise(safe_file_name(F.col("name")))
    rows = candidates.withColumns({"error": error, "action": F.when(error.isNull(), action), "folder": F.lit(destination.rstrip("\\")), "_wanted": named})
    good = unique_names(rows.filter("error is null"), "folder", "_wanted").withColumn("target", F.concat_ws("\\", "folder", "target"))
    return good.unionByName(rows.filter("error is not null").withColumn("target", F.lit(None).cast("string"))).drop("_wanted", "folder")


def below_deleted(records: DataFrame, folders: DataFrame, rounds: int = 64) -> DataFrame:
    """(volume_id, top, record_no, sequence, level, path) of all that hangs from deleted ``folders`` (volume_id, record_no, sequence).

    A child names its folder's record, and the sequence it had or the one before, as deleting a folder adds one. A round
    goes a level down; what was met already is left out, so loops end.
    """
    dead = records.filter("not in_use").select("volume_id", F.col("record_no").alias("c_rec"), F.col("sequence").alias("c_seq"), F.col("parent_record").alias("c_up"), F.col("parent_sequence").alias("c_up_seq"), F.col("name").alias("c_name"), F.col("is_dir").alias("c_dir"))
    at = folders.select("volume_id", F.col("record_no").alias("top"), "record_no", "sequence", F.lit("").alias("path"))
    found, seen = None, cut(at.select("volume_id", "top", "record_no"))
    for level in range(1, rounds + 1):
        near = (F.col("c_rec") != F.col("record_no")) & (F.col("sequence") - F.col("c_up_seq")).isin(0, 1)
        down = at.join(dead.withColumnRenamed("volume_id", "c_vol"), (F.col("volume_id") == F.col("c_vol")) & (F.col("c_up") == F.col("record_no")) & near)
        step = down.select("volume_id", "top", F.col("c_rec").alias("record_no"), F.col("c_seq").alias("sequence"), F.lit(level).alias("level"), F.when(F.col("path") == "", F.col("c_name")).otherwise(F.concat_ws("\\", "path", "c_name")).alias("path"), F.col("c_dir").alias("is_dir"))
        step = cut(step.join(seen, ["volume_id", "top", "record_no"], "left_anti").dropDuplicates(["volume_id", "top", "record_no"]))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        seen = seen.unionByName(step.select("volume_id", "top", "record_no"))
        at = step.filter("is_dir").select("volume_id", "top", "record_no", "sequence", "path")
    if found is None:
        return at.select("volume_id", "top", "record_no", "sequence", F.lit(0).alias("level"), "path").limit(0)
    return found.drop("is_dir")


def folder_results(tree: DataFrame, recovered: DataFrame) -> DataFrame:
    """For each recovered folder (volume_id, top): bytes, the worst final grade and how many of its files failed.

    ``recovered`` has (volume_id, record_no, bytes, final_grade, error) of files.
    """
    each = tree.join(recovered, ["volume_id", "record_no"])
    ok = F.col("error").isNull()
    failed = F.count_if(~ok)
    rows = each.groupBy("volume_id", "top").agg(
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max_by("final_grade", F.when(ok, rank_of(F.col("final_grade"), COPY_RANK))), F.lit("Excellent")).alias("final_grade"),
        failed.alias("failed"), F.count("*").alias("items"),
    )
    return rows.withColumn("error", F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("items").cast("string"), F.lit(" items failed"))))


def final_grade(listed: Column, copied: Column) -> Column:
    """The worse of the grade in the list and that found when copying: a grade only goes down."""
    return F.when(rank_of(copied, COPY_RANK) > rank_of(listed, COPY_RANK), copied).otherwise(listed)


def reconcile_drives(known: DataFrame, present: DataFrame) -> DataFrame:
    """(drive_letter, change): drives gone, back or added, from known ones (drive_letter, serial, online) and those present (drive_letter, serial).

    A letter with another serial is another drive: the known one is gone first, and then the new one added.
    """
    p = present.select(F.col("drive_letter").alias("_letter"), F.col("serial").alias("_serial"))
    both = known.join(p, F.col("drive_letter") == F.col("_letter"), "full_outer")
    same = F.col("serial").eqNullSafe(F.col("_serial")) & F.col("_letter").isNotNull() & F.col("drive_letter").isNotNull()
    change = (
        F.when(F.col("drive_letter").isNull(), "added").when(~same & F.col("online"), "gone").when(same & ~F.col("online"), "back").when(~same & F.col("_letter").isNotNull() & ~F.col("online"), "added")
    )
    return both.select(F.coalesce("drive_letter", "_letter").alias("drive_letter"), change.alias("change")).filter("change is not null")


def scan_order(sort: str = "type") -> list[Column]:
    """Orders of carved files: by type and place, by size, or by place."""
    if sort == "size":
        return [F.desc("size"), F.asc("start_lcn")]
    return [F.asc("start_lcn")] if sort == "location" else [F.asc(F.lower("label")), F.asc("start_lcn")]
