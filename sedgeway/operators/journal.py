"""Change capture: a journal of file changes applied to entries, and the log of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway import schemas as S
from sedgeway.functions.names import fold, is_delete_marker, is_recycled_name
from sedgeway.operators.tree import SKIPPED_ROOT_NAMES, resolve
from sedgeway.runtime import cut, replace_parquet

#: Seconds within which a create of the same name makes a deletion a replacement; deletions kept for each volume.
REPLACE_SECONDS = 2
RING = 50_000
ROOT_RECORD = 5


def has(reason: int) -> Column:
    return F.col("reason").bitwiseAND(F.lit(reason)) != 0


def closed(journal: DataFrame) -> DataFrame:
    """Only records of closed handles, whose reasons are complete."""
    return journal.filter(has(S.CLOSE))


def until(journal: DataFrame, usn: int) -> DataFrame:
    """The history before ``usn``."""
    return journal.filter(F.col("usn") < usn)


def last_state(journal: DataFrame) -> DataFrame:
    """The newest record of each file: one aggregate, summed up before the shuffle."""
    cols = [c for c in journal.columns if c not in ("volume_id", "record_no")]
    return journal.groupBy("volume_id", "record_no").agg(F.max_by(F.struct(*cols), "usn").alias("r")).select("volume_id", "record_no", "r.*")


def rename_pairs(journal: DataFrame) -> DataFrame:
    """Renames with the old name that the record's latest RENAME_OLD_NAME gave."""
    w = Window.partitionBy("volume_id", "record_no").orderBy("usn").rowsBetween(Window.unboundedPreceding, -1)
    old = F.last(F.when(has(S.RENAME_OLD_NAME), F.col("name")), ignorenulls=True).over(w)
    return journal.withColumn("old_name", old).filter(has(S.RENAME_NEW_NAME)).select("volume_id", "record_no", "usn", "old_name", F.col("name").alias("new_name"))


def replaced(deletes_and_creates: DataFrame, seconds: int = REPLACE_SECONDS) -> DataFrame:
    """Deletions with ``kind`` Replaced where the next event of that name in that folder is a create within ``seconds``.

    Rows need volume_id, parent_record_no, name, ts, usn and ``event`` (delete or create).
    """
    w = Window.partitionBy("volume_id", "parent_record_no", fold(F.col("name"))).orderBy("usn")
    nxt, when = F.lead("event").over(w), F.lead("ts").over(w)
    soon = (nxt == "create") & (F.unix_micros(when.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= seconds * 1_000_000)
    return deletes_and_creates.withColumn("kind", F.when(soon, "Replaced").otherwise("Deleted")).filter("event = 'delete'")


def leaving_kind(name: Column, record_no: Column, parent_path: Column, parent_indexed: Column) -> Column:
    """Why a rename takes a file out of the tree: Deleted, Recycled, or null for a move within it."""
    p = F.lower(F.coalesce(parent_path, F.lit("")))
    in_bin = F.contains(p, F.lit("\\$recycle.bin\\")) | F.endswith(p, F.lit("\\$recycle.bin"))
    return F.when(is_delete_marker(name, record_no), "Deleted").when(parent_indexed & in_bin, "Recycled").when(~parent_indexed & is_recycled_name(name), "Recycled").when(~parent_indexed, "Deleted")


def adopt(entries: DataFrame, journal: DataFrame) -> DataFrame:
    """``entries`` with the record numbers of files that a batch names but no entry has: by folder and name in either case.

    Of entries that have no record yet, the first in a folder with the name of a record's first event takes that record.
    """
    known = entries.filter(~F.col("deleted"))
    folders = known.filter("is_dir").select(F.col("volume_id").alias("p_vol"), F.col("record_no").alias("p_rec"), F.col("entry_id").alias("p_entry"))
    first = journal.groupBy("volume_id", "record_no").agg(F.min_by(F.struct("parent_record_no", "name", "usn"), "usn").alias("e")).select("volume_id", "record_no", "e.*")
    strange = first.join(known.select("volume_id", "record_no"), ["volume_id", "record_no"], "left_anti")
    placed = strange.join(folders, (F.col("volume_id") == F.col("p_vol")) & (F.col("parent_record_no") == F.col("p_rec")), "left")
    placed = placed.withColumn("p_entry", F.when(F.col("parent_record_no") == ROOT_RECORD, F.lit(0)).otherwise(F.col("p_entry"))).filter("p_entry is not null")
    free = known.filter("record_no is null").groupBy(F.col("volume_id").alias("f_vol"), F.col("parent_id").alias("f_parent"), fold(F.col("name")).alias("f_fold")).agg(F.min("entry_id").alias("f_entry"))
    met = placed.join(free, (F.col("volume_id") == F.col("f_vol")) & (F.col("p_entry") == F.col("f_parent")) & (fold(F.col("name")) == F.col("f_fold")))
    taken = met.groupBy(F.col("f_vol").alias("a_vol"), F.col("f_entry").alias("a_entry")).agg(F.min_by("record_no", "usn").alias("a_rec"))
    out = entries.join(taken, (entries["volume_id"] == F.col("a_vol")) & (entries["entry_id"] == F.col("a_entry")), "left")
    return out.withColumn("record_no", F.coalesce("a_rec", "record_no")).drop("a_vol", "a_entry", "a_rec")


def apply_batch(entries: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries after a batch of journal records taken in their order, and the deletions it brought.

    Every event of a file sees whether the file is in the tree just before it: known at the start or placed
    since, and not deleted or moved out. An event that deletes a file or moves it out of the tree logs it, with
    the name, folder and size that it had then; one that creates a file, renames it within the tree or touches
    one that isn't known places it. A folder counts as indexed if it is known or an earlier event of the batch
    places it. Files without a record number are adopted by name first. What hangs from a folder that has gone
    stays for ``advance`` or ``tree.delete_subtrees`` to remove. ``entries`` needs full_path for the folders of the log.
    """
    entries = adopt(entries, journal)
    bit = lambda b: F.col("reason").bitwiseAND(F.lit(b)) != 0
    attr = lambda b: F.col("attributes").bitwiseAND(F.lit(b)) != 0
    live = entries.filter(~F.col("deleted"))
    folders = live.filter("is_dir and record_no is not null").select(F.col("volume_id").alias("p_vol"), F.col("record_no").alias("p_rec"), F.col("full_path").alias("p_path"), F.col("entry_id").alias("p_entry"))
    # Folders that the batch itself places: where and under which name, from their first such event.
    made = journal.filter(attr(S.ATTR_DIRECTORY) & (bit(S.FILE_CREATE) | bit(S.RENAME_NEW_NAME)) & ~bit(S.FILE_DELETE)).groupBy(F.col("volume_id").alias("m_vol"), F.col("record_no").alias("m_rec")).agg(F.min("usn").alias("m_usn"), F.min_by("name", "usn").alias("m_name"), F.min_by("parent_record_no", "usn").alias("m_up"))
    up = folders.select(F.col("p_vol").alias("u_vol"), F.col("p_rec").alias("u_rec"), F.col("p_path").alias("u_path"))
    made = made.join(up, (F.col("m_vol") == F.col("u_vol")) & (F.col("m_up") == F.col("u_rec")), "left").select("m_vol", "m_rec", "m_usn", F.concat_ws("\\", "u_path", "m_name").alias("m_path"))
    each = journal.join(folders, (F.col("volume_id") == F.col("p_vol")) & (F.col("parent_record_no") == F.col("p_rec")), "left").join(
        made, (F.col("volume_id") == F.col("m_vol")) & (F.col("parent_record_no") == F.col("m_rec")) & (F.col("m_usn") < F.col("usn")), "left"
    )
    start = live.select(
        F.col("volume_id").alias("e_vol"), F.col("record_no").alias("e_rec"), F.col("name").alias("e_name"), F.regexp_replace("full_path", r"\\[^\\]*$", "").alias("e_path"),
        F.when(F.col("metadata_known"), F.col("size")).alias("e_size"), F.col("is_dir").alias("e_dir"), F.col("modified").alias("e_modified"),
    )
    each = each.join(start, (F.col("volume_id") == F.col("e_vol")) & (F.col("record_no") == F.col("e_rec")), "left")
    root, known = F.col("parent_record_no") == ROOT_RECORD, F.col("e_rec").isNotNull()
    indexed = root | F.col("p_rec").isNotNull() | F.col("m_rec").isNotNull()
    path = F.coalesce("p_path", "m_path", F.lit(""))
    moves = bit(S.FILE_CREATE) | bit(S.RENAME_NEW_NAME)
    open_ = indexed & ~(root & F.lower("name").isin(*SKIPPED_ROOT_NAMES))
    leaving = F.when(bit(S.RENAME_NEW_NAME), leaving_kind(F.col("name"), F.col("record_no"), path, indexed))
    gone = bit(S.FILE_DELETE)
    each = each.withColumns({"_indexed": indexed, "_path": path, "_leaving": leaving, "_gone": gone, "_moves": moves, "_open": open_})
    # What an event makes of "is in the tree": a fixed answer, or the opposite (a rename out of it, which places only what wasn't in it), or nothing.
    swap = ~gone & F.col("_moves") & F.col("_open") & F.col("_leaving").isNotNull()
    fixed = F.when(gone, False).when(swap, None).when(F.col("_moves"), F.col("_open")).when(F.col("_open"), True)
    by = Window.partitionBy("volume_id", "record_no").orderBy("usn")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"_fixed": fixed, "_swaps": F.sum(swap.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_swaps")), ignorenulls=True).over(before)
    each = each.withColumn("_last", last)
    swapped = (F.coalesce(F.lag("_swaps").over(by), F.lit(0)) - F.coalesce(F.col("_last._swaps"), F.lit(0))) % 2 == 1
    was = F.coalesce(F.col("_last._fixed"), known)
    each = each.withColumn("_in", F.when(swapped, ~was).otherwise(was))
    after = F.coalesce("_fixed", F.when(F.col("_moves") & F.col("_open") & F.col("_leaving").isNotNull(), ~F.col("_in")).otherwise(F.col("_in")))
    each = each.withColumn("_after", after)
    places = F.col("_after") & (F.col("_moves") | ~F.col("_in"))
    each = each.withColumn("_place", F.when(places, F.struct(F.col("name"), F.col("_path").alias("path"), "parent_record_no", "usn", (~F.col("_in")).alias("new"))))
    held = F.last("_place", ignorenulls=True).over(before)
    lives = F.coalesce(F.sum((F.col("_after") & ~F.col("_in")).cast("int")).over(before), F.lit(0))  # times it came in during the batch
    each = each.withColumns({"_held": held, "_lives": lives})
    out = ~F.col("_after") & (F.col("_in") | (F.col("_gone") & F.col("_indexed") & ~is_delete_marker(F.col("name"), F.col("record_no"))))
    first_life = known & (F.col("_lives") == 0)
    deletions = each.filter(out).select(
        "volume_id", "record_no", "sequence", "parent_record_no",
        F.when(F.col("_in"), F.coalesce("_held.name", "e_name")).otherwise(F.col("name")).alias("name"), F.when(F.col("_in"), F.coalesce("_held.path", "e_path")).otherwise(F.col("_path")).alias("parent_path"),
        F.coalesce(F.when(F.col("_in") & first_life, F.col("e_size")), F.lit(-1)).cast("long").alias("size"), F.when(F.col("_in") & first_life, F.col("e_dir")).otherwise(attr(S.ATTR_DIRECTORY)).alias("is_dir"),
        F.when(F.col("_in") & first_life, F.col("e_modified")).alias("modified"), F.col("ts").alias("deleted_at"), F.when(F.col("_gone"), "Deleted").otherwise(F.coalesce("_leaving", F.lit("Deleted"))).alias("kind"), "usn",
    )
    ended = each.groupBy(F.col("volume_id").alias("j_vol"), F.col("record_no").alias("j_rec")).agg(
        F.max_by("_after", "usn").alias("j_in"), F.max_by("_place", F.when(F.col("_place").isNotNull(), F.col("usn"))).alias("j_place"), F.max_by("attributes", "usn").alias("attributes"),
        F.max((F.col("_after") & ~F.col("_in")).cast("int")).alias("j_new"),
    )
    spots = folders.select(F.col("p_vol").alias("s_vol"), F.col("p_rec").alias("s_rec"), "p_entry")
    ended = ended.join(spots, (F.col("j_vol") == F.col("s_vol")) & (F.col("j_place.parent_record_no") == F.col("s_rec")), "left")
    full = live.join(ended, (live["volume_id"] == F.col("j_vol")) & (live["record_no"] == F.col("j_rec")), "full_outer")
    told, placed = F.col("j_rec").isNotNull(), F.col("j_place").isNotNull()
    parent = F.when(F.col("j_place.parent_record_no") == ROOT_RECORD, F.lit(0)).otherwise(F.coalesce("p_entry", "j_place.parent_record_no"))
    pick = lambda new, old: F.when(told, new).otherwise(F.col(old)).alias(old)
    stays = full.filter(~told | F.col("j_in"))
    now = stays.select(
        F.coalesce("volume_id", "j_vol").alias("volume_id"), F.coalesce("entry_id", "j_rec").alias("entry_id"), F.when(placed, parent).otherwise(F.col("parent_id")).cast("long").alias("parent_id"),
        F.when(placed, F.col("j_place.name")).otherwise(F.col("name")).alias("name"), pick(attr(S.ATTR_DIRECTORY), "is_dir"), pick(attr(S.ATTR_HIDDEN), "hidden"), pick(attr(S.ATTR_SYSTEM), "system"),
        pick(attr(S.ATTR_REPARSE), "reparse"), F.lit(False).alias("deleted"), (F.coalesce("metadata_known", F.lit(False)) & ~told).alias("metadata_known"),
        F.when(F.coalesce("j_new", F.lit(0)) == 1, 0).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("size"), F.when(F.coalesce("j_new", F.lit(0)) == 0, F.col("modified")).alias("modified"),
        F.coalesce("record_no", "j_rec").alias("record_no"),
    )
    return now, deletions


def advance(entries: DataFrame, journal: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``apply_batch``, then full paths again, without what hangs from folders that have gone or from a loop of moves.

    ``roots`` has (root_id, root), as for ``tree.resolve``.
    """
    after, deletions = apply_batch(entries, journal)
    after = cut(after)
    place = resolve(after, roots).select("id", F.col("full_path").alias("_path"), "gone")
    kept = after.drop("full_path").join(place, after["entry_id"] == place["id"]).filter("not gone")
    return kept.withColumn("full_path", F.col("_path")).drop("id", "gone", "_path"), deletions


def keep_newest(deletions: DataFrame, most: int = RING) -> DataFrame:
    """The log without repeats of (record, sequence, usn), the newest ``most`` of each volume.

    A volume's log is first cut to the newest ``most`` of each of 64 lots, so that the last window sorts 64 times ``most`` rows at most.
    """
    once = deletions.dropDuplicates(["volume_id", "record_no", "sequence", "usn"])
    spread = once.withColumn("_lot", F.pmod(F.xxhash64("usn", "record_no"), F.lit(64)))
    lot = Window.partitionBy("volume_id", "_lot").orderBy(F.desc("usn"), "record_no", "sequence")
    few = spread.withColumn("_k", F.row_number().over(lot)).filter(F.col("_k") <= most).drop("_k", "_lot")
    whole = Window.partitionBy("volume_id").orderBy(F.desc("usn"), "record_no", "sequence")  # 64 * most rows at most
    return few.withColumn("_k", F.row_number().over(whole)).filter(F.col("_k") <= most).drop("_k")


def retag(deletions: DataFrame, tags: DataFrame) -> DataFrame:
    """Gives the newest deletion of each (volume, record, sequence) of ``tags`` that row's kind."""
    newest = deletions.groupBy("volume_id", "record_no", "sequence").agg(F.max("usn").alias("usn"))
    marks = newest.join(tags.select("volume_id", "record_no", "sequence", F.col("kind").alias("_kind")), ["volume_id", "record_no", "sequence"])
    return deletions.join(marks, ["volume_id", "record_no", "sequence", "usn"], "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind")


def journal_span(journal: DataFrame) -> DataFrame:
    return journal.groupBy("volume_id").agg(F.min("usn").alias("first_usn"), F.max("usn").alias("last_usn"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def has_gap(journal: DataFrame, checkpoint_usn: int) -> bool:
    """Whether records after ``checkpoint_usn`` are gone from the whole ``journal``, so that a full scan is due. A part of it, such as only what is new, can't tell; ``resume_points`` asks the journals' own state."""
    first = journal.agg(F.min("usn")).first()[0]
    return first is not None and first > checkpoint_usn


def resume_points(volumes: DataFrame, journals: DataFrame) -> DataFrame:
    """(volume_id, resume, start_usn, reason): whether each of ``volumes`` can go on from its saved position, and from where.

    ``volumes`` are saved ones (``schemas.VOLUMES``), ``journals`` (volume_id, journal_id, first_usn, next_usn) those there are now.
    A volume goes on from its next_usn if it was indexed by its journal, the journal is the same, and the record is still there;
    any other is scanned again, and goes on from where its journal stands now (null without one). ``reason`` says why.
    """
    now = journals.select(F.col("volume_id").alias("j_vol"), F.col("journal_id").alias("j_id"), "first_usn", F.col("next_usn").alias("j_next"))
    met = volumes.join(now, F.col("volume_id") == F.col("j_vol"), "left")
    reason = (
        F.when(F.col("j_vol").isNull(), "no journal").when(F.coalesce(F.col("mode") != "Turbo", F.lit(True)), "not indexed by journal")
        .when(~F.col("journal_id").eqNullSafe(F.col("j_id")), "another journal").when(F.coalesce(F.col("next_usn") < F.col("first_usn"), F.lit(True)), "records are gone")
    )
    return met.withColumn("reason", reason).select("volume_id", F.col("reason").isNull().alias("resume"), F.when(F.col("reason").isNull(), F.col("next_usn")).otherwise(F.col("j_next")).alias("start_usn"), "reason")


def refresh_due(journal: DataFrame) -> DataFrame:
    """Files whose size, times or attributes changed."""
    return journal.filter(has(S.DATA_OVERWRITE | S.DATA_EXTEND | S.DATA_TRUNCATION | S.BASIC_INFO_CHANGE)).select("volume_id", "record_no").distinct()


def daily_deletions(deletions: DataFrame) -> DataFrame:
    """Deletions by day and kind (beyond what the log itself offers)."""
    return deletions.groupBy(F.to_date("deleted_at").alias("day"), "kind").agg(F.count("*").alias("deletions"), F.sum(F.greatest("size", F.lit(0))).alias("bytes"))


def save_log(deletions: DataFrame, path: str, most: int = RING) -> None:
    """Merges ``deletions`` into the log at ``path``: written beside it, then put in its place."""
    spark = deletions.sparkSession
    old = load_log(spark, path)
    merged = deletions.select(*[f.name for f in S.DELETIONS.fields])
    replace_parquet(keep_newest(merged if old is None else old.unionByName(merged), most), path)


def load_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log saved at ``path``; None if there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(S.DELETIONS).parquet(path)
    except AnalysisException:
        return None
