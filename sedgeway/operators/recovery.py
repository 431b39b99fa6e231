"""Undelete: deleted records with their folders, the deletion log's details and a grade.

Also the bitmap's free runs, Recycle Bin pairs, versions in snapshots and lists of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.operators.bitmap import allocated_in, free_runs_of, from_runs, overlaps
from sedgeway.runtime import cut

FIRST_USER_RECORD = 16
ROOT_RECORD = 5
#: Record flags. Fixed values.
FLAG_COMPRESSED, FLAG_ENCRYPTED = 0x0001, 0x4000
#: Exponents of a compression unit's clusters that are used: 0 stands for 4. Fixed values.
COMPRESSION_UNITS = (0, 4)
#: Grades from best to worst in a list, and by loss in a copy. Fixed values.
LIST_RANK = ("Excellent", "Good", "Partial", "Zeroed", "Overwritten", "Encrypted", "Unknown")
COPY_RANK = ("Excellent", "Good", "Unknown", "Partial", "Zeroed", "Overwritten", "Encrypted")


def rank_of(grade: Column, order: tuple[str, ...] = LIST_RANK) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in order]), grade)


def merge_extensions(records: DataFrame) -> DataFrame:
    """Base records with the name, size and runs that their extension records hold, where they lack them."""
    base = records.filter(F.coalesce("base_record", F.lit(0)) == 0)
    ext = records.filter("base_record > 0").groupBy("volume_id", F.col("base_record").alias("record_no")).agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("record_no"))).alias("x_name"), F.min_by("real_size", F.when(F.col("real_size").isNotNull(), F.col("record_no"))).alias("x_size"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "runs"))), lambda r: F.coalesce(r["runs"], F.array().cast("array<struct<vcn:bigint,lcn:bigint,clusters:bigint>>")))).alias("x_runs"),
    )
    none = F.array().cast("array<struct<vcn:bigint,lcn:bigint,clusters:bigint>>")
    return base.join(ext, ["volume_id", "record_no"], "left").withColumns(
        {
            "name": F.coalesce("name", "x_name"),
            "real_size": F.coalesce("real_size", "x_size"),
            "runs": F.array_sort(F.concat(F.coalesce("runs", none), F.coalesce("x_runs", none))),
        }
    ).drop("x_name", "x_size", "x_runs")


def deleted_records(records: DataFrame) -> DataFrame:
    """Base records out of use with a name, but for the system's own."""
    system = F.col("name").startswith("$") & (F.col("parent_record") == ROOT_RECORD)
    return records.filter(~F.col("in_use") & (F.coalesce("base_record", F.lit(0)) == 0) & F.col("name").isNotNull() & (F.col("record_no") >= FIRST_USER_RECORD) & ~system)


def good_runs(runs: Column, total_clusters: int | None = None) -> Column:
    """Whether runs can be followed: positive lengths and, if the volume's size is given, all inside it and no more clusters than it has."""
    none = F.array().cast("array<struct<vcn:bigint,lcn:bigint,clusters:bigint>>")
    runs = F.coalesce(runs, none)
    ok = F.forall(runs, lambda r: (r["clusters"] > 0) & (r["lcn"] >= -1) & (r["vcn"] >= 0))
    if total_clusters is None:
        return ok
    inside = F.forall(runs, lambda r: (r["clusters"] <= total_clusters) & (r["lcn"] <= F.lit(total_clusters) - r["clusters"]))
    held = F.aggregate(runs, F.lit(0).cast("decimal(38,0)"), lambda acc, r: (acc + r["clusters"]).cast("decimal(38,0)"))
    return ok & inside & (held <= total_clusters)


def grade(records: DataFrame, alloc: DataFrame, clusters: DataFrame | None = None, cluster_size: int = 4096, total_clusters: int | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """``records`` with needed, stored, allocated, ``grade`` and ``percent_intact``; the first rule that fits decides.

    ``alloc`` has runs in use (volume_id, start_lcn, len), or is a bitmap in blocks (``operators.bitmap``).
    ``evidence`` (``carve.first_clusters``) gives (volume_id, record_no, zero, header_ok) of records' first clusters, or
    ``clusters`` (volume_id, lcn, zero, header_ok) by cluster. Runs that leave a volume of ``total_clusters`` can't be graded.
    """
    runs = F.coalesce("runs", F.array().cast("array<struct<vcn:bigint,lcn:bigint,clusters:bigint>>"))
    bad = ~good_runs(F.col("runs"), total_clusters)
    runs = F.when(bad, F.array().cast("array<struct<vcn:bigint,lcn:bigint,clusters:bigint>>")).otherwise(runs)
    capacity = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["clusters"])
    compressed = F.col("data_flags").bitwiseAND(F.lit(FLAG_COMPRESSED)) != 0
    wanted = F.when(F.col("initialized_size") > 0, F.col("initialized_size")).otherwise(F.col("real_size"))
    need = F.when(compressed, capacity).otherwise(F.ceil(F.least(wanted, capacity * cluster_size) / cluster_size))
    parts = F.filter(
        F.transform(runs, lambda r: F.struct(r["lcn"].alias("lcn"), F.greatest(F.lit(0), F.least(r["clusters"], F.col("_need") - r["vcn"])).cast("long").alias("clusters"))), lambda r: (r["lcn"] >= 0) & (r["clusters"] > 0)
    )
    keyed = records.withColumns({"_need": need.cast("long"), "_bad": bad, "_cap": capacity, "_runs": F.size(runs)})
    keyed = keyed.withColumn("_parts", parts)
    keyed = keyed.withColumns({"_stored": F.aggregate("_parts", F.lit(0).cast("long"), lambda a, r: a + r["clusters"]), "_first": F.get("_parts", 0)["lcn"]})
    each = keyed.filter("not _bad").select(F.struct("volume_id", "record_no").alias("id"), "volume_id", F.explode("_parts").alias("r")).select("id", "volume_id", "r.lcn", "r.clusters")
    taken = allocated_in(each, alloc) if "words" in alloc.columns else overlaps(each, alloc)
    taken = taken.select(F.col("id.volume_id").alias("t_vol"), F.col("id.record_no").alias("t_rec"), "allocated")
    joined = keyed.join(taken, (F.col("volume_id") == F.col("t_vol")) & (F.col("record_no") == F.col("t_rec")), "left").withColumn("allocated", F.coalesce("allocated", F.lit(0)))
    if evidence is not None:
        seen = evidence.select(F.col("volume_id").alias("c_vol"), F.col("record_no").alias("c_rec"), "zero", "header_ok")
        joined = joined.join(seen, (F.col("volume_id") == F.col("c_vol")) & (F.col("record_no") == F.col("c_rec")), "left").drop("c_vol", "c_rec")
    elif clusters is not None:
        first = clusters.select(F.col("volume_id").alias("c_vol"), F.col("lcn").alias("c_lcn"), "zero", "header_ok")
        joined = joined.join(first, (F.col("volume_id") == F.col("c_vol")) & (F.col("_first") == F.col("c_lcn")), "left").drop("c_vol", "c_lcn")
    else:
        joined = joined.withColumns({"zero": F.lit(False), "header_ok": F.lit(None).cast("boolean")})
    encrypted = F.col("data_flags").bitwiseAND(F.lit(FLAG_ENCRYPTED)) != 0
    left = F.floor((F.col("_stored") - F.col("allocated")) * 100 / F.greatest(F.col("_stored"), F.lit(1))).cast("int")
    rules = [
        (encrypted, "Encrypted", F.lit(0)), (F.col("is_dir"), "Excellent", F.lit(100)), (F.col("resident"), "Excellent", F.lit(100)), (F.col("_bad"), "Unknown", F.lit(0)),
        ((F.col("_runs") == 0) & (F.col("real_size") == 0), "Excellent", F.lit(100)), (F.col("_runs") == 0, "Unknown", F.lit(0)),
        (compressed & ~F.col("compression_unit").isin(*COMPRESSION_UNITS), "Unknown", F.lit(0)), (F.col("_stored") == 0, "Excellent", F.lit(100)),
        (F.col("allocated") >= F.col("_stored"), "Overwritten", F.lit(0)), (F.col("allocated") > 0, "Partial", left), (F.coalesce("zero", F.lit(False)), "Zeroed", F.lit(0)),
        (~compressed & (F.coalesce("header_ok", F.lit(True)) == F.lit(False)), "Good", F.lit(100)),
    ]
    g, p = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for test, name, percent in rules:
        g, p = g.when(test, name), p.when(test, percent)
    out = joined.withColumns({"grade": g.otherwise("Excellent"), "percent_intact": p.otherwise(100).cast("int"), "stored_clusters": F.col("_stored"), "needed_clusters": F.col("_need")})
    limit = F.when(F.col("resident"), F.coalesce(F.octet_length("resident_data"), F.lit(0))).otherwise(F.col("_cap") * cluster_size)
    return out.withColumn("size", F.when(F.col("is_dir"), 0).otherwise(F.least("real_size", limit)).cast("long")).drop(
        "_need", "_bad", "_cap", "_runs", "_parts", "_stored", "_first", "t_vol", "t_rec", "zero", "header_ok"
    )


def with_folders(deleted: DataFrame, live_folders: DataFrame, all_records: DataFrame, rounds: int = 6) -> DataFrame:
    """``deleted`` with ``original_folder``.

    A parent is the live folder of that record number, or else a deleted folder whose sequence is the
    parent's or one more; of such chains 2^rounds steps are followed by pointer doubling. Unresolved: null.
    ``all_records`` has one row for each slot of a volume, as one file table does.
    """
    live = live_folders.select(F.col("volume_id").alias("l_vol"), F.col("record_no").alias("l_rec"), F.col("full_path").alias("l_path"))
    dead = all_records.filter("is_dir and not in_use").select("volume_id", "record_no", "sequence", "parent_record", "parent_sequence", "name")
    # Pointers of deleted folders: either a finished path, or the next folder up and the names passed.
    p = dead.join(live, (F.col("volume_id") == F.col("l_vol")) & (F.col("parent_record") == F.col("l_rec")), "left").select(
        "volume_id", "record_no", "sequence", F.concat_ws("\\", "l_path", "name").alias("below"), F.col("l_path").isNotNull().alias("done"), F.col("parent_record").alias("up"), F.col("parent_sequence").alias("up_seq")
    )
    for _ in range(rounds):
        q = p.select(*[F.col(c).alias(f"q_{c}") for c in p.columns])
        near = (F.col("q_sequence") - F.col("up_seq")).isin(0, 1)
        p = p.join(q, (~F.col("done")) & (F.col("volume_id") == F.col("q_volume_id")) & (F.col("up") == F.col("q_record_no")) & near, "left").select(
            "volume_id", "record_no", "sequence", F.when(F.col("done") | F.col("q_below").isNull(), F.col("below")).otherwise(F.concat_ws("\\", "q_below", "below")).alias("below"),
            (F.col("done") | F.coalesce("q_done", F.lit(False))).alias("done"), F.coalesce("q_up", "up").alias("up"), F.coalesce("q_up_seq", "up_seq").alias("up_seq"),
        )
    paths = p.filter("done").groupBy("volume_id", "record_no", "sequence").agg(F.min("below").alias("d_path")).select(F.col("volume_id").alias("d_vol"), F.col("record_no").alias("d_rec"), F.col("sequence").alias("d_seq"), "d_path")
    out = deleted.join(live, (F.col("volume_id") == F.col("l_vol")) & (F.col("parent_record") == F.col("l_rec")), "left")
    out = out.join(paths, (F.col("volume_id") == F.col("d_vol")) & (F.col("parent_record") == F.col("d_rec")) & (F.col("d_seq") - F.col("parent_sequence")).isin(0, 1), "left")
    return out.withColumn("original_folder", F.coalesce("l_path", "d_path")).drop("l_vol", "l_rec", "l_path", "d_vol", "d_rec", "d_seq", "d_path")


def with_log(deleted: DataFrame, deletions: DataFrame) -> DataFrame:
    """``deleted`` with the newest log row of its record and sequence that isn't of a recycled file: folder, time, detail."""
    log = deletions.filter("kind <> 'Recycled'").groupBy("volume_id", "record_no", "sequence").agg(F.max_by(F.struct("parent_path", "deleted_at", "kind"), "usn").alias("log"))
    joined = deleted.join(log, ["volume_id", "record_no", "sequence"], "left")
    folder = F.coalesce(F.col("original_folder"), F.col("log.parent_path")) if "original_folder" in deleted.columns else F.col("log.parent_path")
    return joined.withColumns({"original_folder": folder, "deleted_at": F.col("log.deleted_at"), "detail": F.col("log.kind")}).drop("log")


def free_runs(bits: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(volume_id, start_lcn, len) of maximal free runs from (volume_id, lcn, allocated) rows.

    Islands are found within blocks of clusters, so a volume is spread over tasks; the few that touch a border are then joined.
    """
    free = bits.filter(~F.col("allocated")).withColumn("_b", F.floor(F.col("lcn") / block))
    within = Window.partitionBy("volume_id", "_b").orderBy("lcn")
    parts = free.withColumn("_i", F.col("lcn") - F.row_number().over(within)).groupBy("volume_id", "_b", "_i").agg(F.min("lcn").alias("s"), (F.max("lcn") + 1).alias("e"))
    edge = (F.col("s") % block == 0) | (F.col("e") % block == 0)
    # What reaches a border, or fills its block: at most two rows for each block.
    order = Window.partitionBy("volume_id").orderBy("s")
    border = parts.filter(edge).withColumn("_new", (F.coalesce(F.lag("e").over(order), F.lit(-1)) != F.col("s")).cast("int"))
    joined = border.withColumn("_g", F.sum("_new").over(order)).groupBy("volume_id", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return parts.filter(~edge).select("volume_id", "s", "e").unionByName(joined.select("volume_id", "s", "e")).select("volume_id", F.col("s").alias("start_lcn"), (F.col("e") - F.col("s")).alias("len"))


def free_runs_from_alloc(alloc: DataFrame, total_clusters: int) -> DataFrame:
    """The gaps between runs (volume_id, start_lcn, len), up to ``total_clusters``, by way of the bitmap in blocks."""
    totals = alloc.select("volume_id").distinct().withColumn("total", F.lit(total_clusters).cast("long"))
    return free_runs_of(from_runs(alloc, totals))


def bitmap_bits(bitmap: DataFrame) -> DataFrame:
    """(volume_id, lcn, allocated) from (volume_id, first_byte, bytes) pieces of a bitmap, the lowest bit first."""
    hexes = bitmap.select("volume_id", "first_byte", F.posexplode(F.regexp_extract_all(F.hex("bytes"), F.lit("(..)"), 1)).alias("i", "h"))
    byte = hexes.select("volume_id", (F.col("first_byte") + F.col("i")).alias("at"), F.conv("h", 16, 10).cast("int").alias("v"))
    return byte.select("volume_id", "at", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "volume_id", (F.col("at") * 8 + F.col("k")).alias("lcn"), (F.call_function("shiftright", F.col("v"), F.col("k")).bitwiseAND(F.lit(1)) == 1).alias("allocated")
    )


def slots_as_of(log: DataFrame, in_use: DataFrame) -> DataFrame:
    """``log`` with ``slot`` from the records in use alone (volume_id, record_no), as a lookup of the nearest one at or below answers it.

    That record itself: Reused; a lower one: Free; none: Unknown. The nearest is the last value before each row of the
    two tables in one order, within blocks of records; a block's first rows take the greatest of the blocks before.
    """
    block = 1 << 16
    marks = in_use.select("volume_id", F.col("record_no").alias("_r")).withColumn("_b", F.floor(F.col("_r") / block))
    top = marks.groupBy("volume_id", "_b").agg(F.max("_r").alias("_top"))
    asked = log.select("volume_id", "record_no").distinct().withColumn("_b", F.floor(F.col("record_no") / block))
    rows = asked.select("volume_id", "_b", F.col("record_no").alias("at"), F.lit(None).cast("long").alias("_r")).unionByName(marks.select("volume_id", "_b", F.col("_r").alias("at"), "_r"))
    within = Window.partitionBy("volume_id", "_b").orderBy("at", F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.max("_r").over(within)).filter("_r is null").select("volume_id", "_b", F.col("at").alias("record_no"), "_near")
    every = top.select("volume_id", "_b", "_top").unionByName(asked.select("volume_id", "_b").distinct().withColumn("_top", F.lit(None).cast("long")))
    before = Window.partitionBy("volume_id").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)  # a row or two for each block
    earlier = every.withColumn("_earlier", F.max("_top").over(before)).groupBy("volume_id", "_b").agg(F.max("_earlier").alias("_earlier"))
    nearest = near.join(earlier, ["volume_id", "_b"], "left").select("volume_id", "record_no", F.coalesce("_near", "_earlier").alias("_near"))
    slot = F.when(F.col("_near") == F.col("record_no"), "Reused").when(F.col("_near") < F.col("record_no"), "Free").otherwise("Unknown")
    return log.join(nearest, ["volume_id", "record_no"], "left").withColumn("slot", slot).drop("_near")


def slot_states(log: DataFrame, records: DataFrame) -> DataFrame:
    """``log`` with ``slot``: Free, Reused or Unknown by whether the record is in use now."""
    now = records.select("volume_id", "record_no", F.col("in_use").alias("_used"))
    return log.join(now, ["volume_id", "record_no"], "left").withColumn("slot", F.when(F.col("_used").isNull(), "Unknown").when(F.col("_used"), "Reused").otherwise("Free")).drop("_used")


def recycle_pairs(infos: DataFrame, data: DataFrame) -> DataFrame:
    """Recycle Bin items: ``$I`` rows (sid, name, original_path, size, deleted_at) and ``$R`` rows (sid, name, is_dir) of one id.

    A pair is Excellent; an item that lacks a half is Unknown.
    """
    key = lambda c: F.lower(F.substring(c, 3, 1000))
    i = infos.select("sid", key("name").alias("id"), F.col("name").alias("info_name"), "original_path", "size", "deleted_at")
    r = data.select("sid", key("name").alias("id"), F.col("name").alias("data_name"), "is_dir")
    both = F.col("info_name").isNotNull() & F.col("data_name").isNotNull()
    return i.join(r, ["sid", "id"], "full_outer").withColumns({"grade": F.when(both, "Excellent").otherwise("Unknown"), "percent_intact": F.when(both, 100).otherwise(0)})


def scan_bin(entries: DataFrame, metas: DataFrame, own_sid: str | None = None) -> DataFrame:
    """Recycle Bin items of the volumes that ``entries`` (full_path, is_dir, size) list, with what their ``$I`` files say.

    Only what lies directly in ``<drive>\\$Recycle.Bin\\<SID>``, for users' SIDs, in either case; with ``own_sid`` that user's alone. ``metas``
    (full_path, original_path, size, deleted_at) are the ``$I`` files that could be read. An item is a pair by drive, SID and id,
    or a half of one: without data, or without a name that is known. Columns: drive, sid, id, name, folder, size, deleted_at, is_dir, grade, percent_intact, detail.
    """
    parts = F.split("full_path", r"\\")
    placed = entries.select("full_path", "is_dir", "size", parts.alias("p")).filter((F.size("p") == 4) & (F.lower(F.col("p")[1]) == "$recycle.bin") & F.startswith(F.lower(F.col("p")[2]), F.lit("s-1-")) & (F.length(F.col("p")[3]) >= 3))
    named = placed.select("full_path", "is_dir", "size", F.upper(F.col("p")[0]).alias("drive"), F.upper(F.col("p")[2]).alias("sid"), F.col("p")[3].alias("file"), F.lower(F.substring(F.col("p")[3], 1, 2)).alias("half"), F.lower(F.expr("substring(p[3], 3)")).alias("id"))
    if own_sid is not None:
        named = named.filter(F.col("sid") == own_sid.upper())
    told = metas.select(F.lower("full_path").alias("m_path"), "original_path", F.col("size").alias("m_size"), "deleted_at")
    key = ["drive", "sid", "id"]
    i = named.filter("half = '$i' and not is_dir").join(told, F.lower("full_path") == F.col("m_path"), "left").select(*key, F.col("file").alias("i_file"), F.regexp_replace("original_path", r"\\+$", "").alias("was"), "m_size", "deleted_at")
    r = named.filter("half = '$r'").select(*key, F.col("file").alias("r_file"), "is_dir", F.col("size").alias("r_size"))
    whole = F.col("was").isNotNull() & F.col("r_file").isNotNull()
    is_dir = F.coalesce("is_dir", F.lit(False))
    return i.join(r, key, "full_outer").select(
        *key, F.coalesce(F.substring_index("was", "\\", -1), "r_file", "i_file").alias("name"), F.when(F.contains("was", F.lit("\\")), F.regexp_replace("was", r"\\[^\\]*$", "")).alias("folder"),
        F.coalesce("m_size", F.when(~is_dir, F.col("r_size")), F.lit(0)).cast("long").alias("size"), "deleted_at", is_dir.alias("is_dir"), F.when(whole, "Excellent").otherwise("Unknown").alias("grade"), F.when(whole, 100).otherwise(0).alias("percent_intact"),
        F.when(F.col("r_file").isNull(), "its data is gone").when(F.col("was").isNull(), "its name and folder are unknown").alias("detail"),
    )


def unique_names(plan: DataFrame, folder: str = "folder", name: str = "name", taken: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """``plan`` with ``target``: the second and later rows of a name in a folder get `` (restored)``, `` (restored) 2``, ...

    A target equals no other target and no name in ``taken`` (folder, name), in either case: rows whose target is
    taken go on to the next number in rounds, so that nothing is overwritten.
    """
    stem, ext = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]*)$", 1)
    mark = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, " (restored)").otherwise(F.concat(F.lit(" (restored) "), (F.col("_k") - 1).cast("string")))
    w = Window.partitionBy(folder, F.lower(name)).orderBy(name)
    rows = cut(plan.withColumn("_k", F.row_number().over(w)).withColumn("_row", F.monotonically_increasing_id()))
    used = None if taken is None else taken.select(F.col("folder").alias("_f"), F.lower("name").alias("_n"))
    for _ in range(rounds):
        rows = rows.withColumn("target", F.concat(stem, mark, ext))
        first = Window.partitionBy(folder, F.lower("target")).orderBy("_k", "_row")
        clash = F.row_number().over(first) > 1
        if used is not None:
            rows = rows.join(used.distinct(), (F.col(folder) == F.col("_f")) & (F.lower("target") == F.col("_n")), "left")
            clash = clash | F.col("_n").isNotNull()
        group = Window.partitionBy(folder, F.lower(name))
        rank = F.sum(F.col("_clash").cast("int")).over(group.orderBy("_k", "_row"))
        rows = cut(rows.withColumn("_clash", clash).withColumn("_k", F.when(F.col("_clash"), F.max("_k").over(group) + rank).otherwise(F.col("_k")).cast("int")).drop("_f", "_n"))
        if not rows.filter("_clash").limit(1).count():
            return rows.drop("_k", "_row", "_clash")
    raise RuntimeError(f"no free names in {rounds} rounds")


def versions_of(entries: DataFrame, snapshots: DataFrame, path: str) -> DataFrame:
    """The versions of one path in all snapshots, newest first."""
    one = entries.filter(F.col("fold_path") == path.rstrip("\\").lower())
    return one.join(snapshots, "snapshot_id").orderBy(F.desc("created"), "snapshot_id")


def list_folder(entries: DataFrame, snapshot_id, folder: str) -> DataFrame:
    """What a snapshot's folder holds: folders first, then by name in either case."""
    parent = F.regexp_replace("fold_path", r"\\[^\\]*$", "")
    return entries.filter((F.col("snapshot_id") == snapshot_id) & (parent == folder.rstrip("\\").lower())).orderBy(F.desc("is_dir"), "fold")


def intact_estimate(candidates: DataFrame) -> DataFrame:
    """The share of bytes likely intact, each file weighing its size, at least one."""
    w = F.greatest(F.lit(1), F.coalesce("size", F.lit(1))).cast("double")
    return candidates.agg(F.bround(F.sum(w * F.col("percent_intact")) / F.sum(w)).cast("int").alias("percent"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def worst_grade(candidates: DataFrame) -> DataFrame:
    """For each folder the worst grade and how many of its files failed."""
    return candidates.groupBy("original_folder").agg(F.max_by("grade", rank_of(F.col("grade"), COPY_RANK)).alias("worst"), F.count_if(F.col("grade").isin("Overwritten", "Encrypted", "Zeroed")).alias("failed"), F.count("*").alias("total"))


def candidate_order(sort: str = "grade") -> list[Column]:
    if sort == "newest":
        return [F.desc_nulls_last(F.coalesce("deleted_at", "modified")), F.asc("name")]
    if sort == "size":
        return [F.desc("size"), F.asc("name")]
    if sort == "name":
        return [F.asc(F.lower("name")), F.asc("name")]
    return [rank_of(F.col("grade")).asc(), F.desc("percent_intact"), F.asc("name")]


def not_in_undelete(carved: DataFrame, records: DataFrame) -> DataFrame:
    """Carved files that don't start where a deleted record's data starts."""
    first = records.filter("not resident").select("volume_id", F.get(F.filter("runs", lambda r: r["lcn"] >= 0), 0)["lcn"].alias("start_lcn")).filter("start_lcn is not null").distinct()
    return carved.join(first, ["volume_id", "start_lcn"], "left_anti")


def free_bytes(runs: DataFrame, cluster_size: int = 4096) -> DataFrame:
    """Free bytes of each volume from its free runs."""
    return runs.groupBy("volume_id").agg((F.coalesce(F.sum("len"), F.lit(0)) * cluster_size).alias("free_bytes"))


def selection_sum(candidates: DataFrame) -> DataFrame:
    """Number and bytes of selected candidates; unknown sizes count as none."""
    return candidates.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce("size", F.lit(0)))), F.lit(0)).cast("long").alias("bytes"))
