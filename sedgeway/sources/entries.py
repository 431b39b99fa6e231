"""Tables of entries: from the test tables, from a directory tree, from snapshots."""

from __future__ import annotations

import os
from datetime import datetime
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeway.functions import names
from sedgeway.runtime import replace_parquet, table
from sedgeway.schemas import ATTR_DIRECTORY, ATTR_HIDDEN, ATTR_REPARSE, ATTR_SYSTEM, ENTRIES

BACKSLASH = "\\"


def derive(entries: DataFrame) -> DataFrame:
    """Adds what is computed from a row alone: fold, ext, category, fold_path (where there is a full_path)."""
    out = entries.withColumn("fold", names.fold(F.col("name")))
    out = out.withColumns({"ext": names.extension(F.col("fold")), "category": names.category(F.col("fold"), F.col("is_dir"))})
    return out.withColumn("fold_path", names.fold(F.col("full_path"))) if "full_path" in entries.columns else out


def entries_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as volumes C..G, nations and customers as folders, orders as files."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.chr(67 + F.col("r_regionkey")).alias("drive_letter"))
    d1 = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def row(entry: Column, parent: Column, name: Column, is_dir: bool, size: Column, modified: Column, known: Column, hidden: Column, depth: int, path: Column) -> list[Column]:
        return [
            F.col("drive_letter").alias("volume_id"), F.col("drive_letter"), entry.cast("long").alias("entry_id"), parent.cast("long").alias("parent_id"), name.alias("name"),
            F.lit(is_dir).alias("is_dir"), hidden.alias("hidden"), F.lit(False).alias("system"), F.lit(False).alias("reparse"), F.lit(False).alias("deleted"),
            known.alias("metadata_known"), size.cast("long").alias("size"), modified.cast("timestamp_ntz").alias("modified"), entry.cast("long").alias("record_no"), F.lit(depth).alias("depth"), path.alias("full_path"),
        ]

    none, yes, no, zero = F.lit(None), F.lit(True), F.lit(False), F.lit(0)
    bs = F.lit(BACKSLASH)
    n_path = F.concat(F.col("drive_letter"), F.lit(":"), bs, F.col("n_name"))
    dirs1 = d1.select(*row(1_000_000_000 + F.col("n_nationkey"), F.col("r_regionkey"), F.col("n_name"), True, zero, none, yes, no, 1, n_path), "n_nationkey")
    dirs1_key = dirs1.select("n_nationkey", "drive_letter", F.col("full_path").alias("n_path"))
    d2 = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(F.broadcast(dirs1_key), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    c_path = F.concat("n_path", bs, F.col("c_name"))
    dirs2 = d2.select(*row(2_000_000_000 + F.col("c_custkey"), 1_000_000_000 + F.col("c_nationkey"), F.col("c_name"), True, zero, none, yes, no, 2, c_path))
    words = {"1-URGENT": "UrgentInvoice", "2-HIGH": "final_report", "3-MEDIUM": "quarterly_report_final", "5-LOW": "holiday photo"}
    word = F.when(F.col("o_orderpriority") == "1-URGENT", words["1-URGENT"])
    for k in ("2-HIGH", "3-MEDIUM", "5-LOW"):
        word = word.when(F.col("o_orderpriority") == k, words[k])
    key = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "docx", "jpg", "mp4", "zip", "cs", "exe")]), (key % 7 + 1).cast("int"))
    name = F.concat(word.otherwise("budget"), F.lit("_"), key.cast("string"), F.lit("."), ext)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    f = orders.join(d2.select("c_custkey", "drive_letter", c_path.alias("c_path")), F.col("o_custkey") == F.col("c_custkey"))
    files = f.select(
        *row(3_000_000_000 + key, 2_000_000_000 + F.col("o_custkey"), name, False, F.round(F.col("o_totalprice") * 100), F.col("o_orderdate"), key % 97 != 0, F.col("o_orderstatus") == "P", 3, F.concat("c_path", bs, name))
    )
    return derive(dirs1.drop("n_nationkey").unionByName(dirs2).unionByName(files))


ENTRIES_SQL = r"""
v as (select r_regionkey, chr(67+r_regionkey) as drive_letter from region),
d1 as (select 1000000000+n_nationkey as entry_id, cast(r_regionkey as bigint) as parent_id, drive_letter, n_name as name, true as is_dir, cast(0 as bigint) as size, cast(null as timestamp) as modified, true as known, false as hidden, 1 as depth, n_nationkey, chr(67+r_regionkey)||':'||chr(92)||n_name as full_path
  from nation join v on n_regionkey=r_regionkey),
d2 as (select 2000000000+c_custkey as entry_id, 1000000000+c_nationkey as parent_id, drive_letter, c_name as name, true as is_dir, cast(0 as bigint) as size, cast(null as timestamp) as modified, true as known, false as hidden, 2 as depth, c_nationkey as n_nationkey, full_path||chr(92)||c_name as full_path
  from customer join d1 on c_nationkey=n_nationkey),
f as (select 3000000000+o_orderkey as entry_id, 2000000000+o_custkey as parent_id, drive_letter,
   case o_orderpriority when '1-URGENT' then 'UrgentInvoice' when '2-HIGH' then 'final_report' when '3-MEDIUM' then 'quarterly_report_final' when '5-LOW' then 'holiday photo' else 'budget' end
   ||'_'||cast(o_orderkey as varchar(20))||'.'||
   case o_orderkey % 7 when 0 then 'pdf' when 1 then 'docx' when 2 then 'jpg' when 3 then 'mp4' when 4 then 'zip' when 5 then 'cs' else 'exe' end as name,
   false as is_dir, cast(round(o_totalprice*100) as bigint) as size, o_orderdate as modified, o_orderkey % 97 <> 0 as known, o_orderstatus='P' as hidden, 3 as depth, n_nationkey,
   full_path as parent_path
  from orders join d2 on 2000000000+o_custkey=d2.entry_id),
e0 as (
select entry_id,parent_id,drive_letter,name,is_dir,size,hidden,known,depth,full_path,modified from d1 union all
select entry_id,parent_id,drive_letter,name,is_dir,size,hidden,known,depth,full_path,modified from d2 union all
select entry_id,parent_id,drive_letter,name,is_dir,size,hidden,known,depth,parent_path||chr(92)||name,modified from f),
e as (select *, lower(name) as fold, lower(full_path) as fold_path, regexp_extract(lower(name), '^.+\.([^.]+)$', 1) as ext,
   case when is_dir then 'Folder' else case regexp_extract(lower(name), '^.+\.([^.]+)$', 1) when 'pdf' then 'Document' when 'docx' then 'Document' when 'jpg' then 'Image' when 'mp4' then 'Video' when 'zip' then 'Archive' when 'cs' then 'Code' when 'exe' then 'App' else 'Other' end end as category
   from e0)
"""


#: Folders a scan of a root leaves out. Fixed values.
SKIPPED_FOLDERS = ("$Recycle.Bin", "System Volume Information", "Config.Msi")
#: Rows of a scan after which the driver lists no further level itself.
MOST_LISTED = 20_000


def scan_tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), partitions: int = 8) -> DataFrame:
    """Entries of a directory tree that every executor can read; one task walks some of the folders.

    The driver lists levels from the top until there are four folders for each of ``partitions`` (of so few levels that
    it holds ``MOST_LISTED`` rows at most); tasks walk what lies below and send rows in batches.
    Links to directories are listed, not followed; folders that can't be read are listed and left empty.
    Ids are hashes of paths; the root has the id of its own path and no row.
    """
    skip = {s.lower() for s in SKIPPED_FOLDERS} | {os.path.normcase(x) for x in excluded}

    def walk(top: str, recurse: bool):
        try:
            with os.scandir(top) as found:
                items = sorted(found, key=lambda x: x.name)
        except OSError:
            return
        for x in items:
            if x.name.lower() in skip or os.path.normcase(x.path) in skip:
                continue
            try:
                is_dir, link, st = x.is_dir(follow_symlinks=False) or (x.is_symlink() and x.is_dir()), x.is_symlink(), x.stat(follow_symlinks=False)
                size, when = (0 if is_dir else st.st_size), int(st.st_mtime * 1_000_000)
            except OSError:
                is_dir, link, size, when = False, False, None, None
            yield x.path, top, x.name, is_dir, x.name.startswith("."), link, size, when
            if is_dir and not link and recurse:
                yield from walk(x.path, True)

    schema = "path string, parent string, name string, is_dir boolean, hidden boolean, reparse boolean, size bigint, micros bigint"
    first, level = [], [root]
    while level and len(first) < MOST_LISTED and (not first or len(level) < 4 * partitions):
        found = [x for top in level for x in walk(top, False)]
        first += found
        level = [x[0] for x in found if x[3] and not x[5]]
    tops = spark.createDataFrame([(p,) for p in level], "top string").repartition(partitions)

    def below(batches):
        import pandas as pd

        for pdf in batches:
            rows = (x for top in pdf["top"] for x in walk(top, True))
            while part := list(islice(rows, 10_000)):
                out = pd.DataFrame(part, columns=["path", "parent", "name", "is_dir", "hidden", "reparse", "size", "micros"])
                yield out.astype({"size": "Int64", "micros": "Int64"})

    rows = spark.createDataFrame(first, schema).unionByName(tops.mapInPandas(below, schema))
    at = lambda c: F.xxhash64(F.lit(root), c)
    return rows.select(
        F.lit(root).alias("volume_id"), at(F.col("path")).alias("entry_id"), at(F.col("parent")).alias("parent_id"), "name", "is_dir", "hidden", F.lit(False).alias("system"), "reparse",
        F.lit(False).alias("deleted"), F.col("size").isNotNull().alias("metadata_known"), F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.timestamp_micros("micros").cast("timestamp_ntz").alias("modified"), F.lit(None).cast("long").alias("record_no"),
    )


def save_snapshot(entries: DataFrame, path: str) -> DataFrame:
    """Writes the live rows as Parquet by volume, and a one-row table of count and checksum beside them; each replaces an older one when it is whole."""
    spark = entries.sparkSession
    live = entries.filter(~F.col("deleted")).select(*[f.name for f in ENTRIES.fields])
    replace_parquet(live, f"{path}/entries", ("volume_id",))
    check = checksum(spark.read.parquet(f"{path}/entries"))
    replace_parquet(check.coalesce(1), f"{path}/checksum")
    return check


def freeze(entries: DataFrame, folder: str, at: datetime) -> str:
    """A dated snapshot below ``folder``; returns its path. ``frozen`` lists and reads them."""
    path = f"{folder}/{at:%Y%m%dT%H%M%S}"
    save_snapshot(entries, path)
    return path


def frozen(spark: SparkSession, folder: str, times: list[datetime]) -> DataFrame:
    """The rows of dated snapshots with ``snapshot_id`` and ``created``; unreadable ones are left out."""
    found = [(at, load_snapshot(spark, f"{folder}/{at:%Y%m%dT%H%M%S}")) for at in times]
    parts = [df.withColumns({"snapshot_id": F.lit(f"{at:%Y%m%dT%H%M%S}"), "created": F.lit(at).cast("timestamp_ntz")}) for at, df in found if df is not None]
    if not parts:
        raise ValueError(f"no readable snapshot below {folder}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def from_enumeration(records: DataFrame) -> DataFrame:
    """Entries from names alone (volume_id, record_no, parent_record_no, name, attributes): sizes and times are not known yet.

    ``tree.build`` gives them paths; ``fill_metadata`` sizes and times.
    """
    bit = lambda b: F.col("attributes").bitwiseAND(F.lit(b)) != 0
    return records.select(
        "volume_id", F.col("record_no").alias("entry_id"), F.col("parent_record_no").alias("parent_id"), "name", bit(ATTR_DIRECTORY).alias("is_dir"), bit(ATTR_HIDDEN).alias("hidden"), bit(ATTR_SYSTEM).alias("system"),
        bit(ATTR_REPARSE).alias("reparse"), F.lit(False).alias("deleted"), F.lit(False).alias("metadata_known"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp_ntz").alias("modified"), "record_no",
    )


def checksum(entries: DataFrame) -> DataFrame:
    cols = [f.name for f in ENTRIES.fields if f.name != "volume_id"]
    return entries.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(F.col("volume_id").cast("string"), *cols)), F.lit(0)).alias("checksum"))


def load_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a snapshot; None if it is missing, unreadable or not what was written."""
    from pyspark.errors import AnalysisException, PySparkException

    try:
        entries = spark.read.parquet(f"{path}/entries")
        entries = entries.withColumn("volume_id", F.col("volume_id").cast("string")).select(*[f.name for f in ENTRIES.fields])
        if checksum(entries).collect() != spark.read.parquet(f"{path}/checksum").select("rows", "checksum").collect():
            return None
        return entries
    except (AnalysisException, PySparkException):
        return None


def fill_metadata(entries: DataFrame, found: DataFrame, only_incomplete: bool = True) -> DataFrame:
    """Size and time from ``found`` (parent_id, name, size, modified), by folder and name in either case."""
    side = found.select(F.col("parent_id").alias("_p"), names.fold(F.col("name")).alias("_f"), F.col("size").alias("_s"), F.col("modified").alias("_m")).dropDuplicates(["_p", "_f"])
    joined = entries.join(side, (F.col("parent_id") == F.col("_p")) & (names.fold(F.col("name")) == F.col("_f")), "left")
    take = F.col("_s").isNotNull() & (~F.col("metadata_known") if only_incomplete else F.lit(True))
    return joined.withColumns(
        {"size": F.when(take, F.col("_s")).otherwise(F.col("size")), "modified": F.when(take, F.col("_m")).otherwise(F.col("modified")), "metadata_known": F.col("metadata_known") | F.col("_s").isNotNull()}
    ).drop("_p", "_f", "_s", "_m")
