"""Statistics of entries: counts, bytes, categories, the largest files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.functions.names import category_rank


def _live(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("deleted"))


def summary(entries: DataFrame) -> DataFrame:
    """One row: files, folders and the bytes of files whose size is known."""
    is_dir = F.col("is_dir")
    return _live(entries).agg(
        F.count_if(~is_dir).alias("files"), F.count_if(is_dir).alias("folders"),
        F.coalesce(F.sum(F.when(~is_dir & F.col("metadata_known"), F.col("size"))), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.max(~F.col("metadata_known")), F.lit(False)).alias("incomplete"),
    )


def categories(entries: DataFrame) -> DataFrame:
    """Files of each category, most first, then in the fixed order of categories."""
    counted = _live(entries).filter(~F.col("is_dir")).groupBy("category").agg(F.count("*").alias("files"))
    return counted.orderBy(F.desc("files"), category_rank(F.col("category")))


def largest(entries: DataFrame, n: int = 10) -> DataFrame:
    """The n largest files of known size; the earlier drive and id win ties."""
    known = _live(entries).filter(~F.col("is_dir") & F.col("metadata_known"))
    return known.orderBy(F.desc("size"), "drive_letter", "entry_id").limit(n)


def donut(entries: DataFrame, slices: int = 6) -> DataFrame:
    """The largest named categories and one slice for the rest, with their shares."""
    counted = categories(entries).withColumn("rank", category_rank(F.col("category")))
    w = Window.partitionBy(F.col("category") == "Other").orderBy(F.desc("files"), "rank")  # at most eight rows
    label = F.when((F.col("category") != "Other") & (F.col("k") <= slices), F.col("category")).otherwise("Other")
    grouped = counted.withColumn("k", F.row_number().over(w)).groupBy(label.alias("label")).agg(F.sum("files").alias("files"))
    total = F.sum("files").over(Window.partitionBy(F.lit(1)))
    return grouped.withColumn("fraction", F.col("files") / total)


def live_counts(entries: DataFrame) -> DataFrame:
    """Live entries of each drive, and of all (null)."""
    return _live(entries).rollup("drive_letter").agg(F.count("*").alias("entries"))


def folder_size(entries: DataFrame, folder: str) -> DataFrame:
    """Bytes of all files below a folder, links left out."""
    prefix = folder.rstrip("\\").lower() + "\\"
    inside = _live(entries).filter(F.startswith("fold_path", F.lit(prefix)) & ~F.col("is_dir") & ~F.col("reparse"))
    return inside.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def scan_agreement(ours: DataFrame, other: DataFrame) -> DataFrame:
    """Share of rows of ``other`` (fold_path, size) found in ``ours``, and with equal sizes."""
    b = other.select("fold_path", F.col("size").alias("other_size"))
    joined = b.join(ours.select("fold_path", "size"), "fold_path", "left")
    return joined.agg(F.count("*").alias("rows"), F.avg(F.col("size").isNotNull().cast("int")).alias("found"), F.avg((F.col("size") == F.col("other_size")).cast("int")).alias("equal_sizes"))


def distinct_values(entries: DataFrame, column: str) -> DataFrame:
    """The different values of a column (categories, drives, volumes) among live entries."""
    return _live(entries).select(column).distinct()


def median(df: DataFrame, column: str, *by: str) -> DataFrame:
    """The exact median of a column, for each group of ``by``."""
    return df.groupBy(*by).agg(F.percentile(column, 0.5).alias("median"), F.count(column).alias("n"))
