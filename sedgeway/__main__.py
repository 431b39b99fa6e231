"""Command line: scan a directory tree, search a snapshot, show its statistics, time searches."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeway.operators import stats
from sedgeway.operators.search import search
from sedgeway.operators.tree import resolve
from sedgeway.sources.entries import derive, load_snapshot, save_snapshot, scan_tree

#: What ``bench`` searches for.
SEARCHES = ("report", "inv", "holiday photo", "ext:pdf", "size:>1mb", "*.zip", "dm:today", "fnl")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's entries with paths and what is derived from names; exits if it can't be read."""
    entries = load_snapshot(spark, path)
    if entries is None:
        sys.exit(f"no readable snapshot at {path}")
    roots = entries.select("volume_id").distinct().select(F.xxhash64("volume_id", "volume_id").alias("root_id"), F.col("volume_id").alias("root"))
    place = resolve(entries, roots).select("id", "full_path", "depth")
    return derive(entries.join(place, entries["entry_id"] == place["id"]).drop("id").withColumn("drive_letter", F.col("volume_id")))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sedgeway", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("scan", help="list a directory tree into a snapshot")
    one.add_argument("root")
    one.add_argument("snapshot")
    one.add_argument("--exclude", action="append", default=[])
    one = verbs.add_parser("search", help="search a snapshot")
    one.add_argument("snapshot")
    one.add_argument("query")
    one.add_argument("--top", type=int, default=20)
    one.add_argument("--sort", choices=("relevance", "size", "modified", "name"), default="relevance")
    for verb in ("stats", "bench"):
        verbs.add_parser(verb).add_argument("snapshot")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("sedgeway").getOrCreate()
    if given.verb == "scan":
        found = save_snapshot(scan_tree(spark, given.root, tuple(given.exclude)), given.snapshot).first()
        print(f"{found['rows']} entries")
        return 0
    entries = load(spark, given.snapshot)
    if given.verb == "search":
        result = search(entries, given.query, sort=given.sort, max_results=given.top)
        for error in result.errors:
            print(f"query: {error}", file=sys.stderr)
        for r in result.hits.select("full_path", "size").collect():
            print(f"{r['size']:>14}  {r['full_path']}")
        print(f"{result.total} matches{' (with typing errors)' if result.used_typos else ''}")
        return 0
    if given.verb == "stats":
        total = stats.summary(entries).first()
        print(f"{total['files']} files, {total['folders']} folders, {total['total_bytes']} bytes")
        for r in stats.categories(entries).collect():
            print(f"{r['files']:>12}  {r['category']}")
        return 0
    entries = entries.cache()
    entries.count()
    times = []
    for text in SEARCHES:
        start = time.perf_counter()
        total = search(entries, text).total
        times.append((text, (time.perf_counter() - start) * 1000, total))
    for text, ms, total in times:
        print(f"{ms:>10.0f} ms  {total:>10}  {text}")
    median = stats.median(spark.createDataFrame(times, "query string, ms double, total long"), "ms").first()["median"]
    print(f"{median:>10.0f} ms  median")
    return 0


if __name__ == "__main__":
    sys.exit(main())
