"""Search: a compiled query over entries, ranked, with the exact number of matches.

The query becomes one predicate and, for the rows that pass it, tier, score and a packed sort key. Filters
on stored columns reach the Parquet scan; ``drive:`` prunes partitions of a snapshot; the ranked page is a
top-k that every task cuts before anything is sent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeway.functions.match import NO_MATCH, highlight_ranges, match
from sedgeway.plans.query import Clause, Filter, Query, Term, parse

MAX_RESULTS = 5000
#: Rows of a result page that are fetched at once; longer ones stay a plan.
MAX_PAGE = 20_000
#: With fewer matches than this the query is tried again with typing errors allowed.
TYPO_PASS_BELOW = 200


@dataclass
class SearchResult:
    hits: DataFrame
    total: int
    query: Query
    used_typos: bool = False

    @property
    def errors(self) -> tuple[str, ...]:
        return self.query.errors


def filter_column(f: Filter) -> Column:
    """The test of one filter."""
    is_dir, known = F.col("is_dir"), F.col("metadata_known")
    if f.kind == "ext":
        return ~is_dir & F.col("ext").isin(*f.value)
    if f.kind == "category":
        return F.col("category").isin(*f.value)
    if f.kind == "folders":
        return is_dir == F.lit(f.value)
    if f.kind == "size":
        return ~is_dir & known & F.col("size").between(*f.value)
    if f.kind == "date":
        low, high = f.value
        when = F.col("modified")
        after = F.lit(True) if low is None else when >= F.lit(low).cast("timestamp_ntz")
        before = F.lit(True) if high is None else when.isNull() | (when < F.lit(high).cast("timestamp_ntz"))
        return known & F.coalesce(after, F.lit(False)) & before
    if f.kind == "drive":
        return F.col("drive_letter") == f.value
    return F.contains(F.col("fold_path"), F.lit(f.value))


def _limited(term: Term, c: Column) -> Column:
    if term.only is None:
        return c
    return (F.col("is_dir") if term.only == "folder" else ~F.col("is_dir")) & c


@dataclass
class Compiled:
    """The predicate, and for each clause with names its best (tier, minus score)."""

    predicate: Column
    best: list[Column]


def _either(a: Column, b: Column) -> Column:
    return a | b


def compile_query(query: Query, category: str | None = None, include_hidden: bool = False, fuzzy: bool = True, typos: bool = False) -> Compiled:
    tests = [~F.col("deleted")]
    if not include_hidden:
        tests.append(~(F.col("hidden") | F.col("system")))
    if category:
        tests.append(F.col("category") == category)
    best: list[Column] = []

    def add(clause: Clause) -> None:
        fuzz = fuzzy and not clause.negated
        any_of, pairs = [], []
        for a in clause.alternatives:
            if isinstance(a, Filter):
                any_of.append(filter_column(a))
            elif a.kind == "path":
                any_of.append(_limited(a, F.contains(F.col("fold_path"), F.lit(a.text))))
            else:
                hit, tier, score = match(F.col("name"), F.col("fold"), a, fuzz, typos and fuzz)
                any_of.append(_limited(a, hit))
                if a.only:
                    tier = F.when(_limited(a, F.lit(True)), tier).otherwise(NO_MATCH)
                pairs.append(F.struct(tier.alias("tier"), (-score).alias("minus")))
        test = reduce(_either, any_of)
        tests.append(~test if clause.negated else test)
        if pairs and not clause.negated:
            best.append(F.array_min(F.array(*pairs)))

    for clause in query.clauses:
        add(clause)
    return Compiled(reduce(lambda a, b: a & b, tests), best)


def _ranked(found: DataFrame, best: list[Column]) -> DataFrame:
    """``found`` with tier (the worst of the clauses), score (their sum) and name_matched."""
    names = [f"_best{i}" for i in range(len(best))]
    found = found.withColumns(dict(zip(names, best)))
    hit = [F.col(n)["tier"] != NO_MATCH for n in names]
    tiers = [F.when(h, F.col(n)["tier"]).otherwise(0) for n, h in zip(names, hit)]
    scores = [F.when(h, -F.col(n)["minus"]).otherwise(0) for n, h in zip(names, hit)]
    return found.withColumns(
        {
            "tier": F.greatest(F.lit(0), F.lit(0), *tiers).cast("int"),
            "score": reduce(lambda a, b: a + b, scores, F.lit(0)).cast("int"),
            "name_matched": reduce(_either, hit, F.lit(False)),
        }
    ).drop(*names)


def relevance_key() -> Column:
    """Tier, score, whether the name matched, shortness, shallowness and age in one number, greater is better."""
    days = F.datediff(F.col("modified"), F.lit("2000-01-01").cast("date"))
    parts = [
        (255 - F.col("tier"), 52), (F.greatest(F.lit(0), F.least(F.lit(4095), F.col("score") + 2048)), 40), (F.col("name_matched").cast("int"), 39),
        (255 - F.least(F.length("name"), F.lit(255)), 31), (255 - F.least(F.col("depth"), F.lit(255)), 23),
        (F.greatest(F.lit(0), F.least(F.lit((1 << 23) - 1), F.coalesce(days, F.lit(0)))), 0),
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c.cast("long"), n) for c, n in parts])


def order_of(sort: str, root: str | None = None) -> list[Column]:
    """The order of a sort mode. Ties go to the earlier drive, the shorter ``root`` (a column) where drives have several, then the lower id."""
    tie = [F.asc("drive_letter"), *([F.asc(F.length(root))] if root else []), F.asc("entry_id")]
    if sort == "size":
        return [F.desc(F.when(F.col("metadata_known"), F.col("size")).otherwise(-1)), *tie]
    if sort == "modified":
        return [F.desc_nulls_last("modified"), *tie]
    if sort == "name":
        return [F.asc("fold"), *tie]
    return [F.desc("key"), *tie]


def matches(entries: DataFrame, query: Query, category: str | None = None, include_hidden: bool = False, fuzzy: bool = True, typos: bool = False) -> DataFrame:
    """All rows that match, with tier, score, name_matched and key; none for an empty query without a category."""
    if not query.clauses and category is None:
        entries = entries.limit(0)
    c = compile_query(query, category, include_hidden, fuzzy, typos)
    return _ranked(entries.filter(c.predicate), c.best).withColumn("key", relevance_key())


def search(
    entries: DataFrame, text: str, sort: str = "relevance", max_results: int = MAX_RESULTS, category: str | None = None, include_hidden: bool = False, fuzzy: bool = True,
    now: datetime | None = None, zone: str = "UTC", highlight: bool = False,
) -> SearchResult:
    """Ranked hits of a query. A second pass with typing errors is adopted whole, if it finds more.

    A page of ``MAX_PAGE`` rows or fewer is fetched at once: a top-k in one pass over the entries. If it isn't
    full it is all that matches, and no pass counts.
    """
    query = parse(text, now, zone)
    order = order_of(sort)

    def run(typos: bool) -> tuple[DataFrame, int]:
        found = matches(entries, query, category, include_hidden, fuzzy, typos)
        page = found.orderBy(*order).limit(max_results)
        if not (query.clauses or category):
            return page, 0
        if max_results > MAX_PAGE:
            return page, found.count()
        rows = page.toArrow()
        total = rows.num_rows if rows.num_rows < max_results else found.count()
        return entries.sparkSession.createDataFrame(rows, page.schema), total

    (hits, total), used = run(False), False
    if fuzzy and total < TYPO_PASS_BELOW and any(t.allows_typos for t in query.name_terms):
        more, total2 = run(True)
        if total2 > total:
            hits, total, used = more, total2, True
    return SearchResult(with_highlights(hits, query) if highlight else hits, total, query, used)


def by_path(entries: DataFrame, path: str) -> DataFrame:
    """The live entry at a full path, in either case."""
    return entries.filter(~F.col("deleted") & (F.col("fold_path") == path.rstrip("\\").lower()))


def child_of(entries: DataFrame, parent_id: int, name: str) -> DataFrame:
    """The live child of a folder by its name, in either case; the first if there are several."""
    return entries.filter(~F.col("deleted") & (F.col("parent_id") == parent_id) & (F.col("fold") == name.lower())).orderBy("entry_id").limit(1)


def with_highlights(hits: DataFrame, query: Query) -> DataFrame:
    """``hits`` with ``highlights``, the ranges of the name that plain terms mark."""
    terms = [t.text for t in query.name_terms if t.kind == "plain"]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))

    @F.udf(span, useArrow=True)
    def mark(name: str):
        return [{"start": a, "length": n} for a, n in highlight_ranges(name or "", terms)]

    return hits.withColumn("highlights", mark("name"))


def recent_searches(searches: DataFrame, text: str = "query", at: str = "at", most: int = 12, least: int = 2) -> DataFrame:
    """The latest of equal searches (in either case), newest first."""
    kept = searches.filter(F.length(F.trim(text)) >= least).groupBy(F.lower(F.trim(text)).alias("_k")).agg(F.max_by(F.trim(text), at).alias(text), F.max(at).alias(at))
    return kept.drop("_k").orderBy(F.desc(at), text).limit(most)


__all__: Sequence[str] = ["SearchResult", "by_path", "child_of", "compile_query", "filter_column", "matches", "order_of", "recent_searches", "relevance_key", "search", "with_highlights"]
