"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets counts from its whole text. Features of those counts are summed up in KLL quantile
sketches per (lang, source), over all documents that pass the fixed base rules; the sketches merge into one
per language and one for all. Small groups are pooled: a document's limits come from the sketch of its own
(lang, source) if that holds ``MIN_ROWS`` documents, else from the merged sketch of its language, else from
that of all. A limit is the quantile at the feature's ``LEVEL`` plus ``FENCE`` times the spread between the
quartiles (for lengths of words there is the mirror image below, too); no limit is a fixed number, so what
is usual in one source can be too much in another. A join brings the limits to the documents, and those
beyond a limit, or failing the base rules, are not kept.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources
form groups of their own; ties with a limit are kept (limits are exclusive); repeated rows count and are
judged one by one; an empty table gives no rows. Repeated windows are compared by 64-bit hashes of their
three words. A sketch of more than about ``SKETCH_K`` values keeps a random choice of them, so quantiles
are off by up to about 0.2 % of the ranks, and reruns can differ for documents right at a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeway.llm.common import let, text_or_empty, words
from sedgeway.runtime import cut, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Documents that a group needs for limits of its own.
MIN_ROWS = 30
MAX_BROADCAST = 100_000
SKETCH_K = 2048
FENCE = 6.0
#: Feature: the quantile above which values are unusual. Junk may be a quarter of a group where it is the upper quartile; documents that repeat lines or phrases of their own are ordinary, so only the outermost go.
LEVEL = {"symbol_share": 0.75, "dup_line_share": 0.995, "repeat_share": 0.995, "word_length": 0.75}
#: Features with a limit below the mirrored quantile too.
BELOW = ("word_length",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum")), lambda acc: acc["sum"])

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, i: (F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)) | (F.when(i < n - 1, F.get(s, i + 1)["h"] == x["h"]).otherwise(False)))
        return covered(F.sort_array(F.transform(twice, lambda x: x["p"])))

    def found(h: Column) -> Column:
        """Most texts repeat no window, which a set of numbers tells; only the others are sorted."""
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(marked), from_sorted))

    def windows(a: Column) -> Column:
        return let(F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))), found)

    return F.when(F.size(w) >= 4, let(w, windows)).otherwise(0)


def _without(text: Column, signs: str) -> Column:
    for c in signs:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five counts of COUNTS and ``n_lines`` (lines with a word); columns of these names are replaced."""
    t = text_or_empty(df, text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return (
        df.withColumns({"_t": t, "_w": words(t), "_l": lines})
        .withColumns(
            {
                "n_words": F.size("_w").cast("long"),
                "word_chars": F.length(F.array_join("_w", "")).cast("long"),
                "n_symbols": (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long"),
                "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                "n_repeat_words": _repeat_words(F.col("_w")).cast("long"),
                "n_lines": F.size("_l").cast("long"),
            }
        )
        .drop("_t", "_w", "_l")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }


def limits(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The limits of every (lang, source), from mergeable sketches over all rows of ``counted`` that pass the base rules."""
    names = list(features())
    ok = counted.filter(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *[c.alias(n) for n, c in features().items()])
    own = ok.groupBy("lang", "source").agg(F.count("*").alias("rows"), *[F.kll_sketch_agg_double(n, SKETCH_K).alias(n) for n in names])

    def merged(by: list[str]) -> DataFrame:
        return own.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(n, SKETCH_K).alias(n) for n in names])

    def bounds(n: str) -> list[Column]:
        at = lambda q: F.kll_sketch_get_quantile_double(n, F.lit(q))
        reach = FENCE * (at(0.75) - at(0.25))
        return [(at(LEVEL[n]) + reach).alias(f"{n}_most"), ((at(1 - LEVEL[n]) - reach) if n in BELOW else F.lit(float("-inf"))).alias(f"{n}_least")]

    cols = ["rows", *[f"{n}_{k}" for n in names for k in ("most", "least")]]
    value = F.struct(*[F.col(c) for c in cols])

    def packed(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.select(*by, "rows", *[b for n in names for b in bounds(n)]).select(*by, value.alias(name))

    a = packed(own, ["lang", "source"], "own")
    b = packed(merged(["lang"]), ["lang"], "by_lang").withColumnRenamed("lang", "lang2")
    c = packed(merged([]).filter("rows > 0").withColumn("all", F.lit(1)), ["all"], "by_all")
    full = a.withColumn("one", F.lit(1)).join(b, a["lang"].eqNullSafe(b["lang2"]), "left").join(F.broadcast(c), F.col("one") == F.col("all"), "left")  # by_all is one row
    best = F.when(F.col("own.rows") >= MIN_ROWS, F.col("own")).when(F.col("by_lang.rows") >= MIN_ROWS, F.col("by_lang")).otherwise(F.col("by_all"))
    return full.select(F.col("lang").alias("_limit_lang"), F.col("source").alias("_limit_source"), best.alias("_limit"))


def judge(counted: DataFrame, limit: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``. Limits are broadcast if they have ``MAX_BROADCAST`` rows at most."""
    limit = cut(limit)
    if limit.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        limit = F.broadcast(limit)
    joined = counted.join(limit, counted[lang].eqNullSafe(F.col("_limit_lang")) & counted[source].eqNullSafe(F.col("_limit_source")), "left")
    inside = F.lit(True)
    for n, c in features().items():
        inside = inside & (c <= F.col(f"_limit.{n}_most")) & (c >= F.col(f"_limit.{n}_least"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_limit_lang", "_limit_source", "_limit")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = cut(with_counts(docs).drop("text"))
    return judge(counted, limits(counted)).select("doc_id", *COUNTS, "base_failed", "kept")
