"""Ranked lexical search: the best documents for each item by an integer score of their common terms.

``postings`` makes the index: for each document and bucket of terms a row with the terms that the document holds
in that bucket and how often. It is stored by bucket, so a search reads the buckets of its terms only. Terms are
bucketed within documents and not across the corpus, since all terms of a document are summed up together: an
exchange by term would send every match, and the most frequent terms' buckets would hold almost every document.

``ranked`` joins the postings with the items' terms, twice: first each posting gets its share of a score, which no
item changes; then, dealt by document, it meets the items that hold its term, and is summed by item and document
where it lies. The window over each item keeps the best of each task before it sends any.

The items' terms are broadcast up to ``MAX_BROADCAST`` rows; more are joined by a shuffle.

Defined cases: a null text has no terms; every row of the items, and every row of the documents, is one of its own,
repeated or not (an item without common terms has no rows); ties go by ascending doc_id, null last; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sedgeway.llm.common import pieces
from sedgeway.runtime import cut, store, table

#: Buckets of terms; a table is written in so many parts.
BUCKETS = 8
#: Rows of items' terms that are broadcast at most.
MAX_BROADCAST = 200_000
TOP = 10
#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 ``text`` in order."""
    return text.translate(_TERM_BYTES).split()


class _Buckets(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[term] = b = crc32(term) % BUCKETS
        return b


def postings(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, n, first, bucket, terms): the terms of every row of ``df`` with their times, ``n`` being how many it has with repeats.

    A row's first bucket is marked, so that sums over rows count each once. Rows without terms have none.
    """
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("bucket", T.IntegerType())]
        + [T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])))]
    )
    arrow = to_arrow_schema(schema)
    pair = arrow.field("terms").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets().__getitem__
        for batch in batches:
            for piece in pieces(batch, "text"):
                counts = [Counter(terms_of(t or b"")) for t in piece.column(2).cast(pa.binary()).to_pylist()]
                sizes = np.fromiter(map(len, counts), np.int64, len(counts))
                if not sizes.sum():
                    continue
                terms = list(chain.from_iterable(counts))
                times = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int32, len(terms))
                bucket = np.fromiter(map(bucket_of, terms), np.int64, len(terms))
                place = np.repeat(np.arange(len(counts)), sizes) * BUCKETS + bucket
                order = np.argsort(place, kind="stable")
                place = place[order]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
                doc = place[starts] // BUCKETS
                total = np.bincount(np.repeat(np.arange(len(counts)), sizes), weights=times, minlength=len(counts)).astype(np.int64)
                values = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(order)), pa.array(times[order])], fields=list(pair))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(at), piece.column(1).take(at), pa.array(total[doc]), pa.array(np.concatenate([[True], np.diff(doc) > 0])), pa.array((place[starts] % BUCKETS).astype(np.int32))]
                    + [pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), values)],
                    schema=arrow,
                )

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _div(a, b):
    return F.call_function("div", a, b)


def ranked(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of ``index`` (stored ``postings``) for each row of ``items``."""
    asked = cut(postings(items, text, item_id).select(F.col("row").alias("item"), F.col("doc_id").alias("item_id"), "bucket", F.inline("terms")))
    sums = index.filter("first").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()  # one row
    docs, length = sums["docs"], max(sums["length"] or 0, 1)
    small = asked.count() <= MAX_BROADCAST
    ready = F.broadcast if small else (lambda df: df)
    used = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS rows at most
    each = index.filter(F.col("bucket").isin(used)).select("row", "doc_id", "n", F.inline("terms"))
    wanted = asked.select("term").distinct()
    df = each.select("term").join(ready(wanted), "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = cut(df.select("term", weight.alias("w"))).withColumn("term_id", F.xxhash64("term"))
    # A number in place of the term, unless two terms of the items had the same.
    if weights.select("term_id").distinct().count() < weights.count():
        weights = weights.withColumn("term_id", F.col("term"))
    m = F.lit(25).cast("long") + _div(F.lit(75).cast("long") * F.col("n") * F.lit(docs).cast("long"), F.lit(length).cast("long"))
    share = F.col("w") * _div(F.lit(1_000_000_000).cast("long") * F.col("tf"), F.lit(1000).cast("long") * F.col("tf") + 8 * m)
    scored = each.join(ready(weights), "term").select("row", "doc_id", "term_id", share.alias("share"))
    terms = cut(asked.join(weights, "term").select("item", "item_id", "term_id", F.col("tf").cast("long").alias("times")))
    met = scored.repartition("row").join(ready(terms), "term_id")
    score = met.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("times") * F.col("share")).alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return score.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = store(postings(table(spark, sf_dir, "documents")), partition_by=("bucket",))
    return ranked(index, table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
  SELECT item_id, term, count(*) AS times FROM i GROUP BY 1, 2
), p AS (
  SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d
), c AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL
), s AS (
  SELECT count(*) AS docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, docs
), x AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
  FROM c JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank FROM x WHERE score > 0
) WHERE rank <= 10
"""
