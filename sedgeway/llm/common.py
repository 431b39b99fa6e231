"""Shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one Arrow batch is split into at most, but for a single longer row.
BATCH_BYTES = 4 << 20

WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The array of words: runs of anything but the six ASCII white-space characters."""
    spaced = text
    for c in "\t\n\x0b\x0c\r":  # a text without the character passes at the speed of a byte search
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``limit`` bytes each."""
    import pyarrow.compute as pc

    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_list(values.type):
        sizes = pc.multiply(pc.fill_null(pc.list_value_length(values), 0), 8).to_numpy(zero_copy_only=False)
    else:
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_arrow(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: T.StructType, keep: bool = True) -> DataFrame:
    """``df`` with the columns ``added`` (and, unless ``keep``, without ``column``), computed a slice of a batch at a time.

    ``make`` runs once for each task and returns the function from a slice to a dictionary of the new
    columns' values. A new column replaces one of the same name.
    """
    names = [f.name for f in added.fields]
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names} and (keep or f.name != column)]
    schema = T.StructType(kept + added.fields)
    arrow = to_arrow_schema(schema)
    keep_at = [df.schema.fields.index(f) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, column):
                new = work(piece)
                arrays = [piece.column(i) for i in keep_at]
                for name in names:
                    field = arrow.field(name)
                    value = new[name]
                    arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` or $SEDGEWAY_TOKENIZERS replaces the installed one."""
    folder = folder or os.environ.get("SEDGEWAY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
