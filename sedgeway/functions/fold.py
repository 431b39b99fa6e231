"""Folds over the parts of a key in their order, for values that no single row may hold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def running_sha256(parts: DataFrame, keys: list[str], order: str, data: str, separator: bytes = b"") -> DataFrame:
    """(keys, n_parts, n_bytes, sha256) of the parts of each key in ``order``, ``separator`` between them.

    Parts are dealt by key and sorted within their task; one hash runs over them as they pass, so a task holds a batch
    of parts whatever a key adds up to. (A digest is sequential: a key's bytes pass through one task.) Null data counts as
    no bytes, but as a part.
    """
    schema = T.StructType([*[T.StructField(k, parts.schema[k].dataType) for k in keys], T.StructField("n_parts", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, state, n_parts, n_bytes = None, None, 0, 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            named = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            for key, value in zip(named, batch.column(len(keys))):
                if key != at:
                    if at is not None:
                        done.append((*at, n_parts, n_bytes, state.hexdigest()))
                    at, state, n_parts, n_bytes = key, hashlib.sha256(), 0, 0
                elif separator:
                    state.update(separator)
                    n_bytes += len(separator)
                n_parts += 1
                if value.is_valid:
                    state.update(value.as_buffer())
                    n_bytes += len(value.as_buffer())
            if len(done) >= 4096:
                yield out()
                done = []
        if at is not None:
            done.append((*at, n_parts, n_bytes, state.hexdigest()))
        yield out()

    dealt = parts.select(*keys, F.col(order).alias("_order"), F.col(data).cast("binary").alias("_data")).repartition(*keys).sortWithinPartitions(*keys, "_order")
    return dealt.select(*keys, "_data").mapInArrow(run, schema)
