"""The journal as a stream: deletions with their replacements, and entries kept up to date.

Replacement needs memory of the last deletion of each name in each folder for two seconds. It is keyed
state with an event-time timeout, so the state holds what the window covers and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedgeway import schemas as S
from sedgeway.functions.names import fold
from sedgeway.operators.journal import REPLACE_SECONDS, advance, apply_batch, closed, has


def read_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Closed records of a folder of journal Parquet files."""
    return closed(spark.readStream.schema(S.JOURNAL).option("maxFilesPerTrigger", max_files).parquet(path))


def dedupe(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """History and live records without repeats."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["volume_id", "record_no", "sequence", "usn"])


def deletions_with_kind(stream: DataFrame, seconds: int = REPLACE_SECONDS, delay: str = "10 seconds") -> DataFrame:
    """(volume_id, record_no, parent_record_no, name, usn, ts, kind) of deletions.

    A deletion comes out as Replaced when a create of its name follows within ``seconds``, as Deleted when
    another event of the name shows that none did, or when the watermark has passed the window.
    """
    event = F.when(has(S.FILE_DELETE), "delete").when(has(S.FILE_CREATE), "create")
    rows = stream.withColumns({"event": event, "key": fold(F.col("name")), "at": F.col("ts").cast("timestamp")}).filter("event is not null").withWatermark("at", delay)
    schema = "volume_id string, parent_record_no long, key string, record_no long, name string, usn long, micros long, kind string"
    held = "record_no long, name string, usn long, micros long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        volume, parent, k = key
        out: list[tuple] = []
        last = state.get if state.exists else None

        def emit(kind: str) -> None:
            out.append((volume, parent, k, *last, kind))

        if state.hasTimedOut:
            if last:
                emit("Deleted")
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("usn")
            for r in rows.itertuples(index=False):
                micros = int(r.at.value // 1000)
                if last:
                    emit("Replaced" if r.event == "create" and micros - last[3] <= seconds * 1_000_000 else "Deleted")
                last = (int(r.record_no), r.name, int(r.usn), micros) if r.event == "delete" else None
            if last:
                state.update(last)
                state.setTimeoutTimestamp(max(last[3] // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    found = rows.groupBy("volume_id", "parent_record_no", "key").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("deleted_at", F.timestamp_micros("micros")).drop("micros", "key")


def daily_counts(deletions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Deletions of each day, by event time."""
    return deletions.withWatermark("deleted_at", delay).groupBy(F.window("deleted_at", "1 day"), "kind").agg(F.count("*").alias("deletions"))


def maintain(
    stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, roots: DataFrame | None = None, rescan: Callable[[list[str]], DataFrame] | None = None, **trigger
):
    """Keeps entries up to date: every micro-batch is applied to what ``load`` returns and given to ``save``.

    Only the volumes that a batch names are touched; ``save`` gets their rows. With ``roots`` (root_id, root) what
    hangs from folders that have gone goes, too, and full paths are made anew. A stream of ``sources.journal`` may say that
    changes of a volume are lost: ``rescan`` then gives its entries from a new scan, which stand for the whole batch of that volume.
    ``save(entries, deletions, batch_id)`` must be idempotent for a batch id, as a batch may come again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            lost = [r["volume_id"] for r in batch.filter("rescan").select("volume_id").distinct().collect()] if "rescan" in batch.columns else []  # a row for each drive
            if lost and rescan is None:
                raise ValueError(f"changes of {', '.join(sorted(lost))} are lost, and nothing scans them again")
            kept = batch.filter(~F.col("volume_id").isin(lost)).select(*[f.name for f in S.JOURNAL]) if "rescan" in batch.columns else batch
            named = [r["volume_id"] for r in kept.select("volume_id").distinct().collect()]  # a row for each drive
            entries = load().filter(F.col("volume_id").isin(named))
            now, deletions = advance(entries, kept, roots) if roots is not None else apply_batch(entries, kept)
            if lost:
                now = now.unionByName(rescan(lost), allowMissingColumns=True)
            save(now, deletions, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
