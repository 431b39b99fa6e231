"""Session helpers shared by the library."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sedgeway-ckpt-"))
    return configured or sc.getCheckpointDir()


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A folder below the checkpoint folder for what ``store`` writes in this block; deleted at its end."""
    path = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(before)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def replace_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes ``df`` beside ``path`` and moves it there when it is whole, so that readers find the old table or the new one."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(hadoop(path))
    if had:
        files.rename(hadoop(path), hadoop(old))
    if not files.rename(hadoop(fresh), hadoop(path)):
        if had:
            files.rename(hadoop(old), hadoop(path))
        raise OSError(f"{fresh} can't be moved to {path}")
    if had:
        files.delete(hadoop(old), True)


def store(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet in the scratch (else the checkpoint) folder and read again: computed once, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{_scratch.get() or ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


#: Where ``store`` and ``cut`` wrote the frames that they returned.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of frames from ``store`` or ``cut``. No frame that reads them may be used any more; other frames are left alone."""
    for df in frames:
        if df is not None and (path := _places.pop(df, None)):
            delete(df.sparkSession, path)


#: Makes Spark drop a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``store`` for the steps of an iteration. The shuffle files it took go at once.

    A frame read from files has no lineage and a size estimate of its own. A checkpointed one keeps the estimate of
    the plan that made it, a product over its joins, which within a dozen rounds of an iteration has thousands of bits.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return store(df.select("*"))  # a plan of its own, made under this setting
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nobody holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
