"""Session helpers: shared-folder tables that cut lineage, and slices of Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a context's own checkpoint folder is
    taken, and a temporary folder only on a local master, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = context.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="verdigris-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage and survives lost executors; it is removed at the end of the
    :func:`scope` it was written in, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that a Python worker unpacks few long texts at once.

    Spark bounds a batch's bytes itself (``spark.sql.execution.arrow.maxBytesPerBatch``); no setting of the session changes.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def release() -> None:
    """Remove all written tables now, for sessions that live long; DataFrames that read them can't run any more."""
    _remove(_WRITTEN)


@contextmanager
def scope() -> Iterator[None]:
    """Remove the tables that operators write inside once the block ends; results must be stored or collected in it."""
    before = list(_WRITTEN)
    try:
        yield
    finally:
        _remove([w for w in _WRITTEN if w not in before])


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    for spark, path in list(written):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the context is gone; a local folder can still be removed
            if path.startswith("file://"):
                shutil.rmtree(path[len("file://") :], ignore_errors=True)
        if (spark, path) in _WRITTEN:
            _WRITTEN.remove((spark, path))


atexit.register(release)
