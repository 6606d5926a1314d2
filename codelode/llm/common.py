"""Helpers shared by the corpus operators: shared folder, materialised steps, bounded batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but these six ASCII white-space characters (bytes.split() cuts the same way).
WORD = "[^\\x20\\x09-\\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs on one machine, as in tests, a new local one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="codelode-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/codelode/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application's corpus operators have written to the shared folder: to be called when their results have been used."""
    _delete(spark, f"{shared_dir(spark)}/codelode/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, what: str, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path, was = new_path(spark, what), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._codelode_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Delete a materialised step that nothing will read again."""
    path = getattr(df, "_codelode_path", None)
    if path:
        _delete(df.sparkSession, path)


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """How many partitions keep each at about `per` rows, the session's setting at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per), 1)


def binary_column(column: pa.Array) -> pa.Array:
    """A string column as bytes, null as empty, whatever Arrow type Spark sent."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    return column.fill_null(b"")


_FORGET: list[Callable[[], None]] = []
_STAGE: list[int | None] = [None]


def when_stage_changes(forget: Callable[[], None]) -> None:
    """Have forget() called in this task process before it works on another stage, as Spark keeps its Python processes."""
    _FORGET.append(forget)


def _enter_stage() -> None:
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage != _STAGE[0]:
        _STAGE[0] = stage
        for forget in _FORGET:
            forget()


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about `limit` bytes of `column` at most (one row at least): memory follows the limit, not the batch."""
    _enter_stage()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def kept_by_text(docs: DataFrame, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of docs whose texts keep() keeps (null ones as empty), all columns as they are, of whatever names: they go through the
    task under names of their own. keep() is called in tasks, with a few megabytes of text at a time."""
    names = ["text" if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(keep(binary_column(batch.column("text")).to_pylist()), pa.bool_()))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
