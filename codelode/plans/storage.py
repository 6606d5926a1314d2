"""Where steps of a job are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset and all runs on one machine, as in tests, a
    new local one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="codelode-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/codelode/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "step", counted: Column | None = None) -> tuple[DataFrame, int, str]:
    """df written once as Parquet to the shared folder: the table as read from there, how many rows it has (of which `counted` is true, if
    given), and its path. Nothing of the plan that made it stays in the plans that read it, and lost executors lose nothing."""
    spark, seen = df.sparkSession, Observation()
    path = new_path(spark, what)
    df.observe(seen, F.count(F.lit(1) if counted is None else F.when(counted, 1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["rows"]), path


def stored(tables: Mapping[str, DataFrame], *names: str) -> Mapping[str, DataFrame]:
    """tables with those of `names` written once: walks and closures read their edges at every level, so these should be files."""
    return ChainMap({k: written(tables[k], k)[0] for k in names}, tables)


def together(spark: SparkSession, jobs: Mapping[str, Callable]) -> dict:
    """What each job gives; they run beside each other, as none needs another's. If one fails, the others end first."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = {k: pool.submit(inheritable_thread_target(spark)(job)) for k, job in jobs.items()}
    return {k: r.result() for k, r in running.items()}


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = file_system(spark, path)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def listed(spark: SparkSession, base: str) -> Iterator[tuple[str, bool]]:
    """(path, whether a folder) of all that is below base, empty files and folders too; folder by folder, as Spark's own file index goes."""
    fs, root = file_system(spark, base)
    waiting = [root]
    while waiting:
        for found in fs.listStatus(waiting.pop()):
            p = found.getPath()
            yield p.toUri().getPath(), found.isDirectory()
            if found.isDirectory():
                waiting.append(p)


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder with written(): to be called when its results have been used."""
    delete(spark, f"{shared_dir(spark)}/codelode/{spark.sparkContext.applicationId}")
