"""Folder listings as a Spark job: tasks take folders, list so many of them, and hand on what is left to the next round's tasks. Files for
rows, written by the tasks that hold them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.plans.storage import file_system, listed, written

#: Folders that a task lists in a round; those it has met besides are dealt out anew, so a small tree takes one round.
FOLDERS = 2000
#: Folders that a task takes at the start of a round, and entries in an Arrow batch.
SHARE, BATCH = 64, 10_000

_ROW = pa.schema([("path", pa.string()), ("depth", pa.int32()), ("folder", pa.bool_()), ("open", pa.bool_())])
SCHEMA = "path string, depth int, folder boolean, open boolean"


def _uri(text: str) -> str:
    """Hadoop writes file:/x, others file:///x."""
    return re.sub("^file:/+", "file:///", text)


def _list(batches: Iterator[pa.RecordBatch], scheme: str, max_depth: int | None, folders: int) -> Iterator[pa.RecordBatch]:
    """What the folders (path, depth) hold, their folders' contents too; the folders met and not listed come as open."""
    waiting = [(p, d) for b in batches for p, d in zip(b.column("path").to_pylist(), b.column("depth").to_pylist(), strict=True)]
    if not waiting:
        return
    files, rows, done = pafs.FileSystem.from_uri(f"{scheme}/")[0], [], 0
    while waiting and done < folders:
        path, depth = waiting.pop()
        done += 1
        for found in files.get_file_info(pafs.FileSelector(path)):
            folder = found.type == pafs.FileType.Directory
            if re.fullmatch(r"\..*\.crc", found.base_name):
                continue  # Hadoop's own check sums, which its listings leave out
            rows.append((found.path, depth + 1, folder, False))
            if folder and (max_depth is None or depth + 1 < max_depth):
                waiting.append((found.path, depth + 1))
        while len(rows) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:BATCH]), _ROW.types)], schema=_ROW)
            rows = rows[BATCH:]
    rows += [(p, d, True, True) for p, d in waiting]
    for i in range(0, len(rows), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + BATCH]), _ROW.types)], schema=_ROW)


def _opened(spark: SparkSession, base: str) -> tuple[str, str, str | None]:
    """A folder's scheme, its path, and its path for pyarrow; None for the last if pyarrow can't open it."""
    system, root = file_system(spark, base)
    root = system.getFileStatus(root).getPath().toUri()
    scheme = _uri(f"{root.getScheme()}://{root.getAuthority() or ''}")
    scheme = "file://" if root.getScheme() == "file" else scheme
    start = root.getPath().rstrip("/") or "/"
    try:
        return scheme, start, pafs.FileSystem.from_uri(f"{scheme}{start}")[1]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return scheme, start, None


def list_tree(spark: SparkSession, base: str, max_depth: int | None = None, folders: int = FOLDERS) -> DataFrame:
    """(path, depth, folder) of all that is below base, empty files and folders too, each once. Folders below max_depth are not listed.

    Rounds follow the number of folders, not the depth, and nothing but a count a round comes to the driver. A file system that pyarrow
    can't open is listed through Spark's own, folder by folder, from the driver. A base that isn't there is an error."""
    scheme, start, path = _opened(spark, base)
    if path is None:
        rows = [(p, p[len(start) :].strip("/").count("/") + 1, folder) for p, folder in listed(spark, base)]
        df = spark.createDataFrame(rows, "path string, depth int, folder boolean")
        return df if max_depth is None else df.where(F.col("depth") <= max_depth)
    front, found, files = spark.createDataFrame([(path, 0)], "path string, depth int"), 1, []
    while found:
        tasks = max(1, min(-(-found // SHARE), 10 * spark.sparkContext.defaultParallelism))
        rows = front.repartition(tasks).mapInArrow(partial(_list, scheme=scheme, max_depth=max_depth, folders=folders), SCHEMA)
        rows, found, file = written(rows, "listing", F.col("open"))
        front = rows.where("open").select("path", "depth")
        files.append(file)
    return spark.read.schema(SCHEMA).parquet(*files).where(~F.col("open")).drop("open")


def write_files(rows: DataFrame, base: str, name: str) -> bool:
    """rows(k, text), one for each k, as files <base>/k=<k>/<name> with a line end after the text; k is escaped as Spark names folders. A task
    writes the files of its rows, each complete before it gets its name. False, with nothing written, where pyarrow can't open the file system."""
    spark = rows.sparkSession
    system, root = file_system(spark, base)
    system.mkdirs(root)
    scheme, _, path = _opened(spark, base)
    if path is None:
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, unfinished, done = pafs.FileSystem.from_uri(f"{scheme}/")[0], f".{TaskContext.get().taskAttemptId()}", 0
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                folder = f"{path}/k=" + re.sub("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]", lambda m: f"%{ord(m.group()):02X}", k)
                files.create_dir(folder)
                with files.open_output_stream(f"{folder}/{unfinished}") as out:
                    out.write(f"{text}\n".encode())
                files.move(f"{folder}/{unfinished}", f"{folder}/{name}")
            done += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["files"])

    few = rows.select(F.col("k").cast("string").alias("k"), "text").repartition(spark.sparkContext.defaultParallelism)
    few.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    return True
