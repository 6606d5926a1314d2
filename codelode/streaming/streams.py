"""Streams: routing of one log into several, and the restartable load of fact files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.functions.expr import file_path
from codelode.operators.build import kinds_used
from codelode.operators.incremental import load_sources, loaded_names
from codelode.schema import FACTS, GRAPH
from codelode.sources.facts import read_fact_csv

# Log levels, from the least severe.
LEVELS = ("V", "D", "I", "W", "E", "F")


@dataclass(frozen=True)
class Route:
    """What a log file takes: records of `level` or worse, those of `tag` from `tag_level` on, all that match `message`, those of one process."""

    name: str
    level: str | None = None
    tag: str | None = None
    tag_level: str | None = None
    message: str | None = None
    pid: int | None = None

    def matches(self) -> Column:
        rank = lambda c: F.array_position(F.array(*(F.lit(x) for x in LEVELS)), c)
        at_least = lambda level: rank(F.col("level")) >= LEVELS.index(level) + 1
        tests = []
        if self.level is not None:
            own = at_least(self.level)
            if self.tag is not None and self.tag_level is not None:
                own = F.when(F.col("tag") == self.tag, at_least(self.tag_level)).otherwise(own)
            tests.append(own)
        if self.message is not None:
            tests.append(F.col("message").rlike(self.message))
        if self.pid is not None:
            tests.append(F.col("pid") == self.pid)
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(True)


def routed(log: DataFrame, routes: list[Route], since=None) -> DataFrame:
    """log(ts, level, tag, message, pid, ...) with `route`: a row for each route that takes a record; since: the first time taken."""
    rows = log if since is None else log.where(F.col("ts") >= since)
    taken = F.array_compact(F.array(*(F.when(r.matches(), F.lit(r.name)) for r in routes)))
    return rows.withColumn("route", F.explode(taken))


def route_log_stream(stream: DataFrame, routes: list[Route], path: str, checkpoint: str, since=None, every: str | None = None) -> StreamingQuery:
    """Write each route's records to a folder of its own, each record once: the file sink and the checkpoint see to that after a restart.

    every: how often the stream looks for new records ("10 seconds"), until it is stopped; without it, it takes what is there and ends."""
    out = routed(stream, routes, since)
    return out.writeStream.format("parquet").partitionBy("route").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"availableNow": True} if every is None else {"processingTime": every})).start()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("source string, kind string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "source string, kind string")


def ingest_sources_stream(spark: SparkSession, path: str, kind: str, out: str, checkpoint: str) -> StreamingQuery:
    """Load fact files <path>/<source>/<kind>.csv as they come, each source's kind once and whole.

    A micro-batch writes each source to a folder of its own, over what an attempt that failed has left there, and records it only then;
    a source that the ledger has is skipped."""
    stream = spark.readStream.schema(FACTS[kind]).options(header=False, quote='"', escape='"', multiLine=True, mode="FAILFAST", nullValue="\x00", emptyValue="").option("pathGlobFilter", f"{kind}.csv").option("recursiveFileLookup", "true").csv(path)
    stream = stream.withColumn("source", file_path(F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1)))

    def load(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        ledger = read_ledger(session, f"{out}/_ledger").where(F.col("kind") == kind)
        new = batch.join(ledger, "source", "left_anti").persist()
        try:
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{out}/{kind}")
            new.select("source").distinct().select("source", F.lit(kind).alias("kind")).write.mode("append").parquet(f"{out}/_ledger")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The folder beside the sources' own to which a text file is added that names sources whose fact files are all there.
ARRIVED = "_arrived"


def keep_graph_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files: int | None = None, tables: Iterable[str] | None = None) -> StreamingQuery:
    """Keep the graph at `out` up to date as sources arrive: <path>/<source>/<kind>.csv, and then a text file in <path>/_arrived that names
    them, one a line. A micro-batch takes `files` of these, or all that are there, and adds the sources that they name, whole.

    A batch that failed is tried again under its number and finds what it had finished; a source that is there is left as it is, and its
    files aren't read. tables: those of the graph that are kept; only files of facts that they are made of are read."""
    tables = list(GRAPH) if tables is None else list(tables)
    kinds = [k for k in FACTS if k in set().union(*kinds_used(tables))] or list(FACTS)
    options = {} if files is None else {"maxFilesPerTrigger": str(files)}
    stream = spark.readStream.schema("value string").options(**options).text(f"{path}/{ARRIVED}")

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        names = [r[0] for r in batch.where("value <> ''").select(F.col("value").alias("name")).distinct().join(loaded_names(session, out), "name", "left_anti").collect()]
        if names:
            facts = {kind: reduce(DataFrame.unionByName, (read_fact_csv(session, f"{path}/{n}", kind).withColumn("source", F.lit(n)) for n in names)) for kind in kinds}
            load_sources(session, out, facts, number, tables)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
