"""Operator 4: token ids as Parquet list columns that training jobs can read in part."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import binary_column, new_path, small_batches
from codelode.llm.encoding import REMEMBERED, id_bytes

#: Bytes of text that go into one file: the least and the most. Between them a table has about FILES files, above them as many as it takes.
LEAST_FILE, MOST_FILE, FILES = 32 << 20, 1 << 30, 1024
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 256
SCHEMA = "doc_id long, shard int, row long, start_in_shard long, n_tokens long, token_ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_bytes: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, remembered: int = REMEMBERED) -> DataFrame:
    """Encode every whole text of docs(doc_id, text) and write the ids to Parquet files at `path`, in ascending doc_id order over the files.

    A row holds doc_id, shard (the file's number; shards ascend with doc_id), row (place in the shard), start_in_shard (ids before it
    in the shard), n_tokens and token_ids. Row groups have about row_group_bytes; pages page_rows rows at most, with their minima and
    maxima in the page index, so a doc_id range reads few pages; ids are dictionary-encoded and bit-packed, the numbers delta-encoded.
    A file takes file_bytes of text; where that isn't given, more the larger the table is (32 MB up to 32 GB, 1 GB from 1 TB on).
    remembered: bytes of words whose ids a task keeps, see encoding.id_bytes().

    Defined cases: a null text is empty; an empty text is the end id alone; rows with equal doc_id are ordered by text, equal rows
    follow each other; null doc_ids come first; an empty table gives no rows; other columns are ignored. The rows go to tasks by ranges
    of (doc_id, text's hash), so many rows of one doc_id share no task. A task holds a few megabytes of text at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (file_bytes or min(max(LEAST_FILE, size // FILES), MOST_FILE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in small_batches(batches, "text", 1 << 20):
            ids = [x + np.array([end_id], "<u4").tobytes() for x in id_bytes(tokenizer, batch.column("text").to_pylist(), remembered)]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            columns = [batch.column("doc_id"), pa.array(np.full(len(ids), shard), pa.int32()), pa.array(np.arange(row, row + len(ids))), pa.array(start + ends - sizes), pa.array(sizes), lists]
            row, start = row + len(ids), start + int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "row", "start_in_shard", "n_tokens", "token_ids"])

    ordered = docs.withColumn("__h", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("doc_id"), "__h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "__h", "text").drop("__h")
    rows = ordered.mapInArrow(run, SCHEMA)
    options = {"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "row", "start_in_shard", "n_tokens")}
    rows.write.options(**options).parquet(path)
    return read_tokens(spark, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select columns and filter on doc_id to read only those columns and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """tokens with start: ids of all documents before it, in (shard, row) order.

    Only one total a shard meets in a task and is broadcast: 100,000 rows for 100 TB in files of 1 GB. Empty token files give no rows;
    rows with equal doc_id have starts of their own; other columns stay."""
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("rows"))
    before = F.expr("sum(total) over (order by shard rows between unbounded preceding and current row) - total")
    offsets = totals.select(F.col("shard").alias("__shard"), before.alias("__before"))
    return tokens.join(F.broadcast(offsets), F.col("shard") == F.col("__shard")).withColumn("start", F.col("start_in_shard") + F.col("__before")).drop("__shard", "__before")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of token files, the checksum taken from the ids read back.

    Null doc_ids are returned as they are; rows with equal doc_id are each; no rows give none; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crcs = [zlib.crc32(x) for x in np.split(ids, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(np.r_[0, ends]).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts(tokens).select("doc_id", "start", "token_ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs as token files in the shared folder and return what reading them back gives; cases as in write_tokens() and digests()."""
    return digests(write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, remembered=remembered))
