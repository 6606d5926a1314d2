"""Operator 7: token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import new_path, small_batches
from codelode.llm.encoding import counts, digest_of_file

CACHE_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none if nothing has been appended yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _by_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a batch's rows, in a list for each content."""
    for batch in batches:
        lists = pa.Table.from_batches([batch]).group_by(["digest", "n_bytes"]).aggregate([("doc_id", "list")])
        yield from lists.select(["digest", "n_bytes", "doc_id_list"]).rename_columns(["digest", "n_bytes", "ids"]).combine_chunks().to_batches()


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text, ...): tokens of the whole text as the tokenizer's library gives them.

    Contents are normalised (null becomes empty; nothing else, as any other change could change the count) and named by SHA-256 digest
    and length. Digests without a count for this tokenizer version in the cache, a Parquet table at `cache`, are encoded once each and
    appended; then every row gets its count by a join with the cache. Copies of a text are combined before any shuffle: their text is one
    row of a task, and their ids travel to the join as one list a batch, so a group of copies of any size is a few rows there.

    Defined cases: a null or empty text has 0 bytes; rows with equal ids are counted each; null ids are returned as they are; an empty
    table gives no rows and appends nothing; repeated cache rows (of two runs at once) count once; other columns are ignored.
    """
    spark = docs.sparkSession
    version = digest_of_file(tokenizer)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    mine = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest", "n_bytes").agg(F.max("n_tokens").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            n = counts(tokenizer, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), batch.column("digest"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_bytes", "n_tokens"])

    contents = named.groupBy("digest", "n_bytes").agg(F.first("text").alias("text"))
    contents.join(mine, ["digest", "n_bytes"], "left_anti").mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    mine = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest", "n_bytes").agg(F.max("n_tokens").alias("n_tokens"))
    ids = named.select("doc_id", "digest", "n_bytes").mapInArrow(_by_content, "digest binary, n_bytes long, ids array<long>")
    rows = ids.join(mine, ["digest", "n_bytes"]).select(F.explode("ids").alias("doc_id"), "n_bytes", "n_tokens")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def new_cache(spark: SparkSession) -> str:
    return new_path(spark, "token-counts")
