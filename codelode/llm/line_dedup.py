"""Operator 2: line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import small_batches

WINDOW = 3


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, digest, at): starts, from 0, of all windows that occur before, in (id, line) order over the whole table, as lists by document."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), lines.alias("lines"))
    # repeated rows have the same key: each is the same document again
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    hashes = F.transform(starts, lambda i: F.unhex(F.md5(F.concat_ws("\n", *(F.get("lines", i + k) for k in range(window))))))
    windows = keyed.where(F.size("lines") >= window).select("id", "digest", F.posexplode(hashes).alias("at", "h"))
    place = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("id"), "digest", "at")
    first = windows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("__h"), "first")
    later = windows.join(first, F.col("h") == F.col("__h")).where(place > F.col("first"))
    return later.groupBy("id", "digest").agg(F.collect_set("at").alias("at"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): every row's text without the lines that a later occurrence of a window covers.

    Lines end at line feeds and are compared unchanged; a window is three consecutive lines of one document. Windows are hashed (MD5),
    occurrences are grouped over all documents with a minimum combined before the shuffle, and joined back to find the later ones; Spark
    can split a hot window's rows there. Windows are judged on the input, not on what is left; overlapping removals merge.

    Defined cases: a null text is one empty line; documents of fewer lines than a window lose none; rows that repeat another's doc_id and
    text are treated like it; of rows with one doc_id and different texts the one with the smaller hash is earlier; null doc_ids come
    first; an empty table gives no rows; other columns are ignored.
    """
    found = repeated_windows(docs, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__digest"), F.coalesce("text", F.lit("")).alias("text"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__digest") == F.col("digest")), "left").select("doc_id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                lines = text.split("\n")
                kept = np.ones(len(lines), bool)
                for i in range(window) if at else ():
                    kept[np.array(at) + i] = False
                out.append((len(lines), int((~kept).sum()), "\n".join(lines[i] for i in np.flatnonzero(kept)) if at else text))
            n, removed, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
