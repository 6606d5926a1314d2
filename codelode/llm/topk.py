"""Operator 1: exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import materialize

#: Vectors in a shard, and queries in a block: a tile's scores take 8 * SHARD * BLOCK bytes.
SHARD, BLOCK = 4096, 512
#: Shards of a group and blocks of a range, which meet in one task; partial lists that one merge takes.
SHARDS_IN_GROUP, BLOCKS_IN_RANGE, FAN_IN = 64, 64, 16
_PACKED = "seq long, width int, item int, ids binary, cells binary"


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinity."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _pack(size: int):
    """Vectors of a task in matrices of at most `size` rows of one width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            width = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.r_[0, np.cumsum(width)[:-1]]
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                for at in range(0, rows.size, size):
                    part = rows[at : at + size]
                    cells = flat[start[part][:, None] + np.arange(w)]
                    item = next(i for i in (2, 4, 8) if i == 8 or (cells >= -(2 ** (8 * i - 1))).all() and (cells < 2 ** (8 * i - 1)).all())
                    seq = int(np.bitwise_xor.reduce(ids[part] * 31 + part) & 0x7FFFFFFFFFFF)
                    yield pa.RecordBatch.from_pylist([{"seq": seq, "width": int(w), "item": item, "ids": ids[part].tobytes(), "cells": cells.astype(f"<i{item}").tobytes()}], schema=pa.schema([("seq", pa.int64()), ("width", pa.int32()), ("item", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())]))

    return run


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer rows: in floats or doubles where no sum can pass 2 ** 24 or 2 ** 53, else in 64-bit integers, else in Python's."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = q.astype(object) @ c.astype(object).T
    return exact.astype(np.int64)  # a score beyond a long raises OverflowError


def _tile(k: int):
    """The k best candidates of each query of a tile, ties to the smaller vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                order = np.argsort(c_ids, kind="stable")
                c_ids, w = c_ids[order], r["width"]
                c = np.frombuffer(r["cells"], f"<i{r['item']}").reshape(-1, w)[order]
                scores = product(np.frombuffer(r["q_cells"], f"<i{r['q_item']}").reshape(-1, w), c)
                own = q_ids[:, None] == c_ids[None, :]
                few = min(k + int(own.sum(axis=1).max(initial=0)), c_ids.size)
                kth = np.partition(scores, c_ids.size - few, axis=1)[:, c_ids.size - few]
                row, col = np.nonzero((scores >= kth[:, None]) & ~own)
                best = np.lexsort((c_ids[col], -scores[row, col], row))
                row, col = row[best], col[best]
                rank = np.arange(row.size) - np.searchsorted(row, row)
                row, col = row[rank < k], col[rank < k]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(np.full(row.size, r["part"], np.int64)), pa.array(-scores[row, col]), pa.array(c_ids[col])], ["query_id", "part", "less", "vec_id"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query vector with every other row, ties to the smaller vec_id.

    Components become floor(scale * x), in as few bytes as hold them. Rows are packed to shards of `shard` vectors, queries to blocks of
    `block`. Groups of shards meet ranges of blocks by a join on the numbers of both, so a task's work is bounded whatever the number of
    rows or queries; each pair of a shard and a block is one matrix product that keeps k candidates a query. The partial lists are
    merged as a tree: at most FAN_IN lists of k meet at a step, whatever the number of shards.

    Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without vec_id; vectors
    of another length than the query's are no candidates; rows with the query's own vec_id are not its candidates, other repeated rows
    are each; a query_id that occurs on several rows gets the best of all; no queries or candidates give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding")) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    v = quantized(F.col("embedding"), scale).alias("v")
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    groups = max(1, -(-n // (shard * SHARDS_IN_GROUP)), min(-(-n // shard), spark.sparkContext.defaultParallelism))
    ranges = max(1, -(-asked // (block * BLOCKS_IN_RANGE)))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    packed = rows.select("vec_id", v).mapInArrow(_pack(shard), _PACKED).withColumn("part", F.pmod(F.xxhash64("seq", "ids"), F.lit(groups)))
    packed = packed.select("part", "ids", "cells", "width", "item", every(ranges).alias("range"))
    blocks = rows.where(is_query).select("vec_id", v).mapInArrow(_pack(block), _PACKED).withColumn("range", F.pmod(F.xxhash64("seq", "ids"), F.lit(ranges)))
    blocks = blocks.select("range", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("width").alias("q_width"), F.col("item").alias("q_item"), every(groups).alias("part"))
    tiles = blocks.join(packed, ["part", "range"]).where("width = q_width").select("part", "q_ids", "q_cells", "q_item", "ids", "cells", "item", "width")
    found = tiles.mapInArrow(_tile(k), "query_id long, part long, less long, vec_id long")
    lists = found.groupBy("query_id", "part").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "vec_id"))), 1, k).alias("best"))
    left = groups
    while left > 1:
        lists = lists.groupBy("query_id", F.floor(F.col("part") / FAN_IN).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        left = -(-left // FAN_IN)
    out = materialize(lists, "top-lists").select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))
