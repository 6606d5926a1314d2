"""Operator 9: SimHash near-duplicates through a table of distances to reference fingerprints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import binary_column, drop_materialized, materialize, partitions, small_batches
from codelode.llm.components import connected_components

BITS = 64
RADIUS = 2
#: Fingerprints are cut to four blocks of sixteen bits. Two within the radius differ in two blocks at most, so they agree in two at least.
BLOCKS = 4
_MASK = np.array([0xFFFF << 16 * b for b in range(BLOCKS)], np.uint64)
_PAIRS = tuple(combinations(range(BLOCKS), 2))
#: Reference fingerprints: RINGS random ones, each also with one block after another complemented, and others at random.
RINGS, PIVOTS = 6, 64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_RING = _RANDOM.integers(0, 2**64, RINGS, dtype=np.uint64)
PIVOT = np.concatenate([_RING, (_RING[:, None] ^ _MASK[None, :]).ravel(), _RANDOM.integers(0, 2**64, PIVOTS - RINGS * (1 + BLOCKS), dtype=np.uint64)])
#: Fingerprints that are compared with each other in one cell; a cell of more is hot, and its members are filed more finely.
CELL_ROWS = 2048
_BIT = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, piece: int = 1 << 18) -> int:
    words = text.lower().split()  # bytes: only A-Z are lower-cased
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    grams = iter(grams)
    while (h := np.fromiter((digest(g, seed) for g, _ in zip(grams, range(piece), strict=False)), np.uint64)).size:
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += h.size
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every pivot, a row each."""
    return np.bitwise_count(prints[:, None] ^ PIVOT[None, :]).astype(np.int8)


def cells_of(table: np.ndarray) -> np.ndarray:
    """The cells of rows of the pivot table, one for each pair of blocks, as numbers.

    The distances to a ring and to its copy with a block complemented tell how far the fingerprint is from the ring within that block:
    (d - d' + 16) / 2. A cell holds the fingerprints that are equally far from every ring in each of its two blocks."""
    ring = table[:, :RINGS].astype(np.int64)
    other = table[:, RINGS : RINGS * (1 + BLOCKS)].reshape(-1, RINGS, BLOCKS)
    within = (ring[:, :, None] - other + 16) >> 1
    number = np.zeros((table.shape[0], BLOCKS), np.int64)
    for r in range(RINGS):
        number = number << 5 | within[:, r]
    return np.stack([(k << 30 | number[:, a]) << 30 | number[:, b] for k, (a, b) in enumerate(_PAIRS)], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in its six cells."""
    for x in _chunks(batches):
        cells = cells_of(pivot_table(x))
        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(x, cells.shape[1]).view(np.int64))], ["cell", "fp"])


def _filed_finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its own value and the 64 values one bit away. Two within the radius share one of these, which holds 65 at most."""
    for x in _chunks(batches):
        names = np.concatenate([x[:, None], x[:, None] ^ _BIT[None, :]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.repeat(x, BITS + 1).view(np.int64))], ["cell", "fp"])


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as links to the smallest member: no more than there are fingerprints."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: a.size], ends[a.size :]
    root = np.arange(nodes.size)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, was[a], low)
        np.minimum.at(root, was[b], low)
        root = root[root]
        if (root == was).all():
            break
    own = root != np.arange(nodes.size)
    return nodes[own], nodes[root[own]]


def near_in_cells(cell: np.ndarray, fp: np.ndarray, radius: int = RADIUS, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints filed in one cell, as links to the smallest they lead to: at most one for each fingerprint.

    Every pair of a cell's members meets. Pairs whose distances to some pivot differ by more than the radius are discarded, as the
    distance between them can't be less than that difference; survivors are verified. seen counts pairs met, discarded and verified."""
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    keep = np.r_[True, (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])] if cell.size else np.zeros(0, bool)
    cell, fp = cell[keep], fp[keep]
    if not cell.size:
        return fp, fp
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, cell.size])
    end = np.repeat(start + size, size)
    some = np.repeat(size > 1, size)
    own = np.flatnonzero(some)
    if not own.size:
        return fp[:0], fp[:0]
    table = np.zeros((0, PIVOTS), np.int8)
    a, b = [fp[:0]], [fp[:0]]
    held = 0
    for at in range(0, own.size, 1 << 16):  # cells don't end where a piece does: partners are looked up in a piece and the CELL_ROWS after it
        first = own[at : at + (1 << 16)]
        base, last = int(first[0]), int(end[first[-1]])
        table = pivot_table(fp[base:last])
        left, step = first, 1
        while (left := left[left + step < end[left]]).size:
            for i in range(0, left.size, 1 << 14):
                x = left[i : i + (1 << 14)]
                y = x + step
                met = x.size
                for pivots in (slice(0, 8), slice(8, PIVOTS)):  # most pairs are discarded by the first few
                    close = np.abs(table[x - base, pivots] - table[y - base, pivots]).max(axis=1) <= radius
                    x, y = x[close], y[close]
                good = np.bitwise_count(fp[x] ^ fp[y]) <= radius
                if seen is not None:
                    seen.update(met=met, discarded=met - x.size, verified=int(good.sum()))
                a.append(fp[x[good]])
                b.append(fp[y[good]])
                held += int(good.sum())
            if held > 1 << 20:  # stars in place of pairs
                a, b = ([x] for x in _roots(np.concatenate(a), np.concatenate(b)))
                held = a[0].size
            step += 1
    return _roots(np.concatenate(a), np.concatenate(b))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, prints = [], []
    for batch in batches:
        cells.append(batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64))
        prints.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64))
    if cells:
        a, b = near_in_cells(np.concatenate(cells), np.concatenate(prints).view(np.uint64))
        if a.size:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a fine cell are within the radius of each other: one link each."""
    cells, prints = [], []
    for batch in batches:
        cells.append(batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64))
        prints.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64))
    if cells:
        cell, fp = np.concatenate(cells), np.concatenate(prints).view(np.uint64)
        order = np.argsort(cell, kind="stable")
        same = np.flatnonzero(cell[order][1:] == cell[order][:-1])
        a, b = _roots(fp[order][same], fp[order][same + 1])
        if a.size:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, digest long: of the text, fp long) of every row; null texts count as empty, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in binary_column(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("digest"), pa.array(prints.view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, "doc_id long, digest long, fp long")


def link_fingerprints(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct values of prints(fp long) at two or fewer differing bits, enough of them to join all that belong together.

    Every distinct fingerprint is filed by its row of the pivot table in six cells, of which two fingerprints within the radius share one at
    least. In a cell pairs are discarded by the largest difference of their distances to the pivots and survivors verified. Members of a
    cell of more than cell_rows, as a large group of near copies makes, are filed under their one-bit neighbours instead, of which 65
    at most meet: no pair is lost. Cells are counted before they are gathered, so no task gets a large one, and tasks return stars, never all pairs.
    """
    spark = prints.sparkSession
    filed = materialize(prints.select("fp").distinct().mapInArrow(_filed, "cell long, fp long"), "cells")
    sizes = materialize(filed.groupBy("cell").count().where(F.col("count") > 1), "cell-sizes")
    rows, members = sizes.agg(F.sum("count"), F.sum(F.when(F.col("count") > cell_rows, F.col("count")))).first()
    if not rows:
        return spark.createDataFrame([], "a long, b long")
    shared = filed.join(sizes.where(F.col("count") <= cell_rows), "cell", "left_semi")
    links = shared.repartition(partitions(spark, rows - (members or 0), 1 << 18), "cell").mapInArrow(_linked, "a long, b long")
    if members:
        fine = filed.join(sizes.where(F.col("count") > cell_rows), "cell", "left_semi").select("fp").distinct().mapInArrow(_filed_finely, "cell long, fp long")
        links = links.unionByName(fine.repartition(partitions(spark, members * (BITS + 1), 1 << 20), "cell").mapInArrow(_starred, "a long, b long"))
    links = materialize(links, "near")
    drop_materialized(filed)
    drop_materialized(sizes)
    return links


def _near_duplicates(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, digest, fp, component_id) of every row, see near_duplicates."""
    prints = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    groups = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    links = link_fingerprints(groups)
    roots = connected_components(links)
    drop_materialized(links)
    rooted = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # written, so that Spark can split a large component's side of the join
    component = materialize(rooted.join(least, "root").select("fp", "component_id"), "components")
    drop_materialized(groups)
    known = prints.where("doc_id is not null").join(component, "fp")
    lone = prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    return known.unionByName(lone).select("doc_id", "digest", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Fingerprint and component of every row of docs(doc_id, text, ...): doc_id, fp long, fingerprint string, component_id long.

    Defined cases: a null or blank text has fingerprint 0 and is linked like any other; a text of fewer words than a shingle is one
    shingle; rows with equal doc_id are each returned; a null doc_id gets its fingerprint, a null component_id and links nothing; an
    empty table gives no rows; other columns of docs are ignored.
    """
    return _near_duplicates(docs, shingle, seed).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs with one document of each component_id: that of the smallest doc_id. Rows without a doc_id stay all.

    Of rows that share that doc_id, the one of the least fingerprint (then digest of the text) among those in the component stays; rows
    of that doc_id whose texts are near a document with a smaller one go. Where texts of one doc_id lead several groups, these have one
    component_id and one row stays for all of them. Other columns stay as they are, of whatever names.
    """
    found = _near_duplicates(docs, shingle, seed)
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min(F.struct("fp", "digest")).alias("best"))
    kept = kept.select(F.col("doc_id").alias("id"), F.col("best.digest").alias("digest"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    one = rows.where("id is not null").join(kept, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    return one.unionByName(rows.where("id is null")).select("row.*")
