"""Operator 12: MinHash near-dedup by an inverted join on signature coordinates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import binary_column, drop_materialized, materialize, partitions, small_batches
from codelode.llm.components import connected_components
from codelode.llm.wordhash import mix, run_hashes, word_hashes

SHINGLE = 2
#: Documents link if PERCENT * (size of the union) <= 100 * (size of the intersection).
PERCENT = 80
#: Coordinates of a signature, and how many two must have in common to be compared. Of pairs at 0.80 just one in 3,000,000 has fewer.
COORDINATES, MATCHES = 64, 34
#: Posts that two documents with MATCHES in common can't both avoid, in any fixed order of all posts.
PREFIX = COORDINATES - MATCHES + 1
#: Members of a cell that meet in one task, and their bytes; a cell of more is dealt out in tiles.
CELL_ROWS, CELL_BYTES = 1024, 16 << 20
#: Members that one task compares with their cell's pivot.
STAR_ROWS = 256
#: The most bits of the filter that tells which texts are read again.
FILTER_BITS = 1 << 26
_RANDOM = np.random.Generator(np.random.PCG64(20241203))
_FACTOR = _RANDOM.integers(0, 2**63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0x9FB21C651E98DF25)
_BIT = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; of fewer words, one for all of them; of none, none."""
    words = word_hashes(text, lower=True)
    if 0 < words.size < shingle:
        return mix(run_hashes(words, words.size) + np.uint64(words.size))
    return np.unique(run_hashes(words, shingle))


def signature(found: np.ndarray, piece: int = 4096) -> np.ndarray:
    """The least value of each of the coordinates' hash functions over a set, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, found.size, piece):
        x = found[None, at : at + piece] * _FACTOR
        x ^= x >> np.uint64(32)
        x *= _SPREAD
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        sets = [shingle_set(t.as_py()) for t in binary_column(batch.column("text"))]
        columns = [batch.column("doc_id"), batch.column("row"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.size for s in sets], pa.int64()), pa.array([signature(s).tobytes() if s.size else b"" for s in sets], pa.binary())]
        columns.append(pa.array([x[::4] for x in columns[-1].to_pylist()], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "n", "signature", "brief"])


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each coordinate and its value: coordinates are the upper half of the key."""
    coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            if part.num_rows:
                values = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((values | coordinate).ravel()), pa.array(np.repeat(part.column("node").to_numpy(), COORDINATES))], ["key", "node"])


def candidate_groups(brief: np.ndarray) -> np.ndarray:
    """Members of a cell, a row of one byte a coordinate each, by the first of those they lead to through pairs with MATCHES bytes in common.

    Coordinates that match do so in their bytes, so no pair with MATCHES coordinates in common is torn apart."""
    group = np.full(len(brief), -1)
    while (left := np.flatnonzero(group < 0)).size:
        first, reached = left[0], left[:1]
        group[first] = first
        left = left[1:]
        while reached.size and left.size:
            new = (brief[left] == brief[reached[0]]).sum(axis=1) >= MATCHES
            group[left[new]] = first
            reached, left = np.r_[reached[1:], left[new]], left[~new]
    return group


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node): the groups of each cell that have more than one member, with their smallest as pivot."""
    rows = ((k, n, b) for batch in batches for k, n, b in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "brief")), strict=True))
    out: list[tuple[int, int, int]] = []
    for key, cell in groupby(rows, key=lambda r: r[0]):
        _, node, brief = zip(*cell, strict=True)
        group = candidate_groups(np.frombuffer(b"".join(brief), np.uint8).reshape(-1, COORDINATES))
        many = np.bincount(group, minlength=group.size)[group] > 1
        out += [(key, node[g], node[i]) for i, g in zip(np.flatnonzero(many).tolist(), group[many].tolist(), strict=True)]
        if len(out) > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "pivot", "node"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "pivot", "node"])


# Members of a cell are told by how their sets differ from that of the cell's pivot: hashes that are more, and places in it that are missing.


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivot, last = (None, None, None), None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own = np.frombuffer(r["found"], "<u8")
            if r["kind"] == 0:
                pivot = (r["pivot"], r["part"], own)
            elif (r["pivot"], r["node"]) != last:
                last = (r["pivot"], r["node"])
                base = pivot[2]
                same = np.isin(own, base, assume_unique=True)
                gone = np.flatnonzero(~np.isin(base, own, assume_unique=True)).astype("<u4")
                both = int(same.sum())
                near = 100 * both >= PERCENT * (own.size + base.size - both)
                out.append((r["pivot"], r["node"], own.size, base.size, near, own[~same].tobytes(), gone.tobytes(), r["signature"], r["mask"]))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["pivot", "node", "n", "base", "near", "more", "gone", "signature", "mask"])


def _flat(parts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.cumsum(size) - size, size


def _within(flat: np.ndarray, start: np.ndarray, size: np.ndarray, some: np.ndarray, test) -> np.ndarray:
    """How many entries of each of some ragged rows pass the test."""
    n = size[some]
    ends = np.cumsum(n)
    at = np.repeat(start[some] - (ends - n), n) + np.arange(ends[-1] if ends.size else 0)
    return np.diff(np.r_[0, np.r_[0, np.cumsum(test(flat[at]))][ends]])


def links_in_cell(coordinate: int, rows: list[dict], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between members `right`, of which none is near the pivot, and members `left` (of two on the right, the later with the earlier),
    enough of them to join what belongs together: one that is in a document's component already is not compared with it.

    A pair is compared in the first cell that both are in, if enough coordinates match and neither sizes nor distances from the pivot
    (Jaccard distance is a metric) rule it out; the intersection is counted from both members' differences from the pivot."""
    n, base = np.array([r["n"] for r in rows]), rows[0]["base"]
    near = np.array([r["near"] for r in rows])
    more, more_at, more_n = _flat([r["more"] for r in rows], "<u8")
    gone, gone_at, gone_n = _flat([r["gone"] for r in rows], "<u4")
    both = base - gone_n
    far = 1 - both / (n + base - both)
    signatures = np.frombuffer(b"".join(r["signature"] for r in rows), "<u4").reshape(-1, COORDINATES)
    inside = (np.array([r["mask"] for r in rows], np.int64).view(np.uint64)[:, None] & _BIT[None, :]) != 0
    component = np.where(near, -1, np.arange(n.size))
    slack, out = 1 - PERCENT / 100 + 1e-9, []
    is_right = np.zeros(n.size, bool)
    is_right[right] = True
    for z in right.tolist():
        some = left[(component[left] != component[z]) & ((left < z) | ~is_right[left])]
        some = some[(100 * np.minimum(n[some], n[z]) >= PERCENT * np.maximum(n[some], n[z])) & (np.abs(far[some] - far[z]) <= slack)]
        if not some.size:
            continue
        equal = signatures[some] == signatures[z]
        matches = equal.sum(axis=1)
        some, equal, matches = (x[matches >= MATCHES] for x in (some, equal, matches))
        shared = equal & inside[some] & inside[z]
        own = shared.argmax(axis=1) == coordinate
        some = some[own][np.argsort(-matches[own], kind="stable")]
        mark = np.zeros(base, bool)
        mark[gone[gone_at[z] : gone_at[z] + gone_n[z]]] = True
        has = more[more_at[z] : more_at[z] + more_n[z]]
        while some.size:
            part, some = some[:64], some[64:]
            gone_in_both = _within(gone, gone_at, gone_n, part, lambda x: mark[x])  # noqa: B023
            common = base - gone_n[z] - gone_n[part] + gone_in_both
            if has.size:
                common = common + _within(more, more_at, more_n, part, lambda x: has[np.minimum(np.searchsorted(has, x), has.size - 1)] == x)  # noqa: B023
            for y in part[100 * common >= PERCENT * (n[part] + n[z] - common)].tolist():
                if component[y] != component[z]:
                    out.append((rows[z]["node"], rows[y]["node"]))
                    component[component == component[z]] = component[y]
            some = some[component[some] != component[z]]
    return out


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, pivot, kind, a, b): whole cells (kind 0), members near the pivot with others (1), others of one tile (2) or two (3)."""
    rows = (r for batch in batches for r in batch.to_pylist())
    out: list[tuple[int, int]] = []
    for (key, _, kind, *_), cell in groupby(rows, key=lambda r: (r["key"], r["pivot"], r["kind"], r["a"], r["b"])):
        cell = list(cell)
        every = np.arange(len(cell))
        near, side = np.array([r["near"] for r in cell]), np.array([r["side"] for r in cell])
        if kind in (0, 2):
            left, right = every, every[~near]
        else:
            left, right = every[side == 0], every[side == 1]
        if left.size and right.size:
            out += links_in_cell(key >> 32, cell, left, right)
        if len(out) > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _filter(active: DataFrame, bits: int) -> np.ndarray:
    """A bit for each slot that an active document's id falls in: bits / 8 bytes, whatever the number of documents."""
    slot = F.pmod(F.xxhash64("least"), F.lit(bits))
    words = active.select(slot.alias("slot")).groupBy(F.expr("slot div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))"))
    out = np.zeros(bits // 32, np.uint32)
    for word, bit in words.collect():
        out[word] = bit
    return out


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(node, key): the posts of each node's prefix that others have too. Posts are ordered by how many nodes have them, so that those of
    passages and phrases in many documents come last and are skipped by any node with enough others."""
    posts = nodes.select("node", "signature").mapInArrow(_posts, "key long, node long")
    shared = materialize(posts.groupBy("key").count().where(F.col("count") > 1), "shared")
    hits = posts.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("count", "key")).alias("hits"))
    hits = hits.where(F.size("hits") > COORDINATES - PREFIX)
    return materialize(hits.select("node", F.explode(F.slice(F.array_sort("hits"), 1, F.size("hits") - (COORDINATES - PREFIX))).alias("hit")).select("node", "hit.key"), "prefixes")


def _names() -> list:
    """What tells sets of nodes apart."""
    return [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit("y"))).alias("y")]


def _once(cells: DataFrame) -> DataFrame:
    """Of cells(key, pivot, rows, x, y) of the same members the one of the smallest key."""
    return cells.groupBy("rows", "pivot", "x", "y").agg(F.min("key").alias("key")).select("key", "pivot", "rows")


def _links(docs: DataFrame, nodes: DataFrame, cell_rows: int, cell_bytes: int) -> DataFrame:
    """(a, b): links between nodes, enough of them to join all that belong together."""
    spark = docs.sparkSession
    prefixes = _prefixes(nodes)
    sizes = prefixes.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("pivot"), *_names()).where("rows > 1")
    cells = prefixes.join(_once(sizes), "key").select("key", "pivot", "node", "rows")
    cells = materialize(cells, "cells")
    small = cells.where(F.col("rows") <= cell_rows).join(nodes.select("node", "brief"), "node").select("key", "node", "brief")
    small = small.repartition(partitions(spark, cells.count(), 1 << 17), "key").sortWithinPartitions("key", "node").mapInArrow(_screened, "key long, pivot long, node long")
    found = materialize(small.unionByName(cells.where(F.col("rows") > cell_rows).select("key", "pivot", "node")), "screened")
    sizes = found.groupBy("key", "pivot").agg(F.count("*").alias("rows"), *_names())
    members = materialize(found.join(_once(sizes).select("key", "pivot"), ["key", "pivot"]).select("key", "pivot", "node"), "members")
    drop_materialized(cells)
    drop_materialized(found)
    masks = prefixes.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) as int)))").alias("mask"))
    active = materialize(members.select("node").distinct().join(masks, "node").join(nodes.select("node", "least", "digest"), "node"), "active")
    drop_materialized(prefixes)
    n = active.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    known = spark.sparkContext.broadcast(_filter(active, bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((known.value[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool)))
            found = [shingle_set(t.as_py()).tobytes() for t in binary_column(batch.column("text"))]
            signatures = [signature(np.frombuffer(s, np.uint64)).tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "digest", "found", "signature"])

    texts = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("slot"))
    texts = texts.mapInArrow(sets, "doc_id long, digest binary, found binary, signature binary").withColumnRenamed("digest", "of")
    held = texts.join(active, (texts.doc_id == active.least) & (texts.of == active.digest)).select("node", "mask", "found", "signature")
    held = materialize(held, "sets")
    stars = members.select("pivot", "node").distinct()
    pivots = stars.groupBy("pivot").agg(F.expr(f"(count(*) + {STAR_ROWS - 1}) div {STAR_ROWS}").alias("parts"))
    own = stars.join(pivots, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(held, "node")
    fields = ("pivot", "part", "node", "mask", "found", "signature")
    own = own.select(F.lit(1).alias("kind"), *fields)
    first = pivots.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(held, F.col("node") == F.col("pivot")).select(F.lit(0).alias("kind"), *fields)
    both = own.unionByName(first).repartition(partitions(spark, n, 1 << 14), "pivot", "part").sortWithinPartitions("pivot", "part", "kind", "node")
    away = materialize(both.mapInArrow(_differences, "pivot long, node long, n long, base long, near boolean, more binary, gone binary, signature binary, mask long"), "differences")
    drop_materialized(held)
    sizes = members.join(away.select("pivot", "node", (F.octet_length("more") + F.octet_length("gone") + 4 * COORDINATES).alias("bytes"), "near"), ["pivot", "node"])
    sizes = sizes.groupBy("key", "pivot").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.when(~F.col("near"), 1)).alias("others")).where("others > 0")
    tiles = F.greatest(F.expr(f"(rows + {cell_rows - 1}) div {cell_rows}"), F.expr(f"(bytes + {cell_bytes - 1}) div {cell_bytes}"))
    tiled = members.join(sizes.select("key", "pivot", tiles.alias("tiles")), ["key", "pivot"]).join(away, ["pivot", "node"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")))
    upto = "transform(sequence(0L, tiles - 1), x -> named_struct('kind', 1, 'a', {}, 'b', {}, 'side', {}))"
    other = f"""concat({upto.format("x", "t", 1)}, transform(sequence(t, tiles - 1), x -> named_struct('kind', if(x = t, 2, 3), 'a', t, 'b', x, 'side', 0)),
      transform(filter(sequence(0L, t), x -> x < t), x -> named_struct('kind', 3, 'a', x, 'b', t, 'side', 1)))"""
    meet = f"CASE WHEN tiles = 1 THEN array(named_struct('kind', 0, 'a', 0L, 'b', 0L, 'side', 0)) WHEN near THEN {upto.format('t', 'x', 0)} ELSE {other} END"
    columns = ("node", "n", "base", "near", "more", "gone", "signature", "mask")
    met = tiled.select("key", "pivot", F.explode(F.expr(meet)).alias("m"), *columns).select("key", "pivot", "m.*", *columns)
    met = met.repartition(partitions(spark, n, 1 << 13), "key", "pivot", "kind", "a", "b").sortWithinPartitions("key", "pivot", "kind", "a", "b")
    found = met.mapInArrow(_cell_links, "a long, b long")
    out = materialize(found.unionByName(away.where("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "links")
    for df in (members, active, away):
        drop_materialized(df)
    return out


def near_duplicates(docs: DataFrame, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text): components of documents whose sets of distinct two-word
    shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more.

    Documents of equal sets are one node. A node is posted under each coordinate of its signature with its value; how many nodes share
    a post orders all posts, and the first PREFIX of a node's are where partners can be met: two with MATCHES coordinates in common share
    one of these at least. Of a cell those members stay that lead to each other through pairs with MATCHES coordinates in common; only
    their texts are read again. They are compared with the smallest of them, the pivot, first; those near it are joined with it at once, so a group of near copies costs its size, and only others are compared with members of other components. Large cells
    are dealt out in tiles. Matching is by 64-bit hashes of shingles, links by whole sets. Of pairs at just 0.8 one in 3,000,000
    (calculated) has fewer than MATCHES coordinates in common and is not met; of more similar ones fewer.

    Defined cases: a null or blank text has no shingles, links with nothing and is its own component; a text of one word is one shingle;
    rows with equal doc_id are each returned and each link; a null doc_id links with nothing and has a null component_id and kept; an
    empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    prints = materialize(rows.mapInArrow(_signed, "doc_id long, row long, digest binary, n long, signature binary, brief binary"), "signatures")
    linking = prints.where("n > 0 and doc_id is not null")
    classes = linking.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row").alias("lead"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = materialize(linking.select("row", "signature", "brief").join(classes, F.col("row") == F.col("lead")).select("node", "least", "digest", "signature", "brief"), "nodes")
    links = _links(docs, nodes, cell_rows, cell_bytes)
    roots = connected_components(links)
    rooted = materialize(classes.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    component = materialize(rooted.join(least, "root").select("digest", "component_id"), "components")
    for df in (nodes, classes):
        drop_materialized(df)
    joined = linking.select("doc_id", "n", "digest").join(component, "digest").select("doc_id", "n", "component_id")
    alone = prints.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
