"""Operator 13: a Merkle tree over the rows of a dataset whose parents keep their hash state before each child slot.

A digest's hex text is one block of SHA-256, so the state between two children is 32 bytes. Folding a replaced child resumes the state
kept before its slot and hashes the replacement and the siblings to its right; what lies to its left is never hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import sha
from codelode.llm.common import drop_materialized, materialize, partitions

WIDTH = 8
#: Levels that one task works out for a block of WIDTH ** DEPTH nodes, which meet in it; the blocks' tops are the next round's nodes.
DEPTH = 3
BLOCK = WIDTH**DEPTH
#: Nodes of whole blocks whose hashes are worked out together.
TOGETHER = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIZE = sha.DIGEST


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _field(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256, as 32 bytes, of the five fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    fields = (doc_id.cast("long").cast("string"), source, lang, n_chars.cast("long").cast("string"), text)
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _SIZE)


def _levels(total: int) -> int:
    """Levels of a block that become parents, in a group of so many nodes."""
    n = 0
    while n < DEPTH and -(-total // WIDTH**n) > 1:
        n += 1
    return n


# A block's tree is, level by level from its nodes up, their digests followed by the state of each one's parent before its slot.


def _raised(digests: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level up in blocks of the given sizes that follow each other: parents' digests, their number in each block, and the state before each child."""
    above = -(-sizes // WIDTH)
    ends = np.cumsum(sizes)
    block = np.repeat(np.arange(sizes.size), above)
    first = (ends - sizes)[block] + WIDTH * (np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above))
    count = np.minimum(WIDTH, ends[block] - first)
    words, kept = sha.hex_blocks(digests), np.empty((digests.shape[0], 8), np.uint32)
    state = np.tile(sha.START, (first.size, 1))
    for slot in range(WIDTH):
        at = np.flatnonzero(count > slot)
        kept[first[at] + slot] = state[at]
        state[at] = sha.absorb(state[at], words[first[at] + slot])
    return sha.ended(state, count), above, sha.to_bytes(kept)


def grown(digests: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The trees and the tops of blocks of nodes; levels: how far each block is to be raised."""
    trees, tops = [[] for _ in sizes], np.empty((sizes.size, _SIZE), np.uint8)
    own, at = np.arange(sizes.size), sizes
    for level in range(DEPTH + 1):
        starts = np.cumsum(at) - at
        done = levels[own] == level
        tops[own[done]] = digests[starts[done]]
        stay = np.repeat(~done, at)
        digests, own, at = digests[stay], own[~done], at[~done]
        if not own.size:
            break
        above, many, kept = _raised(digests, at)
        for b, x in zip(own.tolist(), np.cumsum(at).tolist(), strict=True):
            n = int(at[np.searchsorted(own, b)])
            trees[b] += [digests[x - n : x].tobytes(), kept[x - n : x].tobytes()]
        digests, at = above, many
    return [b"".join(t) for t in trees], tops


def _unpacked(tree: bytes, size: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(digests, states) of each level of a block's tree."""
    flat, out, at = np.frombuffer(tree, np.uint8).reshape(-1, _SIZE), [], 0
    for _ in range(levels):
        out.append((flat[at : at + size], flat[at + size : at + 2 * size]))
        at, size = at + 2 * size, -(-size // WIDTH)
    return out


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block, in tables of whole blocks; a row with head = true begins one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.flatnonzero(batch.column("head").to_numpy(zero_copy_only=False))
        if n >= TOGETHER and heads.size:
            held.append(batch.slice(0, int(heads[-1])))
            yield pa.Table.from_batches(held)
            held, n = [], 0
            batch = batch.slice(int(heads[-1]))
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_blocks(batches):
        head = np.flatnonzero(table.column("head").to_numpy())
        sizes = np.diff(np.r_[head, table.num_rows])
        firsts = table.take(pa.array(head))
        totals = firsts.column("total").to_numpy()
        trees, tops = grown(_matrix(table.column("digest")), sizes, np.array([_levels(t) for t in totals.tolist()]))
        columns = [firsts.column("g").combine_chunks(), firsts.column("block").combine_chunks(), pa.array(totals), pa.array(sizes, pa.int32()), pa.array(trees, pa.binary()), pa.array([x.tobytes() for x in tops], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["g", "block", "total", "size", "tree", "top"])


# A path is what lies above a node, level by level: slot, number of children, state before the slot, the children's digests.


def _step(digests: np.ndarray, states: np.ndarray, node: int) -> bytes:
    run = digests[node - node % WIDTH : node - node % WIDTH + WIDTH]
    return bytes([node % WIDTH, len(run)]) + states[node].tobytes() + run.tobytes()


def _steps(path: bytes) -> list[tuple[int, int, bytes, bytes]]:
    out, at = [], 0
    while at < len(path):
        n = path[at + 1]
        out.append((path[at], n, path[at + 2 : at + 2 + _SIZE], path[at + 2 + _SIZE : at + 2 + _SIZE * (n + 1)]))
        at += 2 + _SIZE * (n + 1)
    return out


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each node of a block, from the path of its top."""
    for batch in batches:
        for r in batch.to_pylist():
            levels = _unpacked(r["tree"], r["size"], _levels(r["total"]))
            paths = [b"".join(_step(d, s, i // WIDTH**k) for k, (d, s) in enumerate(levels)) + r["path"] for i in range(r["size"])]
            n = len(paths)
            columns = [pa.array([r["g"]] * n, pa.string()), pa.array(r["block"] * BLOCK + np.arange(n)), pa.array(paths, pa.binary()), pa.array([r["subroot"]] * n, pa.binary()), pa.array([r["root"]] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "pos", "path", "subroot", "root"])


def _folded(place: np.ndarray, digest: np.ndarray, slot: np.ndarray, count: np.ndarray, state: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Parents' digests with the digest in the slot of place's run: the state kept there, the replacement, right siblings. Equal cases are hashed once."""
    _, first, every = np.unique(np.concatenate([place[:, None].astype(">u8").view(np.uint8).reshape(-1, 8), digest], axis=1), axis=0, return_index=True, return_inverse=True)
    place, digest = place[first], digest[first]
    slot, count = slot[place], count[place]
    now = sha.absorb(sha.from_bytes(state[place]), sha.hex_blocks(digest))
    for k in range(1, WIDTH):
        at = np.flatnonzero(slot < k)
        at = at[count[at] > k]
        if at.size:
            now[at] = sha.absorb(now[at], sha.hex_blocks(run[place[at], k]))
    return sha.ended(now, count)[every.ravel()]


def _others(run: bytes, slot: int) -> bytes:
    """Hex text of a run without one child."""
    return run[: 64 * slot] + run[64 * (slot + 1) :]


def fold_blocks(sizes: list[int], levels: list[int], trees: list[bytes], paths: list[bytes], now: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The root that each node's replacement leads to, and the SHA-256 of its siblings from the run up to the root."""
    size = np.array(sizes)
    block, own = np.repeat(np.arange(size.size), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    parts = [_unpacked(t, n, k) for t, n, k in zip(trees, sizes, levels, strict=True)]
    above = [_steps(p) for p in paths]
    now = now.copy()
    for level in range(DEPTH):
        some = [b for b, p in enumerate(parts) if len(p) > level]
        if not some:
            break
        many = np.zeros(size.size, np.int64)
        many[some] = [parts[b][level][0].shape[0] for b in some]
        start = np.cumsum(many) - many
        digests, states = (np.concatenate([parts[b][level][i] for b in some]) for i in (0, 1))
        index = np.concatenate([np.arange(many[b]) for b in some])
        of = np.repeat(some, many[some])
        first = start[of] + index - index % WIDTH
        run = digests[np.minimum(first[:, None] + np.arange(WIDTH), digests.shape[0] - 1)]
        count = np.minimum(WIDTH, many[of] - (index - index % WIDTH))
        lanes = np.flatnonzero(many[block] > 0)
        now[lanes] = _folded(start[block[lanes]] + own[lanes] // WIDTH**level, now[lanes], index % WIDTH, count, states, run)
    for level in range(max(map(len, above), default=0)):
        some = [b for b, p in enumerate(above) if len(p) > level]
        steps = [above[b][level] for b in some]
        run = np.zeros((len(some), WIDTH, _SIZE), np.uint8)
        for k, (_, n, _, digests) in enumerate(steps):
            run[k, :n] = np.frombuffer(digests, np.uint8).reshape(n, _SIZE)
        slot, count = (np.array([s[i] for s in steps]) for i in (0, 1))
        state = np.frombuffer(b"".join(s[2] for s in steps), np.uint8).reshape(-1, _SIZE)
        where = np.full(size.size, -1)
        where[some] = np.arange(len(some))
        lanes = np.flatnonzero(where[block] >= 0)
        now[lanes] = _folded(where[block[lanes]], now[lanes], slot, count, state, run)
    proofs = []
    for n, part, steps in zip(sizes, parts, above, strict=True):
        rest = [b"".join(_others(sha.hex_text(np.frombuffer(d, np.uint8).reshape(-1, _SIZE)).tobytes(), s) for s, _, _, d in steps)]
        for digests, _ in reversed(part):
            text, m = sha.hex_text(digests).tobytes(), digests.shape[0]
            runs = [text[64 * i : 64 * (i + WIDTH)] for i in range(0, m, WIDTH)]
            rest = [_others(runs[i // WIDTH], i % WIDTH) + rest[i // WIDTH] for i in range(m)]
        proofs += [hashlib.sha256(x).hexdigest() for x in rest[:n]]
    return now, proofs


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_blocks(batches):
        head = np.flatnonzero(table.column("head").to_numpy())
        heads = table.take(pa.array(head)).to_pylist()
        leaves = table.filter(pa.array(~table.column("head").to_numpy()))
        leaf = leaves.column("digest").to_pylist()
        now = _matrix(pa.array([x or y for x, y in zip(leaves.column("now").to_pylist(), leaf, strict=True)], pa.binary()))
        folded, proofs = fold_blocks([h["size"] for h in heads], [_levels(h["total"]) for h in heads], [h["tree"] for h in heads], [h["path"] for h in heads], now)
        subroot = [h["subroot"].hex() for h in heads for _ in range(h["size"])]
        root = [h["root"].hex() for h in heads for _ in range(h["size"])]
        folded = [x.tobytes().hex() for x in folded]
        columns = [leaves.column("doc_id").combine_chunks(), *(pa.array(c, pa.string()) for c in ([x.hex() for x in leaf], subroot, root, proofs, folded)), pa.array([x == y for x, y in zip(folded, root, strict=True)], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with its place among the partition's rows of its group."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.array(batch.column("g").to_pylist(), object)
        new = np.flatnonzero(np.r_[g[0] != last, g[1:] != g[:-1]])
        place = n + np.arange(g.size)
        for at in new.tolist():
            place[at:] = np.arange(g.size - at)
        last, n = g[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def _numbered(df: DataFrame, order: list, rows: int) -> DataFrame:
    """df(g, ...) with pos, the row's place in its group by `order`, and total, the group's rows. Rows go to tasks by ranges of the order;
    only one count a range and group meets in a task."""
    spark = df.sparkSession
    n = partitions(spark, rows, 1 << 18)
    sorted_ = df.repartitionByRange(n, "g", *order).sortWithinPartitions("g", *order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_.schema)
    placed = materialize(sorted_.mapInArrow(_placed, f"{fields}, place long"), "placed")
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"))
    counts = counts.select("g", "part", F.expr("sum(n) over (partition by g order by part rows between unbounded preceding and current row) - n").alias("before"), F.expr("sum(n) over (partition by g)").alias("total"))
    return placed.join(counts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("place")).drop("part", "place", "before")


def _grow(nodes: DataFrame, rows: int) -> list[DataFrame]:
    """Trees of all rounds: blocks of nodes(g, pos, total, digest), then blocks of those blocks' tops, until each group has one block."""
    spark, rounds = nodes.sparkSession, []
    while True:
        blocks = nodes.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "total", "digest", (F.col("pos") % BLOCK == 0).alias("head"))
        blocks = blocks.repartition(partitions(spark, rows, 1 << 18), "g", "block").sortWithinPartitions("g", "block", "pos")
        trees = materialize(blocks.mapInArrow(_plant, "g string, block long, total long, size int, tree binary, top binary"), "trees")
        rounds.append(trees)
        higher = trees.where(F.col("total") > BLOCK)
        rows = higher.count()
        if not rows:
            return rounds
        nodes = higher.select("g", F.col("block").alias("pos"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("top").alias("digest"))


_BLOCKS = ("g", "block", "total", "size", "tree", "path", "subroot", "root")
_NODE_PATHS = "g string, pos long, path binary, subroot binary, root binary"


def _with_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the first round with the path above each one's top; tops(g, path, subroot, root): what lies above each group."""
    above = None
    for trees in reversed(rounds):
        blocks = trees.where(F.col("total") <= BLOCK).join(tops, "g").select(*_BLOCKS)
        if above is not None:
            blocks = blocks.unionByName(trees.where(F.col("total") > BLOCK).join(above.withColumnRenamed("pos", "block"), ["g", "block"]).select(*_BLOCKS))
        above = blocks.mapInArrow(_descend, _NODE_PATHS)
    return blocks


@dataclass
class Manifest:
    """leaves(g, doc_id, digest, now, pos, total, ...), and blocks(g, block, total, size, tree, path, subroot, root), whose trees hold the
    digests and states of every node and whose paths lead from a block's top to the root."""

    leaves: DataFrame
    blocks: DataFrame


def manifest(docs: DataFrame, is_changed: Column | None = None, changed_text: Column | None = None) -> Manifest:
    """The tree over docs(doc_id, source, lang, n_chars, text): a tree for each lang over its leaves, and one over the langs' roots.

    Runs of WIDTH nodes in ascending order (doc_id, nulls first, then digest) become a parent until one is left; langs ascend bytewise,
    null first. Where is_changed holds, `now` is the leaf with changed_text in place of the text; both are expressions over docs.

    Defined cases: any field may be null; an empty text is not a null one; rows with equal doc_id are leaves each, equal rows too; a lone
    leaf is its lang's root, a lone lang's root the root; an empty table has no leaves and no root; other columns are ignored, whatever their names.
    """
    field = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    now = F.when(is_changed, leaf_digest(**field | {"text": changed_text})) if is_changed is not None else F.lit(None).cast("binary")
    g = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    rows = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(**field).alias("digest"), now.alias("now"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "leaves")
    n = rows.count()
    leaves = materialize(_numbered(rows, [F.asc_nulls_first("doc_id"), "digest", "row"], n), "numbered")
    drop_materialized(rows)
    rounds = _grow(leaves, n)
    roots = [t.where(F.col("total") <= BLOCK).select("g", F.col("top").alias("subroot")) for t in rounds]
    roots = materialize(_union(roots), "subroots")
    langs = roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("digest"))
    langs = materialize(_numbered(langs, ["key"], roots.count()), "langs")
    upper = _grow(langs, 1)
    top = _union([t.where(F.col("total") <= BLOCK).select("g", F.lit(b"").alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root")) for t in upper])
    above = _with_paths(upper, top).mapInArrow(_descend, _NODE_PATHS)
    tops = langs.select(F.col("key"), F.col("digest").alias("subroot"), "pos").join(above.select("pos", "path", "root"), "pos").select(F.col("key").alias("g"), "path", "subroot", "root")
    return Manifest(leaves, _with_paths(rounds, materialize(tops, "tops")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fold(tree: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf: the root that its changed digest (where there is
    one, else its own) leads to with the siblings the tree holds, and whether it is the tree's root. proof_sha256 is the SHA-256 of all
    siblings' hex text, from the leaf's run up to the root; without any, that of nothing."""
    of = {f.name: f.dataType for f in [*tree.leaves.schema, *tree.blocks.schema]}
    pad = lambda *have: [F.lit(None).cast(of[c]).alias(c) for c in ("doc_id", "digest", "now", "size", "tree", "path", "subroot", "root") if c not in have]
    leaves = tree.leaves.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "total", F.lit(False).alias("head"), "doc_id", "digest", "now", *pad("doc_id", "digest", "now"))
    heads = tree.blocks.select("g", "block", F.lit(-1).cast("long").alias("pos"), "total", F.lit(True).alias("head"), *pad("size", "tree", "path", "subroot", "root"), "size", "tree", "path", "subroot", "root")
    n = partitions(tree.leaves.sparkSession, tree.leaves.count(), 1 << 17)
    rows = leaves.unionByName(heads).repartition(n, "g", "block").sortWithinPartitions("g", "block", "pos")
    return rows.mapInArrow(_fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def lowered_thirds(docs: DataFrame) -> DataFrame:
    """fold() of the manifest of docs, where of the rows whose doc_id's CRC-32 is divisible by 3 the text's A-Z are lower-cased; cases as in manifest().

    A text without A-Z stays as it was and verifies, as do null texts and rows without a doc_id."""
    third = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return fold(manifest(docs, third, lower_ascii(F.col("text"))))
