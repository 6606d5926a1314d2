"""Operator 8: exact substring dedup by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import binary_column, drop_materialized, materialize, small_batches
from codelode.llm.wordhash import BASES, mix, run_hashes, word_hashes

WINDOW = 13
#: Text that a task hashes together; equal runs in it are combined before the shuffle.
BATCH_BYTES = 8 << 20
#: Bytes of text whose hashes one bucket gets, which bounds what a task holds.
BUCKET_BYTES = 16 << 20
_HITS = "shard int, docs binary, counts binary, places binary"


def block_size(window: int) -> int:
    """The longest block such that every window holds a whole block of those that start at multiples of it."""
    return (window + 1) // 2


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


class _Out:
    """Rows for the shuffle: hashes for a bucket, or places already known that pass through it to the documents of shard -1 - bucket."""

    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
    sql = "bucket int, hashes binary, more binary, docs binary, counts binary, places binary"


def _buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _shipped(n_buckets: int, h: np.ndarray, width: int, second: np.ndarray | None, names: np.ndarray, digests: np.ndarray, doc: np.ndarray, at: np.ndarray, flag: np.ndarray) -> Iterator[dict]:
    """One row a bucket. hashes: `width` low bytes of each hash; more: of the second; docs, counts, places: whose they are, and where."""
    bucket = _buckets_of(h, n_buckets)
    order = np.lexsort((at, doc, bucket))
    bucket, h, doc, at, flag = bucket[order], h[order], doc[order], at[order], flag[order]
    second = None if second is None else second[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if bucket.size else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), bucket.size], strict=True):
        own = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]])
        yield {
            "bucket": int(bucket[a]),
            "hashes": h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
            "more": b"" if second is None else second[a:b].astype("<u8").tobytes(),
            "docs": np.stack([names[doc[a:b][own]], digests[doc[a:b][own]]], axis=1).astype("<i8").tobytes(),
            "counts": np.diff(np.r_[own, b - a]).astype("<u4").tobytes(),
            "places": (at[a:b].astype("<u4") * np.uint32(2) + flag[a:b].astype("<u4")).tobytes(),
        }


def _received(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """All of a bucket: hash, second hash, number of the document's entry, doc_id, digest, place, flag; source: the number of the sending batch."""
    hashes, more, docs, counts, places, source = [], [], [], [], [], []
    for k, r in enumerate(table.to_pylist()):
        raw = np.frombuffer(r["hashes"], np.uint8).reshape(-1, width)
        wide = np.zeros((raw.shape[0], 8), np.uint8)
        wide[:, :width] = raw
        hashes.append(wide.view("<u8").ravel())
        more.append(np.frombuffer(r["more"], "<u8"))
        docs.append(np.frombuffer(r["docs"], "<i8").reshape(-1, 2))
        counts.append(np.frombuffer(r["counts"], "<u4").astype(np.int64))
        places.append(np.frombuffer(r["places"], "<u4"))
        source.append(np.full(raw.shape[0], k))
    docs, places = np.concatenate(docs), np.concatenate(places)
    doc = np.repeat(np.arange(docs.shape[0]), np.concatenate(counts))
    return np.concatenate(hashes), np.concatenate(more), doc, docs[:, 0], docs[:, 1], (places >> np.uint32(1)).astype(np.int64), (places & np.uint32(1)).astype(bool), np.concatenate(source)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("digest").to_numpy(zero_copy_only=False).astype(np.int64)


def _shard_of(names: np.ndarray, shards: int) -> np.ndarray:
    return (mix(names.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _addressed(shards: int, names: np.ndarray, digests: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[dict]:
    """Places by document, in one row for each shard of documents."""
    if not doc.size:
        return
    shard = _shard_of(names[doc], shards)
    order = np.lexsort((at, doc, shard))
    shard, doc, at = shard[order], doc[order], at[order].astype("<u4")
    edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), shard.size], strict=True):
        own = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]])
        pairs = np.stack([names[doc[a:b][own]], digests[doc[a:b][own]]], axis=1).astype("<i8")
        yield {"shard": int(shard[a]), "docs": pairs.tobytes(), "counts": np.diff(np.r_[own, b - a]).astype("<u4").tobytes(), "places": at[a:b].tobytes()}


def _known(shards: int, names: np.ndarray, digests: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[dict]:
    """Places that the sending task has already judged."""
    for r in _addressed(shards, names, digests, doc, at):
        yield {"bucket": -1 - r.pop("shard"), "hashes": b"", "more": b""} | r


def _hits(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())]))


def _passed(table: pa.Table) -> pa.Table:
    return _hits([{"shard": -1 - r["bucket"], "docs": r["docs"], "counts": r["counts"], "places": r["places"]} for r in table.to_pylist()])


def _gathered(table: pa.Table) -> pa.Table:
    """All places of a shard's documents: a row for each document."""
    rows = table.to_pylist()
    docs = np.concatenate([np.frombuffer(r["docs"], "<i8").reshape(-1, 2) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64)
    places = np.concatenate([np.frombuffer(r["places"], "<u4") for r in rows])
    pairs, which = np.unique(docs, axis=0, return_inverse=True)
    doc = np.repeat(which.ravel(), counts)
    order = np.lexsort((places, doc))
    parts = np.split(places[order], np.cumsum(np.bincount(doc, minlength=len(pairs)))[:-1])
    return pa.table({"doc_id": pa.array(pairs[:, 0]), "digest": pa.array(pairs[:, 1]), "at": pa.array([x.tobytes() for x in parts], pa.binary())})


def _probe(n_buckets: int, block: int):
    """Every rolling run of `block` words; those at multiples of it are the index's blocks (flag). Runs that several documents of the batch
    share are known to repeat: their places pass through, and two of them stand for the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            names, digests = _ids(batch)
            words = [word_hashes(t.as_py()) for t in binary_column(batch.column("text"))]
            size = np.array([max(0, w.size - block + 1) for w in words])
            h = np.concatenate([run_hashes(w, block) for w in words])
            doc, at = np.repeat(np.arange(size.size), size), np.arange(h.size) - np.repeat(_starts(size)[:-1], size)
            order = np.argsort(h, kind="stable")
            new = np.r_[True, h[order][1:] != h[order][:-1]] if h.size else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            lowest, highest = np.minimum.reduceat(names[doc[order]], first) if h.size else h, np.maximum.reduceat(names[doc[order]], first) if h.size else h
            many = (lowest != highest)[group] if h.size else np.zeros(0, bool)
            block_of = np.logical_or.reduceat(at[order] % block == 0, first) if h.size else np.zeros(0, bool)
            shared = order[many]
            yield from _batches(_known(n_buckets, names, digests, doc[shared], at[shared]))
            # of a run within one document all places go, of one in several a place in the document of the least doc_id and one in that of the
            # greatest, so that a bucket sees two documents, whatever other batches send
            send, name, of = ~many, names[doc[shared]], group[many]
            for end in (lowest, highest):
                at_end = np.flatnonzero(many)[name == end[of]]
                send[at_end[np.flatnonzero(np.r_[True, group[at_end][1:] != group[at_end][:-1]])] if at_end.size else at_end] = True
            flag = np.where(many, block_of[group], at[order] % block == 0) if h.size else many
            picked = order[send]
            yield from _batches(_shipped(n_buckets, h[picked], 5, None, names, digests, doc[picked], at[picked], flag[send]))

    return run


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["hashes"]) + len(r["places"]) + len(r["more"])
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=_Out.schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_Out.schema)


def _anchors(table: pa.Table, shards: int) -> pa.Table:
    """Places in one bucket of runs that occur in two documents and are a block in one of them."""
    if table.column("bucket")[0].as_py() < 0:
        return _passed(table)
    h, _, doc, names, digests, at, flag, _ = _received(table, 5)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    name = names[doc[order]]
    good = (np.minimum.reduceat(name, first) != np.maximum.reduceat(name, first)) & np.logical_or.reduceat(flag[order], first)
    hit = order[np.repeat(good, np.diff(np.r_[first, h.size]))]
    return _hits(list(_addressed(shards, names, digests, doc[hit], at[hit])))


def _extend(n_buckets: int, block: int, window: int):
    """Windows around anchors, the only ones that can repeat, under a 104-bit hash. Of equal windows in the batch the one with the least
    doc_id is sent; all others repeat an earlier document's and pass through as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            names, digests = _ids(batch)
            hs, seconds, docs, ats = [], [], [], []
            for i, (t, at) in enumerate(zip(binary_column(batch.column("text")), batch.column("at").to_pylist(), strict=True)):
                text = t.as_py()
                words = word_hashes(text)
                n = words.size - window + 1
                if n <= 0:
                    continue
                anchor = np.zeros(words.size + 1, np.int64)
                places = np.frombuffer(at, "<u4").astype(np.int64)
                np.add.at(anchor, np.maximum(0, places - (window - block)), 1)
                np.add.at(anchor, places + 1, -1)
                windows = np.flatnonzero(np.cumsum(anchor)[:n] > 0)
                hs.append(run_hashes(words, window)[windows])
                seconds.append(run_hashes(word_hashes(text, BASES[1]), window, 1)[windows])
                docs.append(np.full(windows.size, i))
                ats.append(windows)
            if not hs:
                continue
            h, second, doc, at = map(np.concatenate, (hs, seconds, docs, ats))
            if not h.size:
                continue
            order = np.lexsort((names[doc], second, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])]
            least = names[doc[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
            later = names[doc[order]] > least
            known, picked = order[later], order[~later]
            yield from _batches(_known(n_buckets, names, digests, doc[known], at[known]))
            yield from _batches(_shipped(n_buckets, h[picked], 5, second[picked], names, digests, doc[picked], at[picked], np.zeros(picked.size, bool)))

    return run


def _repeats(table: pa.Table, shards: int) -> pa.Table:
    """Windows in one bucket whose words also start in a document with a smaller doc_id."""
    if table.column("bucket")[0].as_py() < 0:
        return _passed(table)
    h, second, doc, names, digests, at, _, _ = _received(table, 5)
    name = names[doc]
    order = np.lexsort((name, second, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])]
    least = name[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = order[name[order] > least]
    return _hits(list(_addressed(shards, names, digests, doc[hit], at[hit])))


def _exchange(rows: DataFrame, judge: Callable[[pa.Table, int], pa.Table], shards: int) -> DataFrame:
    """Hashes meet in their buckets; what is found there goes, packed, to shards of documents: (doc_id, digest, at)."""
    found = rows.groupBy("bucket").applyInArrow(lambda t: judge(t, shards), _HITS)
    return found.groupBy("shard").applyInArrow(_gathered, "doc_id long, digest long, at binary")


def _cut(window: int):
    """Remove the words that the windows at the given starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            out = []
            for t, at in zip(binary_column(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                words = t.as_py().split()
                n = len(words)
                if at:
                    edge, places = np.zeros(n + 1, np.int64), np.frombuffer(at, "<u4").astype(np.int64)
                    np.add.at(edge, places, 1)
                    np.add.at(edge, places + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out.append((n, n - len(words), b" ".join(words)))
            n, removed, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row's words, joined by a space, without those in windows that an earlier document has too.

    Words are runs of anything but ASCII white space, unchanged; a window is `window` consecutive words of one document. A word goes if a
    window covers it whose words also start in a document with a smaller doc_id; windows are judged on the input.

    1. Anchors: each document's blocks of 7 words at multiples of 7 are the index, all its rolling runs of 7 words the probes (for a window
       of 13, which always holds a whole block). A run that occurs in two documents, in one of them as a block, is an anchor.
    2. Extension: windows around anchors are compared under a second, longer hash; unions of those that also start in an earlier
       document are the maximal repeats.
    3. Their words are removed.

    Hashes travel packed, in buckets of about bucket_bytes of text. Runs that repeat within a task's batch are judged there and sent twice,
    so a passage shared by any number of documents is two entries a batch in its bucket, and no pairs are formed.

    Defined cases: null texts have no words; rows with equal doc_id are no earlier documents of each other (their own texts stay apart);
    a null doc_id is earlier than all others; documents shorter than a window lose nothing; an empty table gives no rows; other columns
    are ignored.
    """
    block = block_size(window)
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("name"), name.alias("doc_id"), F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))

    def joined(hits: DataFrame, how: str) -> DataFrame:
        found = hits.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "at")
        return rows.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), how)

    anchors = materialize(_exchange(rows.select("doc_id", "digest", "text").mapInArrow(_probe(n, block), _Out.sql), _anchors, n), "anchors")
    around = joined(anchors, "inner").dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", "text", "at")
    repeats = materialize(_exchange(around.mapInArrow(_extend(n, block, window), _Out.sql), _repeats, n), "repeats")
    drop_materialized(anchors)
    return joined(repeats, "left").select("name", "text", "at").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
