"""Operator 6: documents that hold benchmark items, by SimHash of item-sized windows, multi-index Hamming blocks and exact weighted shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import binary_column, kept_by_text, materialize, small_batches
from codelode.llm.wordhash import mix, run_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Hamming distance of a window's and an item's SimHash up to which the index finds them. A bit of two texts of similarity 0.8 differs with
#: probability 0.15, so that one pair in 100,000 at just that similarity lies further apart, and fewer the more similar they are.
RADIUS = 23
#: Blocks of eight bits: fingerprints within the radius differ by RADIUS // BLOCKS bits at most in one of them.
BLOCKS = 8
#: Bytes of benchmark text whose index is broadcast at once; more items take more passes over the documents.
ITEM_BYTES = 8 << 20
#: Window starts whose bits a task counts at once.
PIECE = 8192
#: Pairs of windows and items that a task looks up at once: a byte each.
TABLE_CELLS = 1 << 25
_BLOCK_BITS = np.array([[int(a ^ b).bit_count() for b in range(256)] for a in range(256)], np.uint8)


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles; of fewer words, one for the whole sequence; of none, none."""
    if 0 < words.size < shingle:
        return mix(run_hashes(words, words.size) + np.uint64(words.size))
    return run_hashes(words, shingle)


def window_prints(shingles: np.ndarray, length: int) -> np.ndarray:
    """The SimHash of every run of `length` shingles: bit majority, each shingle weighted by how often the run has it."""
    bits = lambda x: np.unpackbits(mix(x).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    n = shingles.size - length + 1
    votes = np.zeros((n, 64), np.int32)
    for at in range(0, length, 1 << 16):  # a window may be far longer than the piece of text whose windows are judged
        votes[0] += bits(shingles[at : min(length, at + (1 << 16))]).sum(axis=0, dtype=np.int32)
    votes[1:] = bits(shingles[length:]).astype(np.int32) - bits(shingles[: n - 1])
    np.cumsum(votes, axis=0, out=votes)
    return np.packbits(2 * votes > length, axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(shingles: np.ndarray) -> int:
    return int(window_prints(shingles, shingles.size)[0]) if shingles.size else 0


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] numbers) for each i."""
    return np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


class Items:
    """A bounded part of the benchmark in arrays: fingerprints, weighted shingles, which lengths a shingle occurs in, and the Hamming blocks.

    near[b, v] has a bit for every item whose block b lies within radius // BLOCKS bits of the value v. Fingerprints within the radius are
    that near in one block at least, so the union over a fingerprint's blocks holds every item within the radius.
    """

    def __init__(self, items: list[tuple[int, bytes]], shingle: int = SHINGLE, radius: int = RADIUS) -> None:
        self.shingle, self.radius = shingle, radius
        words = [(i, w) for i, w in ((i, word_hashes(t, lower=True)) for i, t in items) if w.size]
        parts = [shingle_hashes(w, shingle) for _, w in words]
        self.ids = [i for i, _ in words]
        self.sizes = np.array([w.size for _, w in words], np.int64)
        self.prints = np.array([simhash(p) for p in parts], np.uint64)
        counted = [np.unique(p, return_counts=True) for p in parts]
        self.keys, self.weights = [k for k, _ in counted], [n for _, n in counted]
        own = np.repeat(np.arange(len(parts)), [k.size for k in self.keys])
        flat = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        pair = np.unique(np.rec.fromarrays([flat, self.sizes[own]])) if flat.size else np.rec.fromarrays([flat, own])
        self.seeds, first = np.unique(pair["f0"], return_index=True)
        self.lengths, self.length_at = np.ascontiguousarray(pair["f1"]), np.r_[first, pair.size]
        self.bits = max(12, int(64 * self.seeds.size).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._cell(self.seeds)] = True
        blocks = self.prints.astype(">u8").view(np.uint8).reshape(-1, 8)
        self.near = np.stack([np.packbits(_BLOCK_BITS[:, blocks[:, b]] <= radius // BLOCKS, axis=1) for b in range(BLOCKS)])

    def _cell(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _seeded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a hash is some item's shingle, and which seed it is."""
        maybe = np.flatnonzero(self.filter[self._cell(hashes)])
        at = np.minimum(np.searchsorted(self.seeds, hashes[maybe]), self.seeds.size - 1)
        good = self.seeds[at] == hashes[maybe]
        return maybe[good], at[good]

    def within(self, prints: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, item) of all pairs within the radius; of: which items take part."""
        rows, items, step = [], [], max(1, TABLE_CELLS // max(1, of.size))
        for at in range(0, prints.size, step):
            value = prints[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8)
            found = self.near[0, value[:, 0]]
            for b in range(1, BLOCKS):
                found |= self.near[b, value[:, b]]
            row, item = np.nonzero(np.unpackbits(found & np.packbits(of), axis=1))
            close = np.bitwise_count(prints[at + row] ^ self.prints[item]) <= self.radius
            rows.append(at + row[close])
            items.append(item[close])
        return np.concatenate(rows), np.concatenate(items)

    def matches(self, text: bytes, least: float) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, n_words, hamming, similarity) of each item's best window in the text.

        A window of an item's length that shares no shingle with it has similarity 0, so of all windows only those that hold a shingle of
        an item of their length are fingerprinted. The index gives the items of that length within the radius, and each pair is judged by
        its similarity alone. The whole text is the one window for items longer than it."""
        if not self.seeds.size:
            return []
        words = word_hashes(text, lower=True)
        best: dict[int, tuple] = {}
        full = run_hashes(words, self.shingle)
        if full.size:
            place, seed = self._seeded(full)
            if place.size:
                count = self.length_at[seed + 1] - self.length_at[seed]
                length = np.minimum(self.lengths[_ragged(self.length_at[seed], count)], words.size)
                place = np.repeat(place, count)
                for n in np.unique(length[length >= self.shingle]).tolist():
                    self._windows(full, words.size, n, place[length == n], least, best)
        for n in np.unique(self.sizes[self.sizes < self.shingle]).tolist():  # whole items that are shorter than a shingle
            runs = mix(run_hashes(words, n) + np.uint64(n))
            place, seed = self._seeded(runs) if runs.size else (runs, runs)
            for k in np.flatnonzero(self.sizes == n).tolist() if place.size else ():
                at = place[self.seeds[seed] == self.keys[k][0]]
                if at.size:
                    best[k] = ((-1.0, int(at.min())), (self.ids[k], int(at.min()), n, 0, 1.0))
        return [x for _, x in sorted(best.values(), key=lambda x: (x[0], x[1][0] is None, x[1]))]

    def _windows(self, full: np.ndarray, n_words: int, n: int, place: np.ndarray, least: float, best: dict[int, tuple]) -> None:
        """Judge the windows of n words that hold a shingle at one of the places."""
        span = n - self.shingle + 1
        edge = np.zeros(n_words - n + 2, np.int32)
        np.add.at(edge, np.maximum(0, place - span + 1), 1)
        np.add.at(edge, np.minimum(place, n_words - n) + 1, -1)
        inside = np.diff(np.r_[0, (np.cumsum(edge)[:-1] > 0).astype(np.int8), 0])
        of = np.minimum(self.sizes, n_words) == n
        for lo, hi in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True):
            for a in range(lo, hi, PIECE):
                part = full[a : min(hi, a + PIECE) + span - 1]
                prints = window_prints(part, span)
                row, item = self.within(prints, of)
                for k in np.unique(item).tolist():
                    self._verify(part, prints, row[item == k], span, a, n, k, least, best)

    def _verify(self, part: np.ndarray, prints: np.ndarray, rows: np.ndarray, span: int, a: int, n: int, k: int, least: float, best: dict[int, tuple]) -> None:
        """Exact weighted similarity of item k with the windows at a + rows. Where too few shingles are the item's, it can't be reached."""
        keys, weights = self.keys[k], self.weights[k]
        at = np.minimum(np.searchsorted(keys, part), keys.size - 1)
        same = keys[at] == part
        total = np.r_[0, np.cumsum(same)]
        both_sizes = span + int(weights.sum())
        most = total[rows + span] - total[rows]
        for r in rows[most >= np.maximum(1, least * (both_sizes - most) - 1e-9)].tolist():
            inside = same[r : r + span]
            both = int(np.minimum(np.bincount(at[r : r + span][inside], minlength=keys.size), weights).sum())
            similarity = both / (both_sizes - both)
            start = a + r
            if similarity >= least and (k not in best or (-similarity, start) < best[k][0]):
                best[k] = ((-similarity, start), (self.ids[k], start, n, int(prints[r] ^ self.prints[k]).bit_count(), similarity))


def _parts(benchmark: DataFrame, shingle: int, radius: int, item_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The index of the benchmark's items in parts of bounded size, and whether there are several."""
    items = benchmark.where("text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return
    n = -(-size // item_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(((r[0], r[1].encode("utf-8", "replace")) for r in part.collect()), key=lambda r: (r[0] is None, r))
        yield Items(rows, shingle, radius), n > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): each benchmark item found in each document, with its best window.

    Texts are cut to words at ASCII white space, A-Z lower-cased. An item matches a document if a window of as many words as the item
    (the whole document, where that is shorter) has a SimHash within `radius` bits of the item's and a weighted Jaccard similarity of
    their word shingles (weight: how often one occurs) of `similarity` at least; `hamming` says how far the SimHashes are apart. The best
    window is the most similar, the first of equals; it starts at word `start`, from 0.

    Defined cases: null and blank items match nothing; null and blank documents hold nothing; an item shorter than a shingle is one
    shingle and must occur whole; rows with equal ids are compared each; null ids are returned as they are; an empty benchmark or
    table gives no rows; other columns are ignored. Documents are compared whole, in pieces, whatever their length. The index of at most
    item_bytes of items or so is made once and broadcast; where there are more, a part's matches are written before the next part is sent. An
    item may be longer than that: a part is as large as its largest item at least.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, n_words long, hamming int, similarity double"
    out = spark.createDataFrame([], schema)
    for items, several in _parts(benchmark, shingle, radius, item_bytes):
        known = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                texts = binary_column(batch.column("text"))
                ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
                rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in known.value.matches(t.as_py(), similarity)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "n_words", "hamming", "similarity"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        if several:
            found = materialize(found, "contaminated")
            known.unpersist()
        out = out.unionByName(found)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, in which no benchmark item is found; cases as in contaminated()."""
    for items, several in _parts(benchmark, shingle, radius, item_bytes):
        known = docs.sparkSession.sparkContext.broadcast(items)

        docs = kept_by_text(docs, lambda texts, known=known: [not known.value.matches(t, similarity) for t in texts])
        if several:
            docs = materialize(docs, "uncontaminated")
            known.unpersist()
    return docs
