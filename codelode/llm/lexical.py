"""Operator 11: exact ranked lexical search of all documents for each item, by a dual tree over items and documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import binary_column, drop_materialized, materialize, partitions, small_batches

#: Distinct (item, term) pairs whose index is broadcast at once; more items take more passes over the documents.
PART_TERMS = 1 << 19
#: Documents of a tree, its fan-out, and the cells of the matrix of a tree's documents and terms (a tree of long texts has fewer documents).
TREE_DOCS, FAN, LEVELS, CELLS = 512, 8, 3, 1 << 22
#: Shares of the documents that are searched before the rest, so that the rest meets strong kth scores.
WAVES = (1 / 64, 1 / 8)
#: Text is cut to terms in pieces of about so many bytes.
PIECE = 4 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max


def term_pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        to = len(text) if at + piece >= len(text) else text.find(b" ", at + piece)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        texts = binary_column(batch.column("text"))
        for i, t in zip(batch.column("item_id").cast(pa.int64()).to_pylist(), texts, strict=True):
            found = sorted({w for words in term_pieces(t.as_py()) for w in words})
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])


@dataclass
class Node:
    """Items, the terms that any of them has (the coordinates whose maximum is 1), and the parts that they are divided into."""

    items: np.ndarray
    terms: np.ndarray
    parts: list[Node]


class Items:
    """A bounded part of the items: their terms by number, and the hierarchy over them."""

    def __init__(self, pairs: list[tuple[int, bytes]]) -> None:
        self.ids = np.array(sorted({i for i, _ in pairs}), np.int64)
        number = {i: n for n, i in enumerate(self.ids.tolist())}
        self.vocabulary: dict[bytes, int] = {}
        rows = sorted((number[i], t) for i, t in pairs)
        self.item = np.array([i for i, _ in rows], np.int64)
        self.term = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for _, t in rows], np.int64)
        self.kind = "<u2" if len(self.vocabulary) <= 1 << 16 else "<u4"
        self.root: Node | None = None

    def grow(self) -> None:
        """Divide the items by the term that divides them most evenly, again and again; where none does, in the middle."""
        start = np.searchsorted(self.item, np.arange(self.ids.size + 1))

        def node(items: np.ndarray) -> Node:
            own = np.concatenate([self.term[start[i] : start[i + 1]] for i in items.tolist()])
            terms, many = np.unique(own, return_counts=True)
            if items.size == 1:
                return Node(items, terms, [])
            even = np.minimum(many, items.size - many)
            left = np.zeros(items.size, bool)
            if even.max() * 8 >= items.size:
                split = terms[even.argmax()]
                left[:] = [split in self.term[start[i] : start[i + 1]] for i in items.tolist()]
            else:
                left[: items.size // 2] = True
            return Node(items, terms, [node(items[left]), node(items[~left])])

        self.root = node(np.arange(self.ids.size))

    def posting(self, text: bytes) -> tuple[int, bytes, bytes]:
        """A text's number of terms, and which terms of the vocabulary it has how often."""
        n, known, get = 0, [], self.vocabulary.get
        for words in term_pieces(text):
            n += len(words)
            known.append(np.array([t for t in map(get, words) if t is not None], np.int64))
        terms, tf = np.unique(np.concatenate(known), return_counts=True) if known else (np.zeros(0, np.int64),) * 2
        width = next((w for w in (1, 2, 4) if tf.max(initial=0) < 1 << 8 * w), 8)
        return n, terms.astype(self.kind).tobytes(), tf.astype(f"<u{width}").tobytes()


@dataclass
class Weights:
    """A term's weight by its number, and what a document's length counts."""

    w: np.ndarray
    documents: int
    length: int

    @staticmethod
    def of(df: np.ndarray, documents: int, length: int) -> Weights:
        return Weights(np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64), documents, length)

    def values(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each occurrence list adds to a score."""
        m = np.array([50 + 50 * x * self.documents // self.length for x in n.tolist()], np.int64)
        return self.w[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _unpack(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms in each row, all terms, all tf)."""
    terms = batch.column("terms").to_pylist()
    size = np.array([len(t) for t in terms], np.int64) // np.dtype(kind).itemsize
    tf = [np.frombuffer(x, f"<u{len(x) // s}").astype(np.int64) for x, s in zip(batch.column("tf").to_pylist(), size.tolist(), strict=True) if s]
    return size, np.frombuffer(b"".join(terms), kind).astype(np.int64), np.concatenate(tf) if tf else np.zeros(0, np.int64)


class Search:
    """The k best documents of each item among those seen: scores and ids, and the kth so far (of this or an earlier search)."""

    def __init__(self, items: Items, k: int, kth_score: np.ndarray, kth_doc: np.ndarray) -> None:
        self.items, self.k, self.kth_score, self.kth_doc = items, k, kth_score.copy(), kth_doc.copy()
        self.scores = [np.zeros(0, np.int64)] * items.ids.size
        self.docs = [np.zeros(0, np.int64)] * items.ids.size
        self.place = np.full(len(items.vocabulary), -1, np.int64)
        self.bounds = self.scored = 0

    def add(self, docs: np.ndarray, size: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Search a tree over these documents, which are to be like each other where they follow each other."""
        own, column = np.unique(terms, return_inverse=True)
        if not own.size:
            return
        wide = FAN**LEVELS
        cells = np.zeros((-(-docs.size // wide) * wide, own.size), np.int64)
        cells[np.repeat(np.arange(docs.size), size), column] = values
        self.place[own] = np.arange(own.size)
        # maxima of the tree's nodes, from the root down to runs of FAN documents, and the smallest doc_id of each
        self.cells, self.ids = cells, np.r_[docs, np.full(cells.shape[0] - docs.size, _LAST)]
        self.maxima, self.least = [], []
        for level in range(LEVELS):
            run = FAN ** (LEVELS - level)
            self.maxima.append(cells.reshape(-1, run, own.size).max(axis=1))
            self.least.append(self.ids.reshape(-1, run).min(axis=1))
        self._meet(self.items.root, 0, np.arange(self.maxima[0].shape[0]))
        self.place[own] = -1

    def _meet(self, node: Node, level: int, some: np.ndarray) -> None:
        """Meet items with document nodes of a level; what can't be among the k best of the item whose kth is weakest goes."""
        columns = self.place[node.terms]
        columns = columns[columns >= 0]
        bound = self.maxima[level][some[:, None], columns].sum(axis=1)
        kth = self.kth_score[node.items]
        weakest = kth.min()
        doc = self.kth_doc[node.items[kth == weakest]].max()
        some = some[(bound > weakest) | ((bound == weakest) & (bound > 0) & (self.least[level][some] < doc))]
        self.bounds += bound.size
        if not some.size:
            return
        if level + 1 < LEVELS:
            below = (some[:, None] * FAN + np.arange(FAN)).ravel()
            for part in node.parts or [node]:
                self._meet(part, level + 1, below)
        elif node.parts:
            for part in node.parts:
                self._meet(part, level, some)
        else:
            self._score(int(node.items[0]), columns, (some[:, None] * FAN + np.arange(FAN)).ravel())

    def _score(self, item: int, columns: np.ndarray, rows: np.ndarray) -> None:
        score, docs = self.cells[rows[:, None], columns].sum(axis=1), self.ids[rows]
        self.scored += rows.size
        good = (score > self.kth_score[item]) | ((score == self.kth_score[item]) & (score > 0) & (docs < self.kth_doc[item]))
        if not good.any():
            return
        score, docs = np.r_[self.scores[item], score[good]], np.r_[self.docs[item], docs[good]]
        best = np.lexsort((docs, -score))[: self.k]
        self.scores[item], self.docs[item] = score[best], docs[best]
        if best.size == self.k and (-score[best[-1]], docs[best[-1]]) < (-self.kth_score[item], self.kth_doc[item]):
            self.kth_score[item], self.kth_doc[item] = score[best[-1]], docs[best[-1]]


def _parts(benchmark: DataFrame, part_terms: int) -> Iterator[Items]:
    """The items in parts of part_terms distinct terms or so; one with more is a part of its own."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    pairs = materialize(rows.mapInArrow(_item_terms, "item_id long, term binary").distinct(), "item-terms")
    sizes = pairs.groupBy("item_id").count()
    total, longest = sizes.agg(F.sum("count"), F.max("count")).first()
    if not total:
        return
    n, part = 1, lambda: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while n * part_terms < 2 * total and sizes.groupBy(part()).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] > max(part_terms, longest):
        n *= 2
    for k in range(n):
        found = [(r[0], bytes(r[1])) for r in pairs.where(part() == k).collect()]
        if found:
            yield Items(found)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first within 32 lots of documents, so that no task meets all of an item's."""
    order = [F.col("score").desc(), "doc_id"]
    lots = found.withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    lots = lots.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "lot").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "lot")
    return lots.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)


def _search_part(docs: DataFrame, items: Items, k: int, waves: tuple[float, ...]) -> DataFrame:
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(items)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            n, terms, tf = zip(*(known.value.posting(t.as_py()) for t in binary_column(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known.value.vocabulary), np.int64)
        for batch in batches:
            df += np.bincount(_unpack(batch, known.value.kind)[1], minlength=df.size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    postings = materialize(docs.mapInArrow(post, "doc_id long, n long, terms binary, tf binary"), "postings")
    documents, length = postings.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for term, n in postings.select("terms", "tf").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    items.grow()
    weights = spark.sparkContext.broadcast((items, Weights.of(df, documents, length or 1)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with the term that adds most to a score: those that share it lie together."""
        for batch in batches:
            size, terms, tf = _unpack(batch, weights.value[0].kind)
            values = weights.value[1].values(terms, tf, np.repeat(batch.column("n").to_numpy(), size))
            row = np.repeat(np.arange(size.size), size)
            order = np.lexsort((terms, -values, row))
            keep = size > 0
            first = order[(np.cumsum(size) - size)[keep]]
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(keep)).columns, pa.array(terms[first])], [*batch.schema.names, "strongest"])

    draw = F.pmod(F.xxhash64("doc_id", F.lit("wave")), F.lit(1 << 20)) / float(1 << 20)
    wave = reduce(lambda c, w: F.when(draw < w[1], w[0]).otherwise(c), reversed(list(enumerate(waves))), F.lit(len(waves)))
    filed = postings.mapInArrow(file, "doc_id long, n long, terms binary, tf binary, strongest long")
    filed = materialize(filed.select("*", wave.alias("wave"), F.xxhash64("doc_id", "terms").alias("salt")), "filed")
    order = ("wave", "strongest", "salt")
    dealt = materialize(filed.repartitionByRange(partitions(spark, documents, 1 << 16), *order).sortWithinPartitions(*order), "dealt")
    drop_materialized(postings)
    drop_materialized(filed)
    best = None
    state = (np.zeros(items.ids.size, np.int64), np.full(items.ids.size, _LAST, np.int64))
    for number in range(len(waves) + 1):
        kth = spark.sparkContext.broadcast(state)

        def search(batches: Iterator[pa.RecordBatch], kth=kth) -> Iterator[pa.RecordBatch]:
            items, weigh = weights.value
            seen = Search(items, k, *kth.value)
            for batch in batches:
                size, terms, tf = _unpack(batch, items.kind)
                values = weigh.values(terms, tf, np.repeat(batch.column("n").to_numpy(), size))
                ids, ends, at = batch.column("doc_id").to_numpy(), np.r_[0, np.cumsum(size)], 0
                while at < ids.size:
                    to = min(ids.size, at + TREE_DOCS)
                    while to - at > 1 and np.unique(terms[ends[at] : ends[to]]).size * FAN**LEVELS * -(-(to - at) // FAN**LEVELS) > CELLS and to - at > FAN:
                        to = at + (to - at) // 2
                    seen.add(ids[at:to], size[at:to], terms[ends[at] : ends[to]], values[ends[at] : ends[to]])
                    at = to
            many = [x.size for x in seen.docs]
            if sum(many):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items.ids, many)), pa.array(np.concatenate(seen.docs)), pa.array(np.concatenate(seen.scores))], ["item_id", "doc_id", "score"])

        found = dealt.where(F.col("wave") == number).select("doc_id", "n", "terms", "tf").mapInArrow(search, "item_id long, doc_id long, score long")
        best = materialize(_best(found if best is None else found.unionByName(best.drop("rank")), k), "best")
        state = (state[0].copy(), state[1].copy())
        for item, doc, score in best.where(F.col("rank") == k).select("item_id", "doc_id", "score").collect():
            at = int(np.searchsorted(items.ids, item))
            state[0][at], state[1][at] = score, doc
        kth.unpersist()
    drop_materialized(dealt)
    known.unpersist()
    weights.unpersist()
    return best


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 50, part_terms: int = PART_TERMS, waves: tuple[float, ...] = WAVES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ties to the smaller doc_id.

    A document's score for an item sums, over the item's terms that it holds, a weight by how few documents hold the term times a
    saturating count by the document's length, in integers (see Weights). The method: documents' counts of the items' terms are written
    once and laid out so that documents with the same strongest term lie together; runs of them make trees whose nodes hold, for each
    term, the largest that any document below adds to a score. Items make a tree whose nodes hold the terms that any item below has.
    Pairs of nodes are met from the roots down; the sum of the documents' maxima over the items' terms bounds every score below, and
    where it can't change the list of the item whose kth score is weakest the whole pair is left out. kth scores come from a share of
    the documents first (`waves`), then from more, then from all; in between only one number and doc_id an item is sent out.

    Defined cases: null texts and texts without terms hold nothing, and of the latter neither N nor L counts any; rows without a doc_id
    or item_id take no part; rows with equal item_id are one item with the terms of all; rows with equal doc_id are documents each, with
    a rank each; items without terms, or without a document that scores, give no rows; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _parts(benchmark, part_terms):
        best = _search_part(docs, items, k, waves)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", "rank", "doc_id", "score")
