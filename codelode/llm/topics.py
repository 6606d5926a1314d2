"""Topics fitted to the texts themselves, for tables without a topic column: k-means over what words a text has more of than others of its language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codelode.llm.common import binary_column, drop_materialized, materialize, small_batches
from codelode.llm.wordhash import word_hashes

#: Groups of words (by hash) whose shares of a text are its features.
DIMENSIONS = 1024
#: Documents that the first centres are chosen from, about; only their features come to the driver (2 kB each). From there on all documents count.
SAMPLE = 4000
ROUNDS = 25
#: Rounds over all documents; features are kept as 16-bit integers of this scale, so that sums over them are the same in any order.
WHOLE_ROUNDS, SCALE = 4, 1 << 14
#: Rows whose sums of such integers a float32 holds exactly.
_EXACT = 512


def features(words: np.ndarray) -> np.ndarray:
    """Square roots of the shares that each group of words has in a text, all zero for a text without words."""
    counts = np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, words.size)).astype(np.float32)


@dataclass
class Topics:
    """Mean features by language (None: of all), and the topics' centres in what is left without them."""

    means: dict[str | None, np.ndarray]
    centres: np.ndarray

    def of(self, rows: np.ndarray, langs: list[str | None]) -> np.ndarray:
        """The nearest topic of each row of features, the first of equals; -1 for a text without words."""
        if not len(self.centres):
            return np.where(rows.any(axis=1), 0, -1)
        rest = rows - np.stack([self.means.get(lang, self.means[None]) for lang in langs])
        nearest = (rest @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)
        return np.where(rows.any(axis=1), nearest, -1)


def cluster(rows: np.ndarray, langs: list[str | None], topics: int, rounds: int = ROUNDS) -> Topics:
    """k-means; the first centres are rows far from those already chosen. Languages with fewer than 50 rows have the mean of all."""
    if not len(rows):
        return Topics({None: np.zeros(DIMENSIONS, np.float32)}, np.zeros((0, DIMENSIONS), np.float32))
    means: dict[str | None, np.ndarray] = {None: rows.mean(axis=0)}
    names = np.array([lang or "" for lang in langs])
    means |= {str(lang): rows[names == lang].mean(axis=0) for lang in np.unique(names) if lang and (names == lang).sum() >= 50}
    rest = rows - np.stack([means.get(lang, means[None]) for lang in langs])
    random, centres = np.random.default_rng(11), []
    distance = (rest**2).sum(axis=1)
    for _ in range(min(topics, len(rows))):
        share = distance.cumsum()
        centres.append(rest[min(len(rest) - 1, int(np.searchsorted(share, random.random() * share[-1])))])
        distance = np.minimum(distance, ((rest - centres[-1]) ** 2).sum(axis=1))
    centre = np.stack(centres)
    for _ in range(rounds):
        own = (rest @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        after = np.stack([rest[own == k].mean(axis=0) if (own == k).any() else centre[k] for k in range(len(centre))])
        if np.allclose(after, centre, atol=1e-7):
            break
        centre = after
    return Topics(means, centre)


def lang_of(docs: DataFrame) -> Column:
    """The documents' language; null where the table has none."""
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def _first(docs: DataFrame, topics: int, sample: int) -> Topics:
    """Topics of about `sample` documents with words, picked by a hash of id and text, twice as many at most.

    Null and blank texts take no part; equal rows are picked together, each counted; of more than 2 * sample rows picked, as many repeats of
    few texts make, those of the smallest hashes count; no rows give no topics; other columns are ignored."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("__h"), "text", lang_of(docs).alias("__lang")).where(F.col("text").isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod("__h", F.lit(1_000_003)) < int(1_000_003 * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = [features(word_hashes(t.as_py(), lower=True)).astype("<f2").tobytes() for t in binary_column(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__h"), batch.column("__lang"), pa.array(x, pa.binary())], ["h", "lang", "x"])

    found = sorted(((r.h, r.lang, r.x) for r in rows.mapInArrow(run, "h long, lang string, x binary").orderBy("h", "x", "lang").limit(2 * sample).collect()), key=lambda r: (r[0], r[2]))
    x = np.array([np.frombuffer(r[2], "<f2") for r in found], np.float32).reshape(-1, DIMENSIONS)
    some = x.any(axis=1)
    return cluster(x[some], [r[1] for r, s in zip(found, some, strict=True) if s], topics)


def _all_features(docs: DataFrame) -> DataFrame:
    """(lang, x) of every document with words, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = [np.rint(features(word_hashes(t.as_py(), lower=True)) * SCALE).astype("<i2") for t in binary_column(batch.column("text"))]
            some = pa.array([bool(r.any()) for r in x], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"]).filter(some)

    return materialize(docs.select("text", lang_of(docs).alias("lang")).where(F.col("text").isNotNull()).mapInArrow(run, "lang string, x binary"), "features")


def _sums(rows: DataFrame, group: Callable[[np.ndarray, list[str | None]], tuple[np.ndarray, list]]) -> DataFrame:
    """(k, n, total) over rows(lang, x): how many rows have the key k, and the sum of their features. group: features as integers and langs to
    what is summed and the keys. A task adds up its rows; one row a task and key meets in a task."""
    def add(totals: dict, k: str, n: int, total: np.ndarray) -> None:
        was = totals.get(k, (0, 0))
        totals[k] = (was[0] + n, was[1] + total)

    def batch_of(totals: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([t.astype("<i8").tobytes() for _, t in totals.values()], pa.binary())], ["k", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _EXACT):
                part = batch.slice(at, _EXACT)
                x, keys = group(np.frombuffer(b"".join(part.column("x").to_pylist()), "<i2").reshape(-1, DIMENSIONS).astype(np.float32), part.column("lang").to_pylist())
                names, own = np.unique(np.array(keys), return_inverse=True)
                added = (np.arange(len(names))[:, None] == own).astype(np.float32) @ x
                for k, n, total in zip(names.tolist(), np.bincount(own).tolist(), added.astype(np.int64), strict=True):
                    add(totals, str(k), n, total)
            if len(totals) > 1000:
                yield batch_of(totals)
                totals = {}
        if totals:
            yield batch_of(totals)

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t, "<i8") for t in table.column("total").to_pylist())
        return pa.table({"k": table.column("k").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "k string, n long, total binary"
    return rows.mapInArrow(run, schema).groupBy("k").applyInArrow(merge, schema)


def fit(docs: DataFrame, topics: int, sample: int = SAMPLE) -> Topics:
    """Topics of all documents with words: mean features by language (of those with 50 rows at least) and k-means, in WHOLE_ROUNDS rounds over
    all of them at most. The first centres alone come from a sample, as _first() picks it.

    Null and blank texts take no part; no rows give no topics; other columns are ignored. A number a topic or language and dimension comes
    to the driver in a round."""
    found = _first(docs, topics, sample)
    rows = _all_features(docs)
    whole = lambda r: np.frombuffer(r.total, "<i8")
    sums = _sums(rows, lambda x, langs: (x, ["all"] * len(langs))).collect()
    if not sums or not len(found.centres):
        drop_materialized(rows)
        return found
    means: dict[str | None, np.ndarray] = {None: np.rint(whole(sums[0]) / sums[0].n)}
    means |= {r.k[1:]: np.rint(whole(r) / r.n) for r in _sums(rows.where("lang <> ''"), lambda x, langs: (x, [f"={lang}" for lang in langs])).where("n >= 50").collect()}
    centres = found.centres * SCALE
    for _ in range(WHOLE_ROUNDS):
        known = docs.sparkSession.sparkContext.broadcast((means, centres.astype(np.float32)))  # of fixed size

        def nearest(x: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, list]:
            mean, centre = known.value  # noqa: B023
            rest = (x - np.stack([mean.get(lang, mean[None]) for lang in langs])).astype(np.float32)
            return rest, (rest @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1).tolist()

        after = centres.copy()
        for r in _sums(rows, nearest).collect():
            after[int(r.k)] = whole(r) / r.n
        known.unpersist()
        moved, centres = np.abs(after - centres).max(), after
        if moved < SCALE * 1e-4:
            break
    drop_materialized(rows)
    return Topics({k: (m / SCALE).astype(np.float32) for k, m in means.items()}, (centres / SCALE).astype(np.float32))


def assigned(docs: DataFrame, topics: Topics) -> DataFrame:
    """docs with __topic (t0, t1, ...; null for a text without words) and __words, the number of words; one pass, whole texts."""
    known = docs.sparkSession.sparkContext.broadcast(topics)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words = [word_hashes(t.as_py(), lower=True) for t in binary_column(batch.column("text"))]
            topic = known.value.of(np.stack([features(w) for w in words]), batch.column("__lang").to_pylist())
            more = [pa.array([None if k < 0 else f"t{k}" for k in topic.tolist()], pa.string()), pa.array([w.size for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "__topic", "__words"])

    schema = StructType([*docs.schema.fields, StructField("__topic", StringType()), StructField("__words", LongType())])
    return docs.withColumn("__lang", lang_of(docs)).mapInArrow(run, schema)
