"""Operator 10: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import drop_materialized, materialize, small_batches

ORDER = 4
#: Stands ORDER - 1 times before every text; no context reaches over it to another text.
_BEFORE = "\x02" * (ORDER - 1)
#: n-grams of a model shard, which bounds what is broadcast at once (24 bytes each in a task's table).
SHARD_ROWS = 1_500_000
#: Characters that are counted or scored together in a task.
BATCH_CHARS = 2_000_000
QUANTILE = 0.98
#: Units at the language's median that every text is scored together with: a short text must lie further above the median to be rejected.
UNITS = 100
#: One trusted document in so many sets the thresholds and is not counted: what a model has counted it finds too likely.
CALIBRATION = 10


def _codes(text: str) -> np.ndarray:
    """UTF-16 code units, so four fit in a 64-bit number."""
    return np.frombuffer((_BEFORE + text).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    return codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of a batch in groups of about BATCH_CHARS characters."""
    texts = batch.column("text").to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield at, i + 1, texts[at : i + 1]
            at, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each n-gram of a task's texts occurs in trusted ones (0 for those of other texts only)."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    for batch in small_batches(batches, "text"):
        trusted = batch.column("trusted").to_pylist()
        for a, b, texts in _texts(batch):
            parts = [_grams(_codes(t)) for t in texts]
            grams = np.concatenate(parts)
            weight = np.repeat(np.array(trusted[a:b], np.int64), [p.size for p in parts])
            new, back = np.unique(grams, return_inverse=True)
            sums = np.bincount(back, weight, new.size).astype(np.int64)
            both = np.concatenate([keys, new])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, sums]), keys.size).astype(np.int64)
            if keys.size > 2_000_000:
                yield packed()
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if keys.size:
        yield packed()


def _suffix(column: Column, n: int) -> Column:
    """The last n units of an n-gram."""
    return column if n == ORDER else column.bitwiseAND((1 << 16 * n) - 1)


def _context(column: Column) -> Column:
    return F.shiftrightunsigned(column, 16)


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts, kept within [0, 1], [0, 2], [0, 3]; absent counts leave them at 0.5, 1, 1.5."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*(F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4))).first())
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [float(min(max(d, 0.0), i + 1)) for i, d in enumerate(raw)]


def model(grams: DataFrame) -> DataFrame:
    """(gram, p): the model's probability of the last unit of every n-gram of grams(gram long, n long: its count in trusted text) after the others.

    Highest-order counts are occurrences; a lower order counts how many different units stand before. All counts are grouped sums over
    n-grams, and they meet in equi-joins by n-gram and by context, whose tables Spark shards by key; a context has at most 65,536 entries.
    """
    seen = {ORDER: grams.where("n > 0").select("gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        seen[order] = materialize(seen[order + 1].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n")), f"grams-{order}")
    units = seen[1].count()
    unit = 1.0 / (units + 1)  # the one more stands for all units not seen
    wanted, below = {ORDER: grams.select("gram")}, None
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = wanted[order + 1].select(_suffix(F.col("gram"), order).alias("gram")).distinct()
    for order in range(1, ORDER + 1):
        d = _discounts(seen[order])
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).when(F.col("n") >= 3, d[2]).otherwise(0.0)
        stats = seen[order].groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        rows = wanted[order].join(seen[order], "gram", "left").withColumn("context", _context(F.col("gram"))).join(stats, "context", "left")
        own = F.coalesce((F.col("n") - discount) / F.col("total"), F.lit(0.0))
        back = F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0))
        if below is None:
            rows = rows.withColumn("q", F.lit(unit))
        else:
            rows = rows.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), _suffix(F.col("gram"), order - 1) == F.col("suffix"))
        below = materialize(rows.select("gram", (own + back * F.col("q")).alias("p")), f"model-{order}")
    return below


class _Table:
    """A shard of the model as an open hash table in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * keys.size).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float64), np.zeros(1 << bits, bool)
        at = self._home(keys)
        while keys.size:
            free = np.flatnonzero(~used[at])
            place, which = np.unique(at[free], return_index=True)
            which = free[which]
            self.keys[place], self.values[place], used[place] = keys[which], values[which], True
            left = np.ones(keys.size, bool)
            left[which] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask
        self.used = used

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, 0 for those of other shards."""
        at = self._home(keys)
        out = np.where(self.used[at] & (self.keys[at] == keys), self.values[at], 0.0)
        left = np.flatnonzero(self.used[at] & (self.keys[at] != keys))
        at = (at[left] + 1) & self.mask
        while left.size:
            good = self.used[at] & (self.keys[at] == keys[left])
            out[left[good]] = self.values[at[good]]
            on = self.used[at] & ~good
            left, at = left[on], (at[on] + 1) & self.mask
        return out


def _score(docs: DataFrame, known: DataFrame, shard_rows: int) -> DataFrame:
    """(doc_id, lang, bits, n): the sum of -log2 p over each text's units, shard by shard of the model, and their number.

    A shard is broadcast, its sums are written, and it is taken back before the next one is sent."""
    spark = docs.sparkSession
    shards = max(1, -(-known.count() // shard_rows))
    out = None
    for k in range(shards):
        part = known.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == k).select("gram", (-F.log2("p")).alias("bits")).toArrow()
        sent = spark.sparkContext.broadcast((part.column("gram").to_numpy().view(np.uint64), part.column("bits").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of = None
            for batch in small_batches(batches, "text"):
                of = of or _Table(*sent.value)
                bits, n = [], []
                for _, _, texts in _texts(batch):
                    parts = [_grams(_codes(t)) for t in texts]
                    sizes = np.array([p.size for p in parts])
                    total = np.r_[0.0, np.cumsum(of(np.concatenate(parts)))]
                    ends = np.cumsum(sizes)
                    bits.append(total[ends] - total[ends - sizes])
                    n.append(sizes)
                if bits:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("digest"), pa.array(np.concatenate(bits)), pa.array(np.concatenate(n).astype(np.int64))], ["doc_id", "lang", "digest", "bits", "n"])

        found = docs.mapInArrow(run, "doc_id long, lang string, digest long, bits double, n long")
        if shards > 1:  # one shard is out at a time
            found = materialize(found, "scores")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    if shards > 1:  # rows that repeat another are summed with it, and then come apart again
        out = out.groupBy("doc_id", "lang", "digest", "n").agg(F.sum("bits").alias("bits"), (F.count("*") / shards).cast("int").alias("copies"))
        out = out.select("doc_id", "lang", (F.col("bits") / F.col("copies")).alias("bits"), "n", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "lang", "bits", "n")


def perplexities(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, calibrates, perplexity, n: its units) of every row of docs; calibrates: labelled with quality 1, and not counted. Written to the shared folder."""
    good = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("__good")).distinct()
    aside = F.when(F.col("__good").isNotNull(), F.pmod(F.xxhash64("__good"), F.lit(CALIBRATION)) == 0)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # merged at every size: texts are dealt out by doc_id once, and no list of trusted documents is ever broadcast
    rows = ids.join(good.hint("merge"), F.col("doc_id") == F.col("__good"), "left").select("text", F.coalesce(~aside, F.lit(False)).alias("trusted"))
    grams = rows.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "grams")
    known = model(grams)
    drop_materialized(grams)
    scored = _score(ids.withColumn("digest", F.xxhash64("text")), known, shard_rows).join(good, F.col("doc_id") == F.col("__good"), "left")
    perplexity = F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n")))
    return materialize(scored.select("doc_id", "lang", F.coalesce(aside, F.lit(False)).alias("calibrates"), perplexity.alias("perplexity"), "n"), "perplexities")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, units: int = UNITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, perplexity, threshold, keep) of every row of docs(doc_id, text, lang, ...).

    The model (order 4 over UTF-16 code units, interpolated modified Kneser-Ney) is counted on the whole of all texts labelled with
    quality 1, but for one in CALIBRATION, by a hash of doc_id, that sets the thresholds; every n-gram of every text gets its probability
    by joins with those counts. A text's excess is by how many bits a unit it lies above the median of its language's calibrating
    documents, were it followed by `units` more units at that median. A document is kept if its excess is at most the `quantile` of the
    calibrating documents' in its language; a language with so few of them that fewer than two would lie above takes the quantile of all
    languages' excesses (and from ten documents on one at least lies above it), so that no single document sets a threshold. `threshold`
    is the perplexity which that excess means at the text's length. Quantiles are approximate, to one in ten thousand; a language without
    calibrating documents takes the median of all.

    Defined cases: an empty or null text has no perplexity and no threshold and isn't kept; a null lang is a language of its own; rows
    with a null doc_id are not trusted; repeated rows are counted and scored each; without trusted documents the threshold is null and
    every text with a perplexity is kept; an empty table gives no rows; other columns are ignored.
    """
    scored = perplexities(docs, labels, shard_rows)
    bits, weight = F.log2("perplexity"), F.col("n") / (F.col("n") + units)
    trusted = scored.where("calibrates and perplexity is not null")
    middle = F.percentile_approx(bits, 0.5, 10_000)
    medians = trusted.groupBy(F.col("lang").alias("__lang")).agg(middle.alias("__median"))
    above = trusted.join(medians, F.col("lang").eqNullSafe(F.col("__lang"))).select("__lang", ((bits - F.col("__median")) * weight).alias("__excess"))
    own = F.when(F.count("*") * (1 - quantile) >= 2, F.percentile_approx("__excess", quantile, 10_000))
    by_lang = medians.join(above.groupBy(F.col("__lang").alias("__of")).agg(own.alias("__own")), F.col("__lang").eqNullSafe(F.col("__of")))
    n = trusted.count()
    whole = above.agg(F.percentile_approx("__excess", min(quantile, 1 - 1.5 / n) if n >= 10 else quantile, 10_000).alias("__whole"))
    whole = whole.crossJoin(F.broadcast(trusted.agg(middle.alias("__middle"))))
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").crossJoin(F.broadcast(whole))
    limit = F.coalesce("__median", "__middle") + F.coalesce("__own", "__whole") / weight
    threshold = F.when(F.col("n") > 0, F.pow(F.lit(2.0), limit))
    keep = F.coalesce(F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))), F.lit(False))
    return out.select("doc_id", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
