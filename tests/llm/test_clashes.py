"""Columns of any name pass all stages as they are; benchmark items of any length are compared."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import decontamination, lexical, merkle, minhash, mixing, simhash
from codelode.llm.queries import KEPT_SHARE, TARGETS
from codelode.llm.wordhash import word_hashes

INTERNAL = ("__digest", "__kept", "__best", "__lang", "__topic", "__words", "__n", "__N", "__k0", "__K1", "__draw", "__c0", "__weight", "__probability", "__h", "row", "id", "digest", "given", "tokens", "margin0", "margin1", "of", "topic_", "component_id", "fp", "x", "best", "root", "node", "key", "a", "b", "score", "h", "cell", "with.dot", "with space", "Doc Id")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for i, n in enumerate(INTERNAL) if n.lower() not in [m.lower() for m in INTERNAL[:i]]]
    return base.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, docs, stage):
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.select("doc_id").collect())
    assert all(r["__digest"] == f"__digest:{r.doc_id}" and r["with.dot"] == f"with.dot:{r.doc_id}" for r in rows)


def test_last_stage_and_operators(spark, docs):
    n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == n
    assert minhash.near_duplicates(docs).count() == merkle.lowered_thirds(docs).count() == simhash.near_duplicates(docs).count() == mixing.mix(docs, TARGETS, KEPT_SHARE).count() == n
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("*", F.lit(1).alias("doc_id"), F.lit(1).alias("term"), F.lit(1).alias("count"))
    assert lexical.ranked(docs, items, k=3).count() > 0


def test_items_longer_than_a_part(spark):
    r = random.Random(6)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(3000))
    items = spark.createDataFrame([(1, long), (2, "a short item of just eight words here")], "item_id long, text string")
    texts = [(1, f"before {long} after"), (2, "nothing"), (3, " ".join(long.split()[:2900])), (4, "see a short item of just eight words here too"), (5, " ".join(reversed(long.split())))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted((x.doc_id, x.item_id, x.start) for x in decontamination.contaminated(docs, items, item_bytes=1000).collect())
    assert found == [(1, 1, 1), (3, 1, 0), (4, 2, 1)]
    assert sorted(x.doc_id for x in decontamination.keep_uncontaminated(docs, items, item_bytes=1000).collect()) == [2, 5]


def test_window_prints():
    r = random.Random(7)
    shingles = decontamination.shingle_hashes(word_hashes(" ".join(f"w{r.randrange(50)}" for _ in range(300)).encode()))
    for length in (1, 2, 40, shingles.size):
        assert decontamination.window_prints(shingles, length).tolist() == [decontamination.simhash(shingles[i : i + length]) for i in range(shingles.size - length + 1)]


def test_tables_of_windows_and_items_in_steps(monkeypatch):
    texts = [(i, f"w{i} a b c d e f w{i + 1} w{i + 2}".encode()) for i in range(30)]
    items = decontamination.Items(texts)
    prints = np.repeat(items.prints, 3)
    whole = items.within(prints, np.ones(30, bool))
    monkeypatch.setattr(decontamination, "TABLE_CELLS", 70)
    assert all((a == b).all() for a, b in zip(whole, items.within(prints, np.ones(30, bool)), strict=True))
