"""The registered queries on the given tables against the libraries and brute force, the token files' format, and very long texts."""

import glob
import random
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import item_matches, simhash_components, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelode.llm import decontamination, line_dedup, mixing, quality, queries, simhash, token_files, toxicity
from codelode.llm.common import new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(rows["doc_id"], rows["text"], strict=True))


def test_op4(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i] or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_files(spark, SF).collect()} == want


def test_op7(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
    want = sorted((i, len((t or "").encode()), n[i], n[i] > 512) for i, t in docs.items())
    assert sorted(map(tuple, queries.op7_token_counts(spark, SF).collect())) == want


def test_op6(spark, docs):
    """Every window of an item's length against every item, by similarity alone: the radius loses none."""
    rows = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    want = item_matches(docs, zip(rows["item_id"], rows["text"], strict=True))
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in queries.op6_decontamination(spark, SF).collect()}
    assert got == want and len(want) > 2


def test_op9(spark, docs):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()} == simhash_components(docs)


def test_op3_and_op5_and_op10_give_every_document(spark, docs):
    for run, columns in ((queries.op3_mixing, {"doc_id", "n_tokens", "weight", "probability", "sampled"}), (queries.op5_toxicity, {"doc_id", "held_out", "score", "predicted"}), (queries.op10_quality, {"doc_id", "perplexity", "threshold", "keep"})):
        rows = run(spark, SF).collect()
        assert sorted(r.doc_id for r in rows) == sorted(docs) and set(rows[0].asDict()) == columns
        if "n_tokens" in columns:
            assert all(r.n_tokens == len(words(docs[r.doc_id])) for r in rows)
        if "held_out" in columns:
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_held_out_toxicity(spark):
    """A sixth of the toxic labels of this table have no word that clean documents lack, which bounds recall; false alarms are rare."""
    big = "/root/testdata/sf0.1"
    if not Path(big).exists():
        pytest.skip("no larger table")
    documents, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("doc_id", "toxic")
    model = toxicity.fit(documents, labels)
    rows = toxicity.scores(documents.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    hit = sum(r.score >= 0.5 and r.toxic == 1 for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows) and hit >= 0.95 * sum(r.score >= 0.5 for r in rows)


def test_token_files_are_read_in_part(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(50)], k=20))) for i in range(6000)]
    path = new_path(spark, "format")
    tokens = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path("word_bpe_49k.json"), page_rows=64, row_group_bytes=128 << 10)
    [file] = glob.glob(f"{path}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 6000 and meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        assert group.total_byte_size < 256 << 10
        column = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
        assert all(c.has_offset_index and c.has_column_index and c.compression == "ZSTD" for c in column.values())
        assert column["token_ids"].has_dictionary_page and any("DICTIONARY" in e for e in column["token_ids"].encodings)
        for name in ("doc_id", "row", "start_in_shard", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in column[name].encodings and not column[name].has_dictionary_page
    some = tokens.where("doc_id between 3000 and 3010").select("doc_id", "n_tokens")
    assert some.count() == 11 and len(some.collect()) == 11
    scan = some._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.metrics().apply("numOutputRows").value() <= 128  # two pages of 64 rows, of 6000
    assert "token_ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_very_long_texts(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choices([f"w{k}" for k in range(900)], k=6))
    long = "\n".join(line() for _ in range(20_000))  # 120,000 words
    block = [line() for _ in range(3)]
    rows = [(1, long + "\n" + "\n".join(block)), (2, "x\n" + "\n".join(block) + "\ny"), (3, "\n".join(line() for _ in range(3))), (4, long + "\n" + "\n".join(block) + " end")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, fp long")
    kept = {x.doc_id: x for x in line_dedup.dedup_lines(docs).collect()}
    assert kept[1].n_removed == 0 and kept[2].n_removed == 3 and kept[2].kept == "x\ny" and kept[4].n_removed == 20_002 and kept[4].kept == block[-1] + " end"
    mixed = {x.doc_id: x.n_tokens for x in mixing.mix(docs, queries.TARGETS, 0.6).collect()}
    assert mixed == {i: len(words(t)) for i, t in rows}
    model = toxicity.train([b"you are bad", b"nice and good"] * 20, [1, 0] * 20, 0.5)
    bad = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" you are bad you are bad you are"))).otherwise(F.col("text")))
    scores = {x.doc_id: x.score for x in toxicity.scores(bad, model).collect()}
    assert scores[1] > scores[3] and 0 <= min(scores.values())  # at the end of a long text as well
    good = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in quality.perplexities(docs, good).collect()}
    assert found[1].n == len(rows[0][1]) and 1 < found[1].perplexity < found[3].perplexity * 10
    stays = {x.doc_id for x in simhash.keep_representatives(docs).collect()}
    assert 1 in stays and {2, 3} <= stays and 4 not in stays
    bench = spark.createDataFrame([(7, " ".join(words(long)[-40:]))], "item_id long, text string")
    assert {x.doc_id for x in decontamination.keep_uncontaminated(docs, bench).collect()} == {2, 3}
    assert corpus_pipeline.write_token_files(spark, docs, SF).count() == 4


def test_stages_on_repeated_rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    twice = given.unionByName(given.limit(20))
    clean = corpus_pipeline.drop_toxic(spark, twice, SF)
    ids = Counter(x.doc_id for x in clean.collect())
    assert set(ids.values()) == {1, 2}  # a row and its repeat stay or go together
    one = Counter(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, twice, SF).collect())
    assert set(one.values()) == {1}
    free = Counter(x.doc_id for x in corpus_pipeline.drop_contaminated(spark, twice, SF).collect())
    mixed = Counter(x.doc_id for x in corpus_pipeline.mix_sources(spark, twice, SF).collect())
    repeated = {x.doc_id for x in given.limit(20).collect()}
    assert all(free[i] in (0, 2) and mixed[i] in (0, 2) for i in repeated)
    assert corpus_pipeline.write_token_files(spark, twice, SF).count() == twice.count()
