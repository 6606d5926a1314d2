"""The whole pipeline on the small table against a plain version of it. Only what is fitted, the toxicity model's numbers and each text's
topic, is taken from the library; everything that is decided with them is worked out here."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from brute import inclusion, item_matches, simhash_components, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelode.llm import mixing, topics, toxicity
from codelode.llm.queries import KEPT_SHARE, TARGETS

SF = "/root/testdata/sf0.001"


def toxic(text, model):
    """The network applied to every eight consecutive words, each word the mean of its subwords' vectors."""
    vectors = []
    for w in toxicity.words_of((text or "").encode()):
        found, _ = toxicity.subwords([w], len(model.embedding))
        vectors.append(model.embedding[found].mean(axis=0, dtype=float) if found.size else np.zeros(model.embedding.shape[1]))
    passages = [np.mean(vectors[i : i + 8], axis=0) for i in range(max(1, len(vectors) - 7))] if vectors else [np.zeros(model.embedding.shape[1])]
    logits = [p @ model.weights + model.bias for p in passages]
    return 1 / (1 + np.exp(-(model.scale * max(x[1] - x[0] for x in logits) + model.offset))) >= 0.5


def test_pipeline(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    docs = dict(zip(table["doc_id"], table["text"], strict=True))
    kinds = {i: (s, g) for i, s, g in zip(table["doc_id"], table["source"], table["lang"], strict=True)}
    whole = spark.read.parquet(f"{SF}/documents.parquet")

    model = toxicity.fit(whole, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {i: t for i, t in docs.items() if not toxic(t, model)}

    single = {i: clean[i] for i, (_, c) in simhash_components(clean).items() if i == c}

    rows = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    leaked = {i for i, _, _ in item_matches(single, zip(rows["item_id"], rows["text"], strict=True))}
    free = {i: t for i, t in single.items() if i not in leaked}

    left = whole.where(F.col("doc_id").isin(list(free)))
    topic = {r.doc_id: r["__topic"] for r in topics.assigned(left, topics.fit(left, len(TARGETS["topic"]))).select("doc_id", "__topic").collect()}
    listed = lambda k, name: k if k in TARGETS[name] else None
    cell = {i: (listed(kinds[i][0], "source"), listed(kinds[i][1], "lang"), listed(topic[i], "topic")) for i in free}
    cells = Counter()
    for i, t in free.items():
        cells[cell[i]] += len(words(t))
    chance = inclusion(cells, TARGETS, KEPT_SHARE, mixing.ROUNDS)
    draw = {i: int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) / 16**13 for i in free}
    mixed = sorted(i for i in free if draw[i] < chance[cell[i]])

    tokenizer, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, 0
    for i in mixed:
        ids = [*tokenizer.encode(docs[i] or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(docs) > len(clean) > len(single) >= len(free) > len(mixed) > 0 and len(leaked) > 0
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
