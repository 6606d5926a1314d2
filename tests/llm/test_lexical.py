"""Ranked search against scores worked out from their definition."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codelode.llm import lexical, queries

NAMES = "doc_id long, text string, n long, terms string, wave int, strongest long, salt long, rank int, term string"
ITEMS = "item_id long, text string, doc_id long, score long"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, k=50):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    joined = {}
    for i, t in items:
        if i is not None:
            joined.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in joined.items():
        scored = []
        for d, c, size in docs:
            m = 100 - 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            scored += [(-s, d)] * (s > 0)
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, *(None,) * 7) for r in docs], NAMES)
    b = spark.createDataFrame([(*r, 5, 6) for r in items], ITEMS)
    return sorted(tuple(r) for r in lexical.ranked(d, b, **options).select("item_id", "rank", "doc_id", "score").collect())


def made(n, m):
    r = random.Random(n)
    vocabulary = [f"{w}{i}" for w in ("Wort", "été", "x") for i in range(60)]
    weights = [1 / (1 + i % 60) for i in range(180)]
    items = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 30)))) for i in range(m)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 80))) + r.choice(["", "!", " " + r.choice(items)[1]])) for i in range(n)]
    return docs, items


def test_ranks(spark):
    docs, items = made(1500, 25)
    docs += [(5000 + i, docs[7][1]) for i in range(90)]  # more equal scores than places
    docs += [(None, docs[3][1]), (6000, None), (6001, ""), (6002, "... --"), (3, docs[3][1]), (3, docs[9][1]), (6003, " ".join([*(t for _, t in docs[:900]), "Wort1 " * 4000]))]
    items += [(100, None), (101, ""), (102, "unheard of"), (None, "Wort1"), (3, "x1 x2"), (103, items[0][1].upper())]
    assert found(spark, docs, items) == brute(docs, items)


def test_parts_and_waves(spark):
    """Items in several parts, one larger than a part; no waves before the last; few places."""
    docs, items = made(300, 12)
    items += [(50, " ".join(f"Wort{i}" for i in range(60)))]
    assert found(spark, docs, items, part_terms=40, k=7) == brute(docs, items, 7)
    assert found(spark, docs, items, waves=()) == brute(docs, items)


def test_empty(spark):
    docs, items = made(3, 2)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, docs, [(1, None)]) == found(spark, [(1, None), (2, "?")], items) == []


def test_pieces():
    text = ("Ab, cd;é " * 50).encode()
    assert [w for p in lexical.term_pieces(text, 7) for w in p] == [w for p in lexical.term_pieces(text) for w in p] == ["ab".encode(), b"cd", "é".encode()] * 50


def test_pairs_of_nodes_are_left_out():
    """Where other documents' scores are below the kth, whole trees are left out, and the result is that of a full search."""
    items = lexical.Items([(1, b"a"), (1, b"b"), (2, b"b"), (2, b"c")])
    items.grow()
    number = [items.vocabulary[t] for t in (b"a", b"b", b"c")]
    r = np.random.Generator(np.random.PCG64(3))
    size = np.full(512, 2)
    terms = np.sort(np.stack([r.permutation(number)[:2] for _ in range(512)]), axis=1).ravel()
    low, high = r.integers(1, 50, 1024), r.integers(60, 99, 1024)
    both = [(np.arange(512), high), (np.arange(512, 1024), low)]
    searched, full = (lexical.Search(items, 5, np.zeros(2, np.int64), np.full(2, lexical._LAST)) for _ in range(2))
    for ids, values in both:
        searched.add(ids, size, terms, values)
        if ids[0] == 0:
            after = searched.scored
    for ids, values in reversed(both):
        full.add(ids, size, terms, values)
    assert searched.scored == after < full.scored
    assert [x.tolist() for x in searched.scores] == [x.tolist() for x in full.scores] and [x.tolist() for x in searched.docs] == [x.tolist() for x in full.docs]


def test_op11(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda name, key: [tuple(r) for r in queries.table(spark, sf, name).select(key, F.col("text")).collect()]
    assert sorted(map(tuple, queries.op11_lexical(spark, sf).collect())) == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
