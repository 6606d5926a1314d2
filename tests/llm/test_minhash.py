"""MinHash near-dedup against all pairs of full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import minhash, queries

NAMES = "doc_id long, text string, n long, row long, node long, digest string, least long, key long, slot long"


def words(t):
    return (t or "").encode().lower().split()


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    on = [n for n, s in enumerate(sets) if s and rows[n][0] is not None]
    for k, a in enumerate(on):
        for b in on[:k]:
            if 10 * min(len(sets[a]), len(sets[b])) >= 8 * max(len(sets[a]), len(sets[b])) and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for n in on:
        least[find(n)] = min(least.get(find(n), rows[n][0]), rows[n][0])
    out = []
    for n, (i, _) in enumerate(rows):
        c = i if i is None or not sets[n] else least[find(n)]
        out.append((i, len(sets[n]), c, None if i is None else c == i))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5, 6) for r in rows], NAMES)
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(2000)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    boiler = text(40)
    texts = [text(r.randint(1, 90)) for _ in range(120)] + [f"{text(60)} {boiler} {text(60)}" for _ in range(80)]
    for n in (30, 100, 150):
        texts += copies(r, text(n), 120, n // 8)  # similarities on both sides of 0.8
    texts += [t for t in texts[:20]] + [t.upper() for t in texts[20:30]] + ["one", "ONE", "one two", "two one", "a b a b a b", "a b a"]
    texts += [None, "", " \t\n", "Ünï x", "ünï x", text(9000)]
    texts.append(texts[-1] + " more")
    r.shuffle(texts)
    out = list(enumerate(texts))
    return out + [(None, texts[3]), (None, None), out[5], out[5], (7, texts[8]), (9, texts[150])]


def test_links(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_tiles(spark, rows):
    """Cells of more members or bytes than a task takes give the same components."""
    assert found(spark, rows, cell_rows=7) == found(spark, rows, cell_bytes=3000) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, "a b"), (2, None)]) == [(1, 1, 1, True), (2, 0, 2, True)]


def test_matches_lose_nothing():
    """Pairs at 0.80 and little more have MATCHES coordinates in common, and a post of both prefixes, however posts are ordered."""
    r = np.random.Generator(np.random.PCG64(5))
    for _ in range(300):
        n = int(r.integers(9, 400))
        hashes = r.integers(0, 2**63, 10 * n, dtype=np.uint64)
        a, b = np.sort(hashes[: 9 * n]), np.sort(hashes[n:])  # 8 n of 10 n
        a, b = minhash.signature(a), minhash.signature(b)
        assert (a == b).sum() >= minhash.MATCHES
        order = r.permutation(minhash.COORDINATES)
        assert any(a[i] == b[i] for i in order[: minhash.PREFIX] if i in order[: minhash.PREFIX])


def test_op12(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", F.col("text")).collect()]
    assert sorted((tuple(r) for r in queries.op12_minhash(spark, sf).collect()), key=repr) == brute(docs)
