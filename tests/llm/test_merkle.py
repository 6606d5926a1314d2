"""The Merkle manifest against a tree written from its definition."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codelode.llm import merkle, queries, sha

NAMES = "doc_id long, source string, lang string, n_chars long, text string, g string, row long, pos long, now string, head boolean"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes):
    """Levels of a tree, from its leaves to what remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def fold(levels, place, now):
    siblings = []
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        siblings += run[: place % 8] + run[place % 8 + 1 :]
        run[place % 8], place = now, place // 8
        now = h(*run)
    return now, siblings


def brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    keys = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: climb([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in keys}
    top = climb([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for place, (_, _, own, r) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            third = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            lowered = r[4] if r[4] is None else "".join(c.lower() if c < "\x80" else c for c in r[4])
            now, low = fold(trees[k], place, leaf(r, lowered) if third else own)
            now, high = fold(top, n, now)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], h(*low, *high), now, now == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y", True) for r in rows], NAMES)
    return sorted((tuple(r) for r in merkle.lowered_thirds(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def made(n, lang, at=0):
    r = random.Random(n)
    return [(at + i, r.choice(["a", None, "bé"]), lang, r.choice([None, i]), r.choice([None, "", f"Text {i}", f"text {i}", "Ünï Ç A" * r.randint(1, 300)])) for i in range(n)]


def test_states():
    """Resumed states give hashlib's digests, for any number of blocks."""
    r = np.random.Generator(np.random.PCG64(1))
    digests = r.integers(0, 256, (40, 32), dtype=np.uint8)
    state = np.tile(sha.START, (1, 1))
    for n in range(40):
        assert sha.ended(state, np.array([n]))[0].tobytes() == hashlib.sha256(sha.hex_text(digests[:n]).tobytes()).digest()
        state = sha.absorb(sha.from_bytes(sha.to_bytes(state)), sha.hex_blocks(digests[n : n + 1]))


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 513])
def test_sizes(spark, size):
    rows = made(size, "en")
    assert found(spark, rows) == brute(rows)


def test_langs_nulls_and_repeats(spark):
    rows = made(1100, "en") + made(5, None, 5000) + made(1, "", 6000) + made(9, "zz", 7000) + made(3, "É", 8000)
    rows += [(None, None, "en", None, "Null Id"), (None, None, None, None, None), rows[3], rows[3], (3, "a", "en", 1, "Other Text")]
    rows += [(9000 + i, "s", f"l{i:03}", 1, "One") for i in range(70)]
    assert found(spark, rows) == brute(rows)


def test_blocks_of_a_group_of_more():
    """A last block of one node is raised as far as the others of its group."""
    digests = np.random.Generator(np.random.PCG64(2)).integers(0, 256, (9, 32), dtype=np.uint8)
    trees, tops = merkle.grown(digests, np.array([8, 1]), np.array([1, 1]))
    assert [len(t) for t in trees] == [512, 64]
    assert [x.tobytes().hex() for x in tops] == [h(*(d.tobytes().hex() for d in digests[:8])), h(digests[8].tobytes().hex())]


def test_empty(spark):
    assert found(spark, []) == []


def test_only_tampering_that_changes_a_row_fails(spark):
    rows = queries.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == len(docs) and len({r.root for r in rows}) == 1
    for r in rows:
        t = docs[r.doc_id]
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or t is None or not any("A" <= c <= "Z" for c in t))
