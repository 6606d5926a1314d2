"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelode.llm import decontamination, encoding, line_dedup, mixing, quality, simhash, substring_dedup, token_counts, token_files, topk, toxicity, wordhash
from codelode.llm.common import new_path
from codelode.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, at string, digest string, id long, name string, n long, lists string, trusted boolean"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, rows):
    """Rows of (doc_id, text, ...) with more columns, of names that operators use themselves."""
    full = [(*r, *((None,) * 4))[:4] + (None, 7, "x", "y", 9, "z", 1, "l", True) for r in ((*r, "en", "src0")[:4] for r in rows)]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(30)]
    shared = " ".join(r.choices(WORDS, k=25))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)]  # copies
    rows += [(200 + i, f"{base[i]} {shared} {base[i + 1]}") for i in range(8)]  # a passage in many
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "a b"), (304, "a b c"), (305, " ".join(r.choices(WORDS, k=30_000))), (None, base[0]), (None, None)]
    return rows + [(3, base[3]), (3, base[3]), (5, base[9])]  # repeated rows, and one id with two texts


def words(t):
    return [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 9. SimHash


def brute_fingerprint(t):
    w = words((t or "").lower())
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    prints = [(i, brute_fingerprint(t)) for i, t in texts]
    group = {fp: fp for _, fp in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    with_id = sorted({fp for i, fp in prints if i is not None})
    for a in with_id:
        for b in with_id:
            if (a ^ b).bit_count() <= 2 and root(a) != root(b):
                group[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for i, fp in prints:
        if i is not None:
            least[root(fp)] = min(least[root(fp)], i)
    want = sorted(((i, f"{fp:016x}", None if i is None else least[root(fp)]) for i, fp in prints), key=repr)
    assert rows_of(simhash.near_duplicates(table(spark, texts)).select("doc_id", "fingerprint", "component_id")) == want
    kept = simhash.keep_representatives(table(spark, texts))
    assert kept.columns == table(spark, []).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, _, c in want if i is not None and i == c}) and ids.count(None) == 2
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_links_join_what_belongs_together():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 400, dtype=np.uint64)
    one = x[:200] ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64))
    two = one[:100] ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64))
    cluster = x[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fp = np.unique(np.concatenate([x, one, two, cluster]))
    pairs = [(a, c) for i, a in enumerate(fp) for c in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ a) <= 2]]
    want = _components([p[0] for p in pairs], [p[1] for p in pairs], fp)
    cells = simhash.cells_of(simhash.pivot_table(fp))
    place = {int(v): i for i, v in enumerate(fp)}
    assert all((cells[place[int(a)]] == cells[place[int(c)]]).any() for a, c in pairs)
    assert all((cells[i] == cells[i]).all() and len(set(cells[i])) == 6 for i in range(5))
    seen = Counter()
    assert _components(*simhash.near_in_cells(cells.ravel(), np.repeat(fp, 6), seen=seen), fp) == want
    assert seen["met"] > seen["discarded"] > 0 and seen["verified"] > 0 and seen["met"] < fp.size * (fp.size - 1) / 20  # distances to pivots do the discarding
    # distances to pivots differ by no more than the fingerprints do
    t = simhash.pivot_table(fp).astype(int)
    assert all(np.abs(t[place[int(a)]] - t[place[int(c)]]).max() <= 2 for a, c in pairs)


def test_hot_cells_lose_no_link(spark):
    r = np.random.default_rng(2)
    fp = [int(x) for x in r.integers(0, 2**64, 60, dtype=np.uint64)]
    for _ in range(900):  # near copies of one text: chains of few bits around it
        v = fp[0]
        for b in r.choice(64, int(r.integers(0, 4)), replace=False):
            v ^= 1 << int(b)
        fp.append(v)
    fp = np.unique(np.array(fp, np.uint64))
    pairs = [(a, c) for i, a in enumerate(fp) for c in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ a) <= 2]]
    want = _components([p[0] for p in pairs], [p[1] for p in pairs], fp)
    rows = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for cell_rows in (4, 100_000):
        links = simhash.link_fingerprints(rows, cell_rows).collect()
        ends = np.array([(x.a, x.b) for x in links], np.int64).view(np.uint64)
        assert _components(ends[:, 0], ends[:, 1], fp) == want and len(links) <= 70 * fp.size


def _components(a, b, nodes):
    parent = {int(n): int(n) for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(int(x)), root(int(y))
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in parent}


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 90)]
    rows = [*pairs, (7, 7), (1, 0), (None, 3)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = _components([p[0] for p in pairs], [p[1] for p in pairs], {n for p in pairs for n in p})
    assert got == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5. Toxicity


def test_toxicity(spark):
    r = random.Random(1)
    bad = ["idiot", "moron", "stupid"]
    docs = []
    for i in range(400):
        w = r.choices(WORDS, k=r.randint(5, 200))
        if i % 4 == 0:
            for _ in range(1 + len(w) // 40):
                b = r.choice(bad)
                w.insert(r.randrange(len(w)), b if i < 300 else b + b[-1])  # misspelt where no label is learnt from
        docs.append((i, " ".join(w)))
    docs += [(None, None), (900, ""), (901, None), (0, docs[0][1])]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, docs), labels).collect()
    assert len(got) == len(docs)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
    right = lambda want, ids: sum(x.predicted == want for x in got if x.doc_id in ids) / len(ids)
    held = [x.doc_id for x in got if x.held_out and x.doc_id < 300]
    assert right(1, {i for i in held if i % 4 == 0}) > 0.9 and right(0, {i for i in held if i % 4}) > 0.95
    # misspelt words, never seen, share n-grams with those seen: they rank above clean text
    odd, clean = ([x.score for x in got if x.doc_id in ids] for ids in (set(range(300, 400, 4)), {i for i in range(400) if i % 4}))
    assert sum(a > b for a in odd for b in clean) / len(odd) / len(clean) > 0.9
    none = toxicity.toxicity(table(spark, docs), labels.limit(0))
    assert {round(x.score, 5) for x in none.collect()} == {1e-6 and round(none.first().score, 5)}
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
    kept = toxicity.keep_clean(table(spark, docs), toxicity.fit(table(spark, docs), labels))
    assert kept.columns == table(spark, []).columns and kept.where("doc_id is null").count() == 1


# 8. Substring dedup


def brute_substrings(rows, n):
    low = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, 2**63), low(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < low(i) for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "bucket"), [(13, 1 << 24), (4, 20_000)])
def test_substrings(spark, texts, window, bucket):
    got = substring_dedup.dedup_substrings(table(spark, texts).repartition(5), window, bucket)
    assert rows_of(got) == brute_substrings(texts, window)
    assert substring_dedup.dedup_substrings(table(spark, [])).count() == 0


def test_word_hashes(monkeypatch):
    text = "Über  den\tWolken \n\x0b x é" + " wort" * 500
    whole = wordhash.word_hashes(text.encode())
    assert whole.size == len(text.encode().split()) and whole[6] == whole[-1]
    monkeypatch.setattr(wordhash, "PIECE", 37)
    assert (wordhash.word_hashes(text.encode()) == whole).all()
    assert wordhash.word_hashes(b"x" * 200).size == 1 and wordhash.word_hashes(b" ").size == 0


# 2. Line dedup


def test_lines(spark):
    shared = "p\nq\nr"
    rows = [(1, f"a\nb\n{shared}\nc"), (2, f"{shared}\nd"), (3, f"x\n{shared}\n{shared}"), (4, "p\nq"), (5, None), (6, ""), (7, "s\ns\ns\ns\ns"), (None, shared), (8, "u\nv\nw"), (8, "u\nv\nw")]
    key = lambda r: (-(2**63) if r[0] is None else r[0])
    first = {}
    for r in sorted(rows, key=key):
        lines = (r[1] or "").split("\n")
        for k in range(len(lines) - 2):
            first.setdefault(tuple(lines[k : k + 3]), (r[0], r[1], k))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = {k + j for k in range(len(lines) - 2) if first[tuple(lines[k : k + 3])] != (i, t, k) for j in range(3)}
        want.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    assert rows_of(line_dedup.dedup_lines(table(spark, rows))) == sorted(want, key=repr)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


# 1. Top-k


@pytest.mark.parametrize(("shard", "block"), [(4096, 512), (7, 3)])
def test_topk(spark, shard, block):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)], i) for i in range(60)]
    rows += [(70 + i, rows[0][1], 0) for i in range(12)]  # ties
    rows += [(90, None, 0), (91, [1.0, None, 0.0, 0.0, 0.0], 0), (92, [float("nan")] * 5, 0), (93, [float("inf")] * 5, 0), (94, [], 0), (95, [0.5, 0.5], 0), (None, [0.1] * 5, 0), (50, rows[1][1], 1), (2, rows[2][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in good if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), j) for i, v in good if i == q for j, c in good if j != q and len(c) == len(v))
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(scored[:5])}
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, shard=shard, block=block).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id = 3"), F.lit(True)).count() == 0


def test_exact_products():
    big = np.array([[2**40, 3], [2**20, 1]], np.int64)
    assert topk.product(big[1:], big[1:]).tolist() == [[2**40 + 1]]
    with pytest.raises(OverflowError):
        topk.product(big, big)


# 3. Mixing


def test_rake_meets_margins():
    r = np.random.default_rng(0)
    tokens = r.integers(1, 100, (3, 4, 2)).astype(float)
    tokens[0, 0, 0] = 0
    targets = [np.array(t) for t in ([0.5, 0.3, 0.2], [0.1, 0.2, 0.3, 0.4], [0.5, 0.5])]
    w = mixing.rake(tokens, targets)
    for axis, t in enumerate(targets):
        share = (w * tokens).sum(axis=tuple(i for i in range(3) if i != axis)) / tokens.sum()
        assert np.allclose(share, t, atol=1e-8)
    p = mixing.calibrate(tokens, w, 0.3)
    assert np.isclose((p * tokens).sum(), 0.3 * tokens.sum()) and p.max() <= 1
    assert np.isclose((mixing.calibrate(tokens, w, 1.0) * tokens).sum(), tokens.sum())
    assert (mixing.rake(tokens * 0, targets) == 1).all()


def test_mix(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 40))), r.choice(["en", "en", "de", None]), r.choice(["src0"] * 4 + ["src1", "odd"])) for i in range(3000)]
    rows += [(None, "a b", "en", "src0"), (None, None, "en", "src0"), (5000, None, "de", "src1"), (5001, "", "zz", "zz"), rows[0], rows[0]]
    targets = {"source": {"src0": 0.4, "src1": 0.6}, "lang": {"en": 0.7, "de": 0.3}, "topic": {f"t{i}": 1 / 8 for i in range(8)}}
    df = table(spark, rows)
    got = mixing.mix(df, targets, 0.5).collect()
    assert len(got) == len(rows) and all(0 <= x.probability <= 1 for x in got)
    total = sum(len(words(t)) for _, t, *_ in rows)
    assert abs(sum(x.n_tokens * x.probability for x in got) / total - 0.5) < 1e-6
    assert abs(sum(x.n_tokens for x in got if x.sampled) / total - 0.5) < 0.05
    by_id = {x.doc_id: x for x in got if x.doc_id is not None}
    tokens = Counter()
    for i, t, lang, _ in rows:
        if i is not None and i < 5000 and lang in ("en", "de"):
            tokens[lang] += by_id[i].weight * len(words(t))
    assert abs(tokens["en"] / (tokens["en"] + tokens["de"]) - 0.7) < 0.01
    assert len({(x.probability, x.sampled) for x in got if x.doc_id == 0}) == 1
    draw = int(hashlib.md5(b"3:17").hexdigest()[:13], 16) / 16**13
    assert by_id[17].sampled == (draw < by_id[17].probability)
    kept = mixing.sample(df, targets, 0.5)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x.doc_id for x in got if x.sampled), key=repr)
    assert mixing.mix(table(spark, []), targets, 0.5).count() == 0


# 4 and 7. Tokens

ODD = ["", "  a  b\n\n c \t d", "it's <|endoftext|> DON'T x’s  ", "ÅΩ ß123 4５", "a \n  b", " x", "\n", "end.\n\nNext, one.", "a,b. c,. ,", "naïve é ª²", "ÀÉÎ x's 'S 'll", "tab\there", "x\r\ny", "a\x0bb\x1cc"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoding_is_the_librarys(name, texts):
    path, many = public_tokenizers.path(name), ODD + [t or "" for _, t in texts]
    if name.endswith(".model"):
        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(many)
    else:
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(many, add_special_tokens=False)]
    for _ in range(2):  # the second time from what is remembered
        assert [np.frombuffer(x, "<u4").tolist() for x in encoding.id_bytes(path, many)] == want
        assert encoding.counts(path, many) == [len(x) for x in want]


def test_encoding_forgets_within_bounds(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = encoding.Encoder(path, "count")
    many = [" ".join(WORDS[i : i + 9]) + ", end." for i in range(0, 300, 3)]
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(many, add_special_tokens=False)]
    assert [sum(x) for i in range(0, 100, 5) for x in e.pieces(many[i : i + 5])] == want
    assert len(e.known) + len(e.before) < 150


def test_token_files(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = new_path(spark, "test-tokens")
    tokens = token_files.write_tokens(table(spark, texts), out, path, file_bytes=20_000, page_rows=8)
    assert tokens.select("shard").distinct().count() > 3
    got = token_files.digests(tokens).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in texts), key=lambda i: -1 if i is None else i)
    assert [r.start for r in order] == np.r_[0, np.cumsum([r.n_tokens for r in order])[:-1]].tolist()
    ids = lambda t: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1]
    want = Counter((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in texts)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    one = token_files.read_tokens(spark, out).where("doc_id = 205").select("n_tokens", "token_ids").collect()
    assert len(one) == 1 and len(one[0].token_ids) == one[0].n_tokens
    assert token_files.token_digests(table(spark, []), path).count() == 0


def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = token_counts.new_cache(spark)
    want = sorted(((i, len((t or "").encode()), n, n > 20) for i, t in texts for n in [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids)]), key=repr)
    assert rows_of(token_counts.count_tokens(table(spark, texts[:20]), cache, path, 20)) != want
    some = token_counts.read_cache(spark, cache).count()
    assert some == len({t or "" for _, t in texts[:20]})
    for _ in range(2):
        assert rows_of(token_counts.count_tokens(table(spark, texts), cache, path, 20)) == want
        assert token_counts.read_cache(spark, cache).count() == len({t or "" for _, t in texts})
    other = token_counts.count_tokens(table(spark, texts[:5]), cache, public_tokenizers.path("piece_bpe_32k.model")).count()
    assert other == 5 and token_counts.read_cache(spark, cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(table(spark, []), token_counts.new_cache(spark), path).count() == 0


# 6. Decontamination


def test_decontamination(spark):
    r = random.Random(9)
    pick = lambda n: r.choices(WORDS, k=n)
    items = [(i, " ".join(pick(n))) for i, n in enumerate((20, 33, 60, 20, 3, 12))] + [(90, None), (91, " "), (None, " ".join(pick(15)))]
    w = {i: words(t) for i, t in items if i is not None}
    changed = list(w[2])
    changed[0], changed[59] = "other", "words"
    docs = [
        (1, " ".join(pick(50) + w[0] + pick(20))), (2, " ".join(pick(5) + changed + pick(9))), (3, " ".join(w[1]).upper()), (4, " ".join(w[1][:16] + pick(3) + w[1][16:])), (5, " ".join(pick(9) + w[4] + pick(2))),
        (6, " ".join(pick(300))), (7, None), (8, ""), (9, "  ".join(w[3]) + "\n" + " ".join(w[3])), (None, " ".join(w[5])), (1, " ".join(w[0])), (10, " ".join(w[5][:9])), (11, " ".join(pick(4000) + words(items[-1][1]))),
    ]
    want = set()
    for d, text in docs:
        for i, item in items:
            x, t = words((item or "").lower()), words((text or "").lower())
            k = min(5, len(x))
            if not x:
                continue
            grams = lambda v, k=k: Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            best = None
            for s in range(len(t) - len(x) + 1):
                a, b = grams(t[s : s + len(x)]), grams(x)
                both = (a & b).total()
                sim = both / (a.total() + b.total() - both)
                if sim >= 0.8 and (best is None or sim > best[1]):
                    best = (s, sim)
            if best:
                want.add((d, i, best[0], len(x), round(best[1], 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (8 << 20, 500):  # in one part, and in several
        got = {(x.doc_id, x.item_id, x.start, x.n_words, round(x.similarity, 9)) for x in decontamination.contaminated(table(spark, docs), bench, item_bytes=limit).collect()}
        assert got == want
    assert (9, 3, 0, 20, 1.0) in want and len(want) >= 8
    kept = decontamination.keep_uncontaminated(table(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d is not None and d not in {x[0] for x in want}) and kept.columns == table(spark, []).columns
    assert decontamination.contaminated(table(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.contaminated(table(spark, []), bench).count() == 0


def test_index_holds_all_within_radius():
    r = random.Random(5)
    items = decontamination.Items([(i, " ".join(WORDS[i : i + 30]).encode()) for i in range(9)])
    prints = []
    for _ in range(300):
        fp = int(items.prints[4])
        for b in r.sample(range(64), r.randint(0, decontamination.RADIUS + 6)):
            fp ^= 1 << b
        prints.append(fp)
    row, item = items.within(np.array(prints, np.uint64), np.ones(9, bool))
    want = {(i, k) for i, fp in enumerate(prints) for k in range(9) if (fp ^ int(items.prints[k])).bit_count() <= decontamination.RADIUS}
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == want and len(want) > 200


def test_the_radius_loses_no_similar_window():
    r = random.Random(12)
    grams = lambda v: Counter(tuple(v[j : j + 5]) for j in range(len(v) - 4))
    far = tried = 0
    while tried < 400:
        item = [f"u{r.randrange(10**6)}" for _ in range(r.choice((40, 57, 100, 200)))]
        near = list(item)
        for i in r.sample(range(len(item)), max(1, len(item) // 44)):
            near[i] = "other"
        near[len(near) - r.randrange(4) :] = []
        near += ["end"] * (len(item) - len(near))
        a, b = grams(item), grams(near)
        both = (a & b).total()
        similarity = both / (a.total() + b.total() - both)
        if not 0.8 <= similarity <= 0.84:
            continue
        tried += 1
        items = decontamination.Items([(4, " ".join(item).encode())])
        text = " ".join(["w"] * 7 + near + ["w"] * 7).encode()
        found = items.matches(text, 0.8)
        assert [x[0] for x in found] == [4] and found[0][4] >= similarity
        far += found[0][3] > 15
    assert far > 0  # a radius of 15 would lose these


def test_documents_shorter_than_an_item(spark):
    item = [f"u{i}" for i in range(40)]
    docs = [(1, " ".join(item[:38])), (2, " ".join(item[:30])), (3, " ".join(item[2:])), (4, "u1 u2"), (5, " ".join(item[:5])), (6, " ".join(WORDS[:20]))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "u1 u2 u3")], "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.start, x.n_words, round(x.similarity, 9)) for x in decontamination.contaminated(table(spark, docs), bench).collect()}
    long = {(i, 7, 0, 38, round(34 / 36, 9)) for i in (1, 3)}
    assert got == long | {(i, 8, s, 3, 1.0) for i, s in ((1, 1), (2, 1), (5, 1))}
    assert sorted(r.doc_id for r in decontamination.keep_uncontaminated(table(spark, docs), bench.where("item_id = 7")).collect()) == [2, 4, 5, 6]


# 10. Quality


def brute_model(trusted, wanted):
    """Interpolated modified Kneser-Ney of order 4, from its definition."""
    grams = lambda t: [("\x02\x02\x02" + t)[i : i + 4] for i in range(len(t))]
    counts = {4: Counter(g for t in trusted for g in grams(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {}
    for k, c in counts.items():
        n = Counter(min(v, 5) for v in c.values())
        if not n[1] or not n[2]:
            disc[k] = [0.5, 1.0, 1.5]
            continue
        y = n[1] / (n[1] + 2 * n[2])
        disc[k] = [min(max(d, 0), i + 1) for i, d in enumerate([1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5])]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        below = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        if not below:
            return lower
        d = lambda v: disc[k][min(v, 3) - 1] if v else 0
        total = sum(below.values())
        return (below.get(g, 0) - d(below.get(g, 0))) / total + sum(map(d, below.values())) / total * lower

    return {g: p(g) for t in wanted for g in grams(t)}, grams


@pytest.mark.parametrize("shard_rows", [1_000_000, 150])
def test_quality(spark, shard_rows):
    r = random.Random(6)
    syllables = ["an", "the", "re", "ing", "on", "ti"]
    prose = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))
    docs = [(i, prose(r.randint(5, 40)), "en" if i % 2 else "de") for i in range(60)] + [(100 + i, " ".join(f"{w}$%&" for w in prose(12).split()), "en") for i in range(6)]
    docs += [(200, None, "en"), (201, "", None), (202, prose(20), None), (None, prose(8), "fr"), (203, "日本 \U0001f600", "en"), docs[3]]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(100, 0, 0), (51, None, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality.perplexities(table(spark, docs), labels, shard_rows).collect()
    assert Counter(x.doc_id for x in scored) == Counter(d[0] for d in docs)
    aside = {x.doc_id for x in scored if x.calibrates}
    assert 0 < len(aside) < 25
    trusted = [t for i, t, _ in docs if i is not None and i < 50 and i not in aside]
    texts = {i: t for i, t, _ in docs}
    known, grams = brute_model(trusted, [texts[i] for i in (55, 101, 202, 3)])
    by_id = {x.doc_id: x.perplexity for x in scored}
    for i in (55, 101, 202, 3):
        g = grams(texts[i])
        assert by_id[i] == pytest.approx(2 ** (-sum(np.log2(known[x]) for x in g) / len(g)), rel=1e-9)
    assert by_id[200] is None and by_id[201] is None
    out = {x.doc_id: x for x in quality.quality(table(spark, docs), labels, shard_rows=shard_rows).collect()}
    assert not any(out[100 + i].keep for i in range(6)) and sum(out[i].keep for i in range(60)) >= 54 and not out[200].keep
    free = quality.quality(table(spark, docs), labels.limit(0)).collect()
    assert all(x.keep == (x.perplexity is not None) and x.threshold is None for x in free)
    assert quality.quality(table(spark, []), labels).count() == 0


def test_quality_threshold_is_no_single_documents(spark):
    r = random.Random(8)
    syllables = ["an", "the", "re", "ing", "on", "ti"]
    prose = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))
    odd = lambda: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(60))
    aside = {x.id for x in spark.range(400).where("pmod(xxhash64(id), 10) = 0").collect()}
    one, short = sorted(aside)[:2]
    docs = [(i, prose(r.randint(20, 60)), "de" if i % 8 == 0 else "en") for i in range(400) if i not in (one, short)]
    docs += [(one, odd(), "en"), (short, "zq.", "en")] + [(500 + i, f"{prose(15)} {odd()}", ("en", "de")[i % 2]) for i in range(10)]
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, *_ in docs], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.quality(table(spark, docs), labels).collect()}
    assert 30 < len(aside) < 50 and not out[one].keep and not any(out[500 + i].keep for i in range(10))
    assert sum(out[i].keep for i in range(400)) > 380
    # the same excess is a higher perplexity in a shorter text
    assert out[short].threshold > max(out[i].threshold for i in range(400) if i not in (one, short))
