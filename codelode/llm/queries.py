"""The registered queries of the corpus operators, one for each, over whole tables, and their SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import decontamination, lexical, line_dedup, merkle, merkle_sql, minhash, mixing, quality, simhash, substring_dedup, token_counts, token_files, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Production parameters of the mix: shares of tokens by language, an equal share for each of the twenty sources, and fitted topics, of
#: which rare ones gain.
TOPICS = 8
TARGETS = {
    "source": {f"src{i}": 1 / 20 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.18, "es": 0.12},
    "topic": {f"t{i}": None for i in range(TOPICS)},
}
KEPT_SHARE = 0.6


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(lines, i + 1, i + 3), chr(10))) AS h FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM h),
c AS (SELECT DISTINCT doc_id, i + k.k AS line FROM r CROSS JOIN (VALUES (0), (1), (2)) k(k) WHERE n > 1),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM d),
x AS (SELECT l.doc_id, l.line, l.i, c.line IS NOT NULL AS gone FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.line = l.i)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS, KEPT_SHARE)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache that is new, so each call counts everything."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.new_cache(spark), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


OP8_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 13), ' ')) AS h FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h),
c AS (SELECT DISTINCT doc_id, i + k.k AS i FROM m CROSS JOIN range(13) k(k) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
g AS (SELECT x.doc_id, count(*) AS n, count(c.i) AS gone, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_filter(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TERMS = _TERMS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT id, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
x AS (SELECT id, unnest(t) AS term FROM d),
f AS (SELECT id, term, count(*) AS tf FROM x GROUP BY id, term),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f CROSS JOIN s WHERE term IN (SELECT term FROM i) GROUP BY term),
p AS (SELECT i.item_id, n.doc_id, f.id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + ((50 * n.n * s.docs) // s.length))))) AS BIGINT) AS score
  FROM i JOIN f ON f.term = i.term JOIN w ON w.term = i.term JOIN n ON n.id = f.id CROSS JOIN s GROUP BY i.item_id, n.doc_id, f.id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || {_SPACES}, 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id > y.doc_id GROUP BY x.doc_id, y.doc_id),
k AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, coalesce(m.least, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.lowered_thirds(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk, op2_line_dedup, op3_mixing, op4_token_files, op5_toxicity, op6_decontamination, op7_token_counts, op8_substring_dedup, op9_simhash, op10_quality, op11_lexical, op12_minhash, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op2_line_dedup": OP2_SQL, "op8_substring_dedup": OP8_SQL, "op11_lexical": OP11_SQL, "op12_minhash": OP12_SQL, "op13_merkle": merkle_sql.SQL}
