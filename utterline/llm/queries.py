"""The ten operators and the pipeline as registered queries: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lm, ngram_join, packing, pii, quality, rules, substrings, token_store
from .common import read_table, stage


def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digests(spark, token_store.write_store(read_table(spark, sf_dir, "documents")))


def op3_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymize(read_table(spark, sf_dir, "documents"), pii.TEST_KEY)
    return docs.select("doc_id", "text", "n_pii", *(F.coalesce(F.col("pii_kinds")[k], F.lit(0)).alias(f"n_{k}") for k in ("card", "phone", "ssn", "date", "ip", "iban", "email", "secret")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(read_table(spark, sf_dir, "documents")))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), training=~quality.held_out())
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lm.score(docs, *lm.fit(docs, ~lm.held_out()))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stage(rules.measures(read_table(spark, sf_dir, "documents")), "measures")
    learned = rules.learn(measured, read_table(spark, sf_dir, "labels"))
    failed = rules.base_failed()
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.verdict(learned)).alias("kept"))


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9's model counts exactly, without the filter's scores."""
    return op9_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def rule_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's rules look at, without a learned list."""
    measured = rules.measures(read_table(spark, sf_dir, "documents"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_neighbours, op2_token_store, op3_byte_pairs, op4_ngram_join, op5_pseudonyms, op6_packing, op7_repeated_substrings, op8_quality, op9_language_model, op10_quality_rules, language_model_base, rule_measures)}

#: Every query against every other row.
_OP1 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Exact links and groups on the whole table, by an inverted index of n-grams.
_OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id,
  least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id)) AS class_id,
  (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links,
  coalesce((SELECT count(*) FROM sizes s WHERE s.k = z.k), 1) AS n_copies
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

#: Every 100-byte string of every text, as hexadecimal digits; those that aren't the first of equals cover what goes.
_OP7 = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
f AS (SELECT s, arg_min(doc_id, (doc_id, p)) AS first_doc, min((doc_id, p)) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE (doc_id, p) <> first),
e AS (SELECT doc_id, p, CASE WHEN p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
g AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

#: CRC-32 bit by bit, as DuckDB has none.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"

_OP9_BASE = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id
"""

_OP10_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""

ORACLES = {"op1_hilbert_neighbours": _OP1, "op4_ngram_join": _OP4, "op7_repeated_substrings": _OP7, "language_model_base": _OP9_BASE, "rule_measures": _OP10_BASE}
