"""The registered queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ann, bpe, decontam, fill_middle, hard_negatives, html_extract, line_dedup, near_dedup, piece_bpe, pii, quality, token_counts, warc
from .common import bounded_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The key of the registered query; a production run passes its own secret.
DEMONSTRATION_KEY = b"claimwise demonstration key"


def op1_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op2_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return decontam.verdicts(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("longest_match")


def op3_pii_pseudonyms(spark, sf_dir) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY)


def op4_html_extraction(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op5_nearest_neighbours(spark, sf_dir) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op6_line_dedup(spark, sf_dir) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark, sf_dir) -> DataFrame:
    ranks = bpe.load_ranks(RANKS)
    return bpe.encode_with_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=lambda i: ~quality.held_out(i))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                                             (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_warc(spark, sf_dir) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_token_counts(spark, sf_dir) -> DataFrame:
    scores = token_counts.zipf_scores(bpe.load_ranks(RANKS))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scores, public_tokenizers.PATTERN)


def op11_sentencepiece(spark, sf_dir) -> DataFrame:
    model = piece_bpe.load_model(PIECES)
    return piece_bpe.digests(piece_bpe.encode(table(spark, sf_dir, "documents"), model), model)


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label)


def op13_fill_in_middle(spark, sf_dir) -> DataFrame:
    done = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS v FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.v = l.x),
m AS (SELECT doc_id, min(v) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op2_benchmark_decontamination": rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM q),
d AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, k WHERE len(w) >= k),
h AS (SELECT doc_id, item_id, i, q.k AS k FROM d JOIN q ON d.g = q.g AND d.k = q.k),
hit AS (SELECT doc_id, count(DISTINCT v) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS v FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (x)""",
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, a.label AS own, r.vec_id AS b, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS s FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, own, b, s FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND n.label <> p.own AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3""",
    "op13_fill_in_middle": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c""",
}


def _bounded(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _bounded(f) for f in (op1_minhash_near_dedup, op2_benchmark_decontamination, op3_pii_pseudonyms, op4_html_extraction, op5_nearest_neighbours,
                                   op6_line_dedup, op7_byte_bpe, op8_quality_classifier, op9_warc, op10_token_counts, op11_sentencepiece, op12_hard_negatives, op13_fill_in_middle)}
