"""The queries of the training-data operators, one for each, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, hard_negatives, html_extraction, importance_sampling, improbable_digest, license_scan, minhash_dedup, packing, periodic_runs, quality_rules, sharding, token_output, warc
from tallyforge.llm._shared import new_folder, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.summary(warc.read_warc(spark, manifest, content=False))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document's first tokens are what it is prompted with.
    return packing.pack(table(spark, sf_dir, "documents"), prompt_tokens=32)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_packed(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"))
    return token_output.read_packed(spark, manifest)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return improbable_digest.against_edits(docs, improbable_digest.rarity(docs))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.with_moved_labels(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OPERATORS = (
    op1_license_scan, op2_quality_rules, op3_decontamination, op4_warc, op5_html_extraction, op6_packing, op7_minhash_dedup, op8_token_output,
    op9_quality_classifier, op10_sharding, op11_periodic_runs, op12_document_fingerprints, op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


_OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS r FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id
), component AS (
  SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.r, d.doc_id) AS component_id, coalesce(c.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.doc_id = d.doc_id
"""

_OP4_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), five AS (
  -- five hex digits are four base-32 digits
  SELECT page_id, payload_bytes, hex, [('0x' || hex[g * 5 + 1:g * 5 + 5])::BIGINT for g in range(8)] AS parts FROM d
), b AS (
  SELECT page_id, payload_bytes, hex, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::INT + 1, 1) for s in [15, 10, 5, 0]], '') for x in parts], '') AS payload_digest FROM five
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM b
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""

_OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": _OP4_SQL, "op7_minhash_dedup": _OP7_SQL, "op13_hard_negatives": _OP13_SQL}
