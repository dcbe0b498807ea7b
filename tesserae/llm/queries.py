"""The driver's queries of this subpackage. Each reads whole tables and returns its operator's full result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, fingerprints, ngram_join, packing, pii, quality, suffix_dedup, token_binary, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\t\n\x0B\f\r -/:-@\[-`{-~]+'), lambda x: x <> '') AS ws
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END AS grams FROM w WHERE len(ws) > 0
), c AS MATERIALIZED (
  SELECT md5(array_to_string(grams, '|')) AS c, min(doc_id) AS copy_of, count(*) AS copies, any_value(grams) AS grams FROM s GROUP BY 1
), g AS MATERIALIZED (SELECT c, len(grams) AS n, unnest(grams) AS gram FROM c),
p AS MATERIALIZED (
  SELECT x, y, k / (m + n - k) AS jaccard
  FROM (SELECT a.c AS x, b.c AS y, a.n AS m, b.n AS n, count(*)::DOUBLE AS k FROM g a JOIN g b ON a.gram = b.gram AND a.c <> b.c GROUP BY ALL) WHERE k >= 0.5 * (m + n - k)
), r AS (SELECT c AS x, c AS y FROM c UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
t AS (SELECT r.x AS c, min(c.copy_of) AS class_id FROM r JOIN c ON c.c = r.y GROUP BY 1),
l AS (
  SELECT x AS c, jaccard, copy_of AS nearest_id, sum(copies) OVER (PARTITION BY x) AS links, row_number() OVER (PARTITION BY x ORDER BY jaccard DESC, copy_of) AS k
  FROM p JOIN c ON c.c = p.y
)
SELECT s.doc_id, t.class_id, c.copy_of, c.copies, (c.copies - 1 + coalesce(l.links, 0))::BIGINT AS links, l.nearest_id, l.jaccard
FROM s JOIN c ON c.c = md5(array_to_string(s.grams, '|')) JOIN t ON t.c = c.c LEFT JOIN l ON l.c = c.c AND l.k = 1
WHERE c.copies > 1 OR l.links > 0
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.write_binary(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_tables(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.from_pages(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.withColumn("headers", lines)


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, html, '"' || md5(html) || '"' AS etag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM pages
), q AS (
  SELECT page_id, html, etag,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(u, '^[^/?]*', ''), '([?&])(utm_[a-z_]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS c FROM p
), r AS (
  SELECT n.page_id, n.c, n.etag, o.page_id AS old_id, o.etag AS old_etag, o.html AS old_html,
    row_number() OVER (PARTITION BY n.page_id ORDER BY o.page_id DESC NULLS LAST) AS k
  FROM q n LEFT JOIN q o ON o.c = n.c AND o.page_id < n.page_id + 86400
)
SELECT page_id * 2 + 1 AS record_id, c AS canonical_url, page_id + 86400 AS captured_at, old_id * 2 AS refers_to,
  CASE WHEN old_id IS NULL THEN 'no_response' WHEN etag = old_etag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN etag = old_etag THEN 200 END AS status,
  CASE WHEN etag = old_etag THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || strlen(old_html)::VARCHAR, 'content-type: text/html',
    'date: ' || (page_id + 86400)::VARCHAR, 'etag: W/' || etag, 'server: first') END AS headers,
  CASE WHEN etag = old_etag THEN old_html END AS payload
FROM r WHERE k = 1
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_quality, op4_ngram_join, op5_bpe, op6_token_binary, op7_toxicity, op8_warc, op9_fingerprints, op10_suffix_dedup, pipeline)}
ORACLE_SQL = {"op4_ngram_join": OP4_SQL, "op8_warc": OP8_SQL}
