"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.functions.keys import key
from lorecast.operators.references import orphan_references, orphan_report, pair_orphans, pair_references
from lorecast.operators.skew import salted_join
from lorecast.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return pair_orphans(*(table(spark, d, t) for t in ("eval_qa_pairs", "eval_datasets", "document_chunks", "operation_logs")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("created_at")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p1_chunk_parents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose (doc_id, kb_id) occurs in no document, a null in either matching anything."""
    chunks = table(spark, d, "document_chunks").select("id", key("doc_id").alias("doc_id"), key("kb_id").alias("kb_id")).distinct()
    docs = table(spark, d, "documents").select(key("id").alias("doc_id"), key("kb_id").alias("kb_id"))
    return orphan_references(chunks, docs, ["doc_id", "kb_id"], "partial").select(F.col("id").alias("chunk_id"), "doc_id", "kb_id")


def p1_base_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Expected chunks that don't exist in the base of the pair's dataset; without a known base the chunk id alone must match."""
    refs = pair_references(table(spark, d, "eval_qa_pairs")).where("ref_field = 'expected_chunk_ids'").select("qa_id", F.col("ref_id").alias("chunk_id"))
    pairs = table(spark, d, "eval_qa_pairs").select(key("id").alias("qa_id"), key("dataset_id").alias("dataset_id")).distinct()
    sets = table(spark, d, "eval_datasets").select(key("id").alias("dataset_id"), key("kb_id").alias("kb_id")).distinct()
    based = salted_join(pairs, sets, ["dataset_id"], "left", F.col("qa_id")).select("qa_id", "kb_id")
    chunks = table(spark, d, "document_chunks").select(key("id").alias("chunk_id"), key("kb_id").alias("kb_id"))
    named = refs.dropna().distinct().join(based, "qa_id", "left")
    return orphan_references(named, chunks, ["chunk_id", "kb_id"], "partial").select("qa_id", "chunk_id", "kb_id").distinct()


_KEY = "nullif(lower(regexp_replace({0}, '^[\\s\\x{{00A0}}\\x{{200B}}\\x{{3000}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{200B}}\\x{{3000}}\\x{{FEFF}}]+$', '', 'g')), '')"
K = _KEY.format
_ORPHANS = f"""
WITH refs AS (
  SELECT {K('id')} AS qa_id, 'dataset_id' AS ref_field, {K('dataset_id')} AS ref_id, created_at FROM eval_qa_pairs
  UNION
  SELECT qa_id, 'expected_chunk_ids', {K('raw')}, created_at
  FROM (SELECT {K('id')} AS qa_id, unnest(expected_chunk_ids) AS raw, created_at FROM eval_qa_pairs)
), records AS (
  SELECT ref_field, ref_id, min(record_at) AS record_at FROM (
    SELECT 'dataset_id' AS ref_field, {K('id')} AS ref_id, created_at AS record_at FROM eval_datasets
    UNION ALL SELECT 'expected_chunk_ids', {K('id')}, created_at FROM document_chunks) GROUP BY 1, 2
), gone AS (SELECT DISTINCT {K('resource_id')} AS ref_id FROM operation_logs WHERE lower(action) LIKE '%delet%' AND lower(action) NOT LIKE '%undelet%'),
orphans AS (
  SELECT DISTINCT r.qa_id, r.ref_field, r.ref_id, r.created_at,
         CASE WHEN c.ref_id IS NOT NULL THEN 'late' WHEN g.ref_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM refs r LEFT JOIN records c USING (ref_field, ref_id) LEFT JOIN gone g ON g.ref_id = r.ref_id
  WHERE r.ref_id IS NOT NULL AND r.qa_id IS NOT NULL AND (c.ref_id IS NULL OR c.record_at > r.created_at)
)
"""

QUERIES = {
    "p1_found": (p1_found, _ORPHANS + "SELECT qa_id, ref_field, ref_id, orphan_kind FROM orphans"),
    "p1_report": (
        p1_report,
        _ORPHANS
        + """SELECT CASE ref_field WHEN 'dataset_id' THEN 'eval_datasets' ELSE 'document_chunks' END AS ref_table,
        strftime(created_at, '%Y-%m') AS month, orphan_kind, count(*) AS orphans, count(DISTINCT qa_id) AS pairs
        FROM orphans GROUP BY 1, 2, 3""",
    ),
    "p1_base_orphans": (
        p1_base_orphans,
        f"""WITH r AS (SELECT DISTINCT qa_id, {K('raw')} AS chunk_id FROM (SELECT {K('id')} AS qa_id, unnest(expected_chunk_ids) AS raw FROM eval_qa_pairs)),
        b AS (SELECT DISTINCT {K('p.id')} AS qa_id, s.kb_id FROM eval_qa_pairs p LEFT JOIN (SELECT DISTINCT {K('id')} AS id, {K('kb_id')} AS kb_id FROM eval_datasets) s ON s.id = {K('p.dataset_id')}),
        c AS (SELECT DISTINCT {K('id')} AS chunk_id, {K('kb_id')} AS kb_id FROM document_chunks)
        SELECT DISTINCT qa_id, r.chunk_id, b.kb_id FROM r JOIN b USING (qa_id) LEFT JOIN c ON c.chunk_id = r.chunk_id AND (b.kb_id IS NULL OR c.kb_id = b.kb_id) WHERE r.chunk_id IS NOT NULL AND c.chunk_id IS NULL""",
    ),
    "p1_chunk_parents": (
        p1_chunk_parents,
        f"""WITH c AS (SELECT DISTINCT id, {K('doc_id')} AS doc_id, {K('kb_id')} AS kb_id FROM document_chunks),
        p AS (SELECT DISTINCT {K('id')} AS doc_id, {K('kb_id')} AS kb_id FROM documents)
        SELECT id AS chunk_id, doc_id, kb_id FROM c WHERE (doc_id IS NOT NULL OR kb_id IS NOT NULL) AND NOT EXISTS (
          SELECT 1 FROM p WHERE (c.doc_id IS NULL OR p.doc_id = c.doc_id) AND (c.kb_id IS NULL OR p.kb_id = c.kb_id))""",
    ),
}
