"""Queries on text cleaning and text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.functions import cleaning as C
from lorecast.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "mime_type").where("text is not null")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunks").select("id", "content").where("content is not null").distinct()


def clean_unicode(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(C.sanitized(F.col("text")), 256).alias("hash"))


def clean_html_residue(spark, d):
    return _chunks(spark, d).select("id", F.sha2(C.without_tags(F.col("content")), 256).alias("hash"))


def clean_whitespace(spark, d):
    return _chunks(spark, d).select("id", F.sha2(C.normal_space(C.trimmed_lines(F.col("content"))), 256).alias("hash"))


def clean_noise_lines(spark, d):
    kept = C.without_noise(F.col("content"))
    return _chunks(spark, d).select("id", F.length(kept).alias("kept_chars"), F.sha2(kept, 256).alias("hash"))


def clean_dedup_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(C.distinct_paragraphs(F.col("text")), 256).alias("hash"))


def clean_chain_stats(spark, d):
    """Signs before and after the chain per MIME type."""
    rows = _docs(spark, d).select("mime_type", F.length("text").alias("before"), F.length(C.cleaned(F.col("text"), F.coalesce(F.col("mime_type") == "text/html", F.lit(False)))).alias("after"))
    sums = rows.groupBy("mime_type").agg(F.count("*").alias("docs"), F.sum("before").alias("before_chars"), F.sum("after").alias("after_chars"))
    return sums.withColumn("removed_pct", F.round(100 * (F.col("before_chars") - F.col("after_chars")) / F.col("before_chars"), 1))


def text_measures(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", C.token_estimate(t).alias("tokens"), C.word_count(t).alias("words"), F.sha2(t, 256).alias("hash"), C.preview(t, 80).alias("preview"))


def doc_hash_dedup(spark, d):
    """Of documents with one hash in one base the first created stays: which are copies of which."""
    docs = table(spark, d, "documents").where("doc_hash is not null").select("doc_id", "kb_id", "doc_hash", "created_at")
    first = docs.groupBy("kb_id", "doc_hash").agg(F.min(F.struct("created_at", "doc_id"))["doc_id"].alias("first_doc_id"))
    return docs.join(first, ["kb_id", "doc_hash"]).where("doc_id <> first_doc_id").select("doc_id", "first_doc_id")


_TAG = C.TAG.replace("'", "''")
_NOISE = C.NOISE.replace("'", "''")
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUERIES = {
    "clean_unicode": (
        clean_unicode,
        "SELECT doc_id, sha256(nfc_normalize(translate(regexp_replace(translate(text, chr(160) || chr(8239), '  '), '[\\p{Cc}\\p{Cf}]', '', 'g'), '" + C._WIDE + "', '" + C._NARROW.replace("'", "''") + "'))) AS hash FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\n\\t\\r]')) UNION ALL "
        "SELECT doc_id, sha256(nfc_normalize(translate(string_agg(regexp_replace(translate(part, chr(160) || chr(8239), '  '), '[\\p{Cc}\\p{Cf}]', '', 'g') || sep, '' ORDER BY n), '" + C._WIDE + "', '" + C._NARROW.replace("'", "''") + "'))) AS hash FROM (SELECT doc_id, unnest(parts) AS part, unnest(list_concat(seps, [''])) AS sep, unnest(range(len(parts))) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '[\\n\\t\\r]') AS parts, regexp_extract_all(text, '[\\n\\t\\r]') AS seps FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\n\\t\\r]'))) GROUP BY doc_id",
    ),
    "clean_html_residue": (
        clean_html_residue,
        f"SELECT id, sha256(regexp_replace(regexp_replace(regexp_replace(content, '{_TAG}', '', 'g'), ' +\\n', chr(10), 'g'), '\\n +', chr(10), 'g')) AS hash FROM (SELECT DISTINCT id, content FROM document_chunks WHERE content IS NOT NULL)",
    ),
    "clean_whitespace": (
        clean_whitespace,
        r"""SELECT id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)[ \t]+$', '', 'g'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
        '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) AS hash
        FROM (SELECT DISTINCT id, content FROM document_chunks WHERE content IS NOT NULL)""",
    ),
    "clean_noise_lines": (
        clean_noise_lines,
        f"SELECT id, length(kept) AS kept_chars, sha256(kept) AS hash FROM (SELECT id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '{_NOISE}')), chr(10)) AS kept FROM (SELECT DISTINCT id, content FROM document_chunks WHERE content IS NOT NULL))",
    ),
    "clean_dedup_paragraphs": (
        clean_dedup_paragraphs,
        rf"""WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, ps, list_transform(ps, lambda x: lower(regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g'))) AS ks FROM p)
        SELECT doc_id, sha256(array_to_string(list_filter(ps, lambda x, i: i = 1 OR ks[i] = '' OR ks[i] <> ks[i - 1]), chr(10) || chr(10))) AS hash FROM k""",
    ),
    "clean_chain_stats": (
        clean_chain_stats,
        rf"""WITH a AS (SELECT mime_type, text, nfc_normalize(translate(regexp_replace(translate(text, chr(160) || chr(8239), '  '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\p{{Cf}}]', '', 'g'), '{C._WIDE}', '{C._NARROW.replace("'", "''")}')) AS s FROM documents WHERE text IS NOT NULL),
        b AS (SELECT mime_type, text, CASE WHEN mime_type = 'text/html' THEN regexp_replace(regexp_replace(regexp_replace(s, '{_TAG}', '', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g') ELSE s END AS s FROM a),
        c AS (SELECT mime_type, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?m)[ \t]+$', '', 'g'), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS s FROM b),
        e AS (SELECT mime_type, text, array_to_string(list_filter(string_split(s, chr(10)), lambda x: NOT regexp_matches(x, '{_NOISE}')), chr(10)) AS s FROM c),
        f AS (SELECT mime_type, count(*) AS docs, sum(length(text)) AS before_chars, sum(length(s)) AS after_chars FROM e GROUP BY 1)
        SELECT *, round(100 * (before_chars - after_chars) / before_chars, 1) AS removed_pct FROM f""",
    ),
    "text_measures": (
        text_measures,
        r"""SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens,
        len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''))::INT AS words,
        sha256(text) AS hash, text[1:80] AS preview FROM documents WHERE text IS NOT NULL""",
    ),
    "doc_hash_dedup": (
        doc_hash_dedup,
        """SELECT doc_id, first_doc_id FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY kb_id, doc_hash ORDER BY created_at NULLS FIRST, doc_id) AS first_doc_id
        FROM documents WHERE doc_hash IS NOT NULL AND kb_id IS NOT NULL) WHERE doc_id <> first_doc_id""",
    ),
}
