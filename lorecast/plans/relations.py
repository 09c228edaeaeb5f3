"""Queries on joins, windows, sets and paging over the platform's tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.keys import key
from lorecast.session import table


def _once(spark, d, name, *cols):
    return table(spark, d, name).select(*cols).distinct()


def _expected(spark, d):
    refs = table(spark, d, "eval_qa_pairs").select(F.explode("expected_chunk_ids").alias("raw"))
    return refs.select(key("raw").alias("chunk_id")).dropna().distinct()


def qa_with_dataset(spark, d):
    """Pairs with the dataset they belong to: pairs per base and difficulty."""
    pairs = _once(spark, d, "eval_qa_pairs", "id", "dataset_id", "difficulty").select("id", key("dataset_id").alias("dataset_id"), F.lower("difficulty").alias("difficulty"))
    sets = _once(spark, d, "eval_datasets", "id", "kb_id").select(key("id").alias("dataset_id"), "kb_id")
    return pairs.join(sets, "dataset_id").groupBy("kb_id", "difficulty").agg(F.countDistinct("id").alias("pairs"))


def chunks_without_pairs(spark, d):
    """Chunks that no pair expects, per document."""
    named = _expected(spark, d)
    chunks = _once(spark, d, "document_chunks", "id", "doc_id").select(key("id").alias("chunk_id"), "doc_id")
    return chunks.join(named, "chunk_id", "left_anti").groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks"))


def documents_in_pairs(spark, d):
    """Documents of which a chunk is expected by a pair."""
    named = _expected(spark, d)
    chunks = _once(spark, d, "document_chunks", "id", "doc_id").select(key("id").alias("chunk_id"), F.col("doc_id").alias("id"))
    used = chunks.join(named, "chunk_id", "left_semi").select("id")
    return table(spark, d, "documents").select("doc_id", "id", "title").join(used, "id", "left_semi").select("doc_id", "title")


def vector_orphans(spark, d):
    """Each chunk's vector id against its own id, per base; orphan_vectors has all vector ids against all chunk ids."""
    c = _once(spark, d, "document_chunks", "id", "kb_id", "vector_id")
    return c.groupBy("kb_id").agg(F.count_if(F.col("vector_id") == F.col("id")).alias("same"), F.count_if(F.col("vector_id").isNull()).alias("no_vector"), F.count_if(F.col("vector_id") != F.col("id")).alias("other"))


def orphan_vectors(spark, d):
    """Distinct vector ids against distinct chunk ids of the same base: how many are on both sides, only vector, only chunk."""
    c = table(spark, d, "document_chunks")
    vectors = c.select("kb_id", key("vector_id").alias("id"), F.lit(True).alias("vector"), F.lit(False).alias("chunk"))
    chunks = c.select("kb_id", key("id").alias("id"), F.lit(False).alias("vector"), F.lit(True).alias("chunk"))
    ids = vectors.unionAll(chunks).dropna(subset=["id"]).groupBy("kb_id", "id").agg(F.max("vector").alias("vector"), F.max("chunk").alias("chunk"))  # both anti-joins at once, a base may be null
    v, x = F.col("vector"), F.col("chunk")
    return ids.groupBy("kb_id").agg(F.count_if(v & x).alias("both"), F.count_if(v & ~x).alias("only_vector"), F.count_if(x & ~v).alias("only_chunk"))


def title_dedup(spark, d):
    """The newest document of each title and base, and how many it replaces."""
    docs = table(spark, d, "documents").select("kb_id", "title", "doc_id", "created_at")
    return docs.groupBy("kb_id", "title").agg(F.max(F.struct("created_at", "doc_id"))["doc_id"].alias("doc_id"), (F.count("*") - 1).alias("replaced"))


def question_dedup(spark, d):
    """Of pairs with one question the one of the newest dataset stays: the first by (dataset time, pair id). Each pair without question stays."""
    pairs = _once(spark, d, "eval_qa_pairs", "id", "dataset_id", "question").select("id", key("dataset_id").alias("dataset_id"), F.coalesce(F.trim("question"), F.lit("")).alias("question"))
    sets = _once(spark, d, "eval_datasets", "id", "created_at").select(key("id").alias("dataset_id"), "created_at")
    known = pairs.join(sets, "dataset_id")
    best = F.min(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("newest"), "id"))["id"]
    return known.groupBy("question", F.when(F.col("question") == "", F.col("id")).alias("alone")).agg(best.alias("id"), F.count("*").alias("pairs")).drop("alone")


def latest_dataset(spark, d):
    sets = _once(spark, d, "eval_datasets", "id", "kb_id", "created_at")
    return sets.groupBy("kb_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("dataset_id"), F.count("*").alias("datasets"))


def history_window(spark, d):
    """For each message the number and length of the up to ten messages that end with it, and its answer time."""
    m = table(spark, d, "messages").where("conversation_id is not null and created_at is not null").select("id", key("conversation_id").alias("conversation_id"), "created_at", "content").distinct()
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    ten = w.rowsBetween(-9, 0)
    since = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lag("created_at").over(w).cast("timestamp"))
    return m.select("id", F.count("*").over(ten).alias("messages"), F.sum(F.length("content")).over(ten).alias("signs"), since.alias("micros_since"))


def consecutive_repeats(spark, d):
    """Chunks that repeat the text of the chunk before them in their document."""
    c = _once(spark, d, "document_chunks", "id", "doc_id", "chunk_index", F.sha2("content", 256).alias("hash"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "id")
    return c.withColumn("before", F.lag("hash").over(w)).where("hash = before").select("id", "doc_id")


def document_page(spark, d):
    """A page of the list of documents, newest first: places 41 to 60 and the number of all."""
    docs = table(spark, d, "documents").select("doc_id", "title", "created_at")
    total = docs.agg(F.count("*").alias("total"))
    return docs.orderBy(F.desc("created_at"), "doc_id").offset(40).limit(20).crossJoin(total)


def top_documents(spark, d):
    """The ten longest documents of each source (a report)."""
    docs = table(spark, d, "documents").where("n_chars is not null").select("source", "doc_id", "n_chars")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return docs.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, length and hash of each document's chunks from rows in order: a task holds one chunk and one running hash."""
    started, doc, before, chunks, signs, digest, out = False, None, None, 0, 0, None, []
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(4))):
            doc_id, *chunk = (x.as_py() for x in row)
            if started and doc_id == doc:
                if chunk == before:
                    continue  # written twice
                digest.update(b" ")
                signs += 1
            else:
                if started:
                    out.append((doc, chunks, signs, digest.hexdigest()))
                started, doc, chunks, signs, digest = True, doc_id, 0, 0, hashlib.sha256()
            before, content = chunk, chunk[-1]
            digest.update(content.encode())
            chunks, signs = chunks + 1, signs + len(content)
        if len(out) > 5000:
            yield _doc_rows(out)
            out = []
    if started:
        out.append((doc, chunks, signs, digest.hexdigest()))
    yield _doc_rows(out)


def _doc_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.string(), "chunks": pa.int64(), "signs": pa.int64(), "hash": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def doc_text_from_chunks(spark, d):
    """Each document's chunks joined in order: number, length and hash of the whole, which is nowhere held.

    Rows written twice stand next to each other once sorted, and count once.
    """
    c = table(spark, d, "document_chunks").where("content is not null").select("doc_id", "chunk_index", "id", "content")
    ordered = c.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index", "id", "content")
    return ordered.mapInArrow(_joined, "doc_id string, chunks bigint, signs bigint, hash string")


def keyword_scan(spark, d):
    """How often words of the trade occur per source, whatever their case."""
    words = ["iterator", "cache", "decorator", "garbage collector", "缓冲区", "Puffer", "tampon"]
    docs = table(spark, d, "documents").where("text is not null").select("source", F.lower("text").alias("t"))
    hits = [F.sum((F.length("t") - F.length(F.replace("t", F.lit(w.lower()), F.lit("")))) / len(w)).cast("bigint").alias(f"w{i}") for i, w in enumerate(words)]
    sums = docs.groupBy("source").agg(*hits)
    return sums.select("source", F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("hits")) for i, w in enumerate(words)))).alias("x")).select("source", "x.word", "x.hits")


def gt_diagnostics(spark, d):
    """Pairs per dataset: with references, with all of them at hand, with stale mark, without dataset."""
    pairs = table(spark, d, "eval_qa_pairs").select(key("id").alias("id"), key("dataset_id").alias("dataset_id"), "expected_chunk_ids", "is_stale").dropDuplicates(["id"])
    refs = pairs.select("id", F.explode("expected_chunk_ids").alias("raw")).select("id", key("raw").alias("chunk_id")).dropna().distinct()
    at_hand = _once(spark, d, "document_chunks", "id").select(key("id").alias("chunk_id"), F.lit(True).alias("there"))
    per = refs.join(at_hand, "chunk_id", "left").groupBy("id").agg(F.count("*").alias("refs"), F.count_if(F.col("there")).alias("found"))
    joined = pairs.join(per, "id", "left").fillna(0, ["refs", "found"])
    return joined.groupBy("dataset_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("refs") > 0).alias("with_refs"), F.count_if((F.col("refs") > 0) & (F.col("refs") == F.col("found"))).alias("complete"), F.count_if(F.coalesce("is_stale", F.lit(False))).alias("stale"))


def tag_sets(spark, d):
    """Tags per question type: distinct tags, and pairs whose tags hold both of two."""
    p = table(spark, d, "eval_qa_pairs").dropDuplicates(["id"]).select("question_type", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    both = F.size(F.array_except(F.array(F.lit("loops"), F.lit("types")), "tags")) == 0
    counts = p.groupBy("question_type").agg(F.count("*").alias("pairs"), F.count_if(both).alias("with_both"))
    distinct = p.select(F.col("question_type").alias("of"), F.explode("tags").alias("tag")).distinct()
    named = distinct.groupBy("of").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("all_tags"))  # a type's distinct tags
    return counts.join(named, F.col("question_type").eqNullSafe(F.col("of")), "left").select("question_type", "pairs", "with_both", F.coalesce("all_tags", F.lit("")).alias("all_tags"))


def deletion_summary(spark, d):
    """Actions of the audit log in one spelling, per kind of record and month."""
    logs = table(spark, d, "operation_logs").dropDuplicates(["id"])
    return logs.groupBy(F.lower(F.trim("action")).alias("action"), "resource_type", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("actions"), F.countDistinct("resource_id").alias("records"))


_CLEAN = "nullif(lower(trim({0})), '')"
K = _CLEAN.format
QUERIES = {
    "qa_with_dataset": (
        qa_with_dataset,
        f"SELECT s.kb_id, lower(p.difficulty) AS difficulty, count(DISTINCT p.id) AS pairs FROM eval_qa_pairs p JOIN (SELECT DISTINCT id, kb_id FROM eval_datasets) s ON {K('p.dataset_id')} = {K('s.id')} GROUP BY 1, 2",
    ),
    "chunks_without_pairs": (
        chunks_without_pairs,
        f"SELECT doc_id, count(DISTINCT {K('id')}) AS chunks FROM document_chunks WHERE {K('id')} NOT IN (SELECT {K('r')} FROM (SELECT unnest(expected_chunk_ids) AS r FROM eval_qa_pairs) WHERE {K('r')} IS NOT NULL) GROUP BY 1",
    ),
    "documents_in_pairs": (
        documents_in_pairs,
        f"SELECT doc_id, title FROM documents WHERE id IN (SELECT doc_id FROM document_chunks WHERE {K('id')} IN (SELECT {K('r')} FROM (SELECT unnest(expected_chunk_ids) AS r FROM eval_qa_pairs)))",
    ),
    "vector_orphans": (
        vector_orphans,
        "SELECT kb_id, count(*) FILTER (WHERE vector_id = id) AS same, count(*) FILTER (WHERE vector_id IS NULL) AS no_vector, count(*) FILTER (WHERE vector_id <> id) AS other FROM (SELECT DISTINCT id, kb_id, vector_id FROM document_chunks) GROUP BY 1",
    ),
    "orphan_vectors": (
        orphan_vectors,
        f"""SELECT coalesce(v.kb_id, c.kb_id) AS kb_id, count(*) FILTER (WHERE v.id IS NOT NULL AND c.id IS NOT NULL) AS both, count(*) FILTER (WHERE c.id IS NULL) AS only_vector, count(*) FILTER (WHERE v.id IS NULL) AS only_chunk
        FROM (SELECT DISTINCT kb_id, {K('vector_id')} AS id FROM document_chunks WHERE {K('vector_id')} IS NOT NULL) v
        FULL JOIN (SELECT DISTINCT kb_id, {K('id')} AS id FROM document_chunks WHERE {K('id')} IS NOT NULL) c ON v.id = c.id AND v.kb_id IS NOT DISTINCT FROM c.kb_id GROUP BY 1""",
    ),
    "title_dedup": (title_dedup, "SELECT kb_id, title, max_by(doc_id, (created_at, doc_id)) AS doc_id, count(*) - 1 AS replaced FROM documents GROUP BY 1, 2"),
    "question_dedup": (
        question_dedup,
        f"""SELECT question, first(id ORDER BY created_at DESC, id) AS id, count(*) AS pairs FROM (SELECT DISTINCT p.id, coalesce(trim(p.question), '') AS question, s.created_at
        FROM (SELECT DISTINCT id, dataset_id, question FROM eval_qa_pairs) p JOIN (SELECT DISTINCT id, created_at FROM eval_datasets) s ON {K('p.dataset_id')} = {K('s.id')}) GROUP BY question, CASE WHEN question = '' THEN id END""",
    ),
    "latest_dataset": (latest_dataset, "SELECT kb_id, max_by(id, (created_at, id)) AS dataset_id, count(*) AS datasets FROM (SELECT DISTINCT id, kb_id, created_at FROM eval_datasets) GROUP BY 1"),
    "history_window": (
        history_window,
        f"""SELECT id, count(*) OVER w AS messages, sum(length(content)) OVER w AS signs, epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY c ORDER BY created_at, id)) AS micros_since
        FROM (SELECT DISTINCT id, {K('conversation_id')} AS c, created_at, content FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL) WINDOW w AS (PARTITION BY c ORDER BY created_at, id ROWS 9 PRECEDING)""",
    ),
    "consecutive_repeats": (
        consecutive_repeats,
        "SELECT id, doc_id FROM (SELECT id, doc_id, h, lag(h) OVER (PARTITION BY doc_id ORDER BY chunk_index, id) AS before FROM (SELECT DISTINCT id, doc_id, chunk_index, sha256(content) AS h FROM document_chunks)) WHERE h = before",
    ),
    "document_page": (document_page, "SELECT doc_id, title, created_at, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 40"),
    "top_documents": (top_documents, "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars IS NOT NULL QUALIFY rank <= 10"),
    "doc_text_from_chunks": (
        doc_text_from_chunks,
        "SELECT doc_id, n AS chunks, length(t) AS signs, sha256(t) AS hash FROM (SELECT doc_id, string_agg(content, ' ' ORDER BY chunk_index, id) AS t, count(*) AS n FROM (SELECT DISTINCT id, doc_id, chunk_index, content FROM document_chunks WHERE content IS NOT NULL) GROUP BY 1)",
    ),
    "keyword_scan": (
        keyword_scan,
        " UNION ALL ".join(
            f"SELECT source, '{w}' AS word, sum((length(t) - length(replace(t, lower('{w}'), ''))) // length('{w}'))::BIGINT AS hits FROM (SELECT source, lower(text) AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1"
            for w in ("iterator", "cache", "decorator", "garbage collector", "缓冲区", "Puffer", "tampon")
        ),
    ),
    "gt_diagnostics": (
        gt_diagnostics,
        f"""WITH p AS (SELECT DISTINCT ON ({K('id')}) {K('id')} AS id, {K('dataset_id')} AS dataset_id, expected_chunk_ids, is_stale FROM eval_qa_pairs),
        r AS (SELECT DISTINCT id, {K('raw')} AS chunk_id FROM (SELECT id, unnest(expected_chunk_ids) AS raw FROM p)), h AS (SELECT DISTINCT {K('id')} AS chunk_id FROM document_chunks),
        per AS (SELECT r.id, count(*) AS refs, count(h.chunk_id) AS found FROM r LEFT JOIN h USING (chunk_id) WHERE r.chunk_id IS NOT NULL GROUP BY 1)
        SELECT dataset_id, count(*) AS pairs, count(*) FILTER (WHERE refs > 0) AS with_refs, count(*) FILTER (WHERE refs > 0 AND refs = found) AS complete, count(*) FILTER (WHERE is_stale) AS stale FROM p LEFT JOIN per USING (id) GROUP BY 1""",
    ),
    "tag_sets": (
        tag_sets,
        """SELECT question_type, count(*) AS pairs, count(*) FILTER (WHERE list_has_all(tags, ['loops', 'types'])) AS with_both, coalesce(array_to_string(list_sort(list_distinct(flatten(list(tags)))), ','), '') AS all_tags
        FROM (SELECT DISTINCT ON (id) question_type, coalesce(tags, []) AS tags FROM eval_qa_pairs) GROUP BY 1""",
    ),
    "deletion_summary": (
        deletion_summary,
        "SELECT lower(trim(action)) AS action, resource_type, strftime(created_at, '%Y-%m') AS month, count(*) AS actions, count(DISTINCT resource_id) AS records FROM (SELECT DISTINCT ON (id) * FROM operation_logs) GROUP BY 1, 2, 3",
    ),
}
