"""Queries on activity, usage and the state of knowledge bases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.session import table

HOURS = 168


def latency_stats(spark, d):
    m = table(spark, d, "messages").where("latency_ms is not null").dropDuplicates(["id"])
    return m.agg(F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.count("*").alias("answers"))


def token_stats(spark, d):
    m = table(spark, d, "messages").where("completion_tokens is not null").dropDuplicates(["id"])
    total = F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.col("completion_tokens"))
    return m.groupBy("llm_provider").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("answers"), F.floor(total / F.count("*")).alias("tokens_per_answer"))


def model_distribution(spark, d):
    m = table(spark, d, "messages").where("llm_provider is not null").dropDuplicates(["id"])
    return m.groupBy("llm_provider", "llm_model").agg(F.count("*").alias("messages"))


def rating_histogram(spark, d):
    m = table(spark, d, "messages").where("user_rating is not null").dropDuplicates(["id"])
    return m.groupBy("llm_model", "user_rating").agg(F.count("*").alias("ratings"))


def hourly_activity(spark, d):
    """Messages per hour of the last ``HOURS`` hours of the table, hours without messages included."""
    m = table(spark, d, "messages").where("created_at is not null").dropDuplicates(["id"]).select(F.date_trunc("hour", "created_at").alias("hour"))
    counts = m.groupBy("hour").agg(F.count("*").alias("messages"))
    last = counts.agg(F.max("hour").alias("last"))
    spine = last.select(F.explode(F.sequence(F.col("last") - F.expr(f"interval {HOURS} hours"), F.col("last"), F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("messages", F.lit(0)).alias("messages"))


def usage_totals(spark, d):
    one = lambda t: table(spark, d, t).select("id").distinct().agg(F.count("*").alias("records")).withColumn("table_name", F.lit(t))
    names = ["documents", "document_chunks", "eval_datasets", "eval_qa_pairs", "messages", "operation_logs", "knowledge_bases"]
    out = one(names[0])
    for n in names[1:]:
        out = out.unionByName(one(n))
    return out


def kb_stats(spark, d):
    docs = table(spark, d, "documents").groupBy("kb_id").agg(F.count("*").alias("docs"))
    chunks = table(spark, d, "document_chunks").select("id", "kb_id", "token_count", "vector_id").distinct().groupBy("kb_id").agg(F.count("*").alias("chunks"), F.countDistinct("vector_id").alias("vectors"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 1).alias("avg_tokens"))
    kbs = table(spark, d, "knowledge_bases").select(F.col("id").alias("kb_id"), "quality_status")
    zero = {"docs": 0, "chunks": 0, "vectors": 0, "tokens": 0, "avg_tokens": 0.0}
    return kbs.join(docs, "kb_id", "left").join(chunks, "kb_id", "left").fillna(zero)


def chunk_types(spark, d):
    c = table(spark, d, "document_chunks").select("id", "kb_id", "chunk_type").distinct()
    counts = c.groupBy("kb_id", "chunk_type").agg(F.count("*").alias("chunks"))
    return counts.withColumn("share", F.round(F.col("chunks") / F.sum("chunks").over(Window.partitionBy("kb_id")), 4))  # a row per type


def duplicate_chunks(spark, d):
    """Chunks of one document that begin alike: groups, rows and the share of a base's chunks."""
    c = table(spark, d, "document_chunks").where("content is not null").select("id", "kb_id", "doc_id", F.substring("content", 1, 80).alias("head")).distinct()
    groups = c.groupBy("kb_id", "doc_id", "head").agg(F.count("*").alias("n"))
    return groups.groupBy("kb_id").agg(F.count_if(F.col("n") > 1).alias("dup_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup_rows"), F.sum("n").alias("rows"))


def event_activity(spark, d):
    """Events per day and type with the users that caused them and the sum of their values."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("sum_value"))


def event_sessions(spark, d):
    """Sessions of a user: events not more than 30 minutes apart."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))) > 1800, F.lit(True))
    starts = e.withColumn("new", gap.cast("int")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return starts.groupBy("user_id", "session").agg(F.min("ts").alias("starts"), F.max("ts").alias("ends"), F.count("*").alias("events"))


_M = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM messages) WHERE rn = 1)"
QUERIES = {
    "latency_stats": (latency_stats, f"SELECT coalesce(round(avg(latency_ms), 2), 0) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, count(*) AS answers FROM {_M} WHERE latency_ms IS NOT NULL"),
    "token_stats": (
        token_stats,
        f"""SELECT llm_provider, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, count(*) AS answers,
        floor(sum(coalesce(prompt_tokens, 0) + completion_tokens) / count(*))::BIGINT AS tokens_per_answer FROM {_M} WHERE completion_tokens IS NOT NULL GROUP BY llm_provider""",
    ),
    "model_distribution": (model_distribution, f"SELECT llm_provider, llm_model, count(*) AS messages FROM {_M} WHERE llm_provider IS NOT NULL GROUP BY ALL"),
    "rating_histogram": (rating_histogram, f"SELECT llm_model, user_rating, count(*) AS ratings FROM {_M} WHERE user_rating IS NOT NULL GROUP BY ALL"),
    "hourly_activity": (
        hourly_activity,
        f"""WITH c AS (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM {_M} WHERE created_at IS NOT NULL GROUP BY 1),
        s AS (SELECT unnest(generate_series(max(hour) - INTERVAL {HOURS} HOUR, max(hour), INTERVAL 1 HOUR)) AS hour FROM c)
        SELECT s.hour, coalesce(n, 0) AS messages FROM s LEFT JOIN c USING (hour)""",
    ),
    "usage_totals": (
        usage_totals,
        " UNION ALL ".join(f"SELECT count(DISTINCT id) AS records, '{t}' AS table_name FROM {t}" for t in ("documents", "document_chunks", "eval_datasets", "eval_qa_pairs", "messages", "operation_logs", "knowledge_bases")),
    ),
    "kb_stats": (
        kb_stats,
        """SELECT k.id AS kb_id, k.quality_status, coalesce(d.docs, 0) AS docs, coalesce(c.chunks, 0) AS chunks, coalesce(c.vectors, 0) AS vectors, coalesce(c.tokens, 0) AS tokens, coalesce(c.avg_tokens, 0) AS avg_tokens
        FROM knowledge_bases k LEFT JOIN (SELECT kb_id, count(*) AS docs FROM documents GROUP BY 1) d ON d.kb_id = k.id
        LEFT JOIN (SELECT kb_id, count(*) AS chunks, count(DISTINCT vector_id) AS vectors, sum(token_count) AS tokens, round(avg(token_count), 1) AS avg_tokens FROM (SELECT DISTINCT id, kb_id, token_count, vector_id FROM document_chunks) GROUP BY 1) c ON c.kb_id = k.id""",
    ),
    "chunk_types": (
        chunk_types,
        """SELECT kb_id, chunk_type, count(*) AS chunks, round(count(*) / sum(count(*)) OVER (PARTITION BY kb_id), 4) AS share
        FROM (SELECT DISTINCT id, kb_id, chunk_type FROM document_chunks) GROUP BY 1, 2""",
    ),
    "duplicate_chunks": (
        duplicate_chunks,
        """SELECT kb_id, count(*) FILTER (WHERE n > 1) AS dup_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS dup_rows, sum(n) AS rows FROM (
        SELECT kb_id, doc_id, head, count(*) AS n FROM (SELECT DISTINCT id, kb_id, doc_id, content[1:80] AS head FROM document_chunks WHERE content IS NOT NULL) GROUP BY ALL) GROUP BY kb_id""",
    ),
    "event_activity": (
        event_activity,
        "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, sum(value::DECIMAL(18,4))::DOUBLE AS sum_value FROM events GROUP BY 1, 2",
    ),
    "event_sessions": (
        event_sessions,
        """SELECT user_id, session, min(ts) AS starts, max(ts) AS ends, count(*) AS events FROM (
        SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
        SELECT user_id, ts, event_id, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""",
    ),
}
