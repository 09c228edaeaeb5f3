"""Queries on chunking, reviews and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.cleaning import cleaned
from lorecast.operators.chunking import chunk_kind, chunked
from lorecast.operators.reviews import in_mode, review_states, session_order
from lorecast.session import table
from lorecast.sources.files import page_links


def _kinds():
    """Plain text of repositories is code, their Markdown and all web pages are marked up."""
    git, plain = F.col("source_type") == "git", F.col("mime_type") == "text/plain"
    ext = F.when(git & plain, ".py").when(git, ".md").when(F.col("mime_type") == "text/html", ".html")
    return chunk_kind(ext, F.col("mime_type"), F.lit(None).cast("string"))


def ingest_chunks(spark, d):
    """The chunks of every document, cut by its kind."""
    docs = table(spark, d, "documents").select("doc_id", "text", "mime_type", "source_type")
    return chunked(docs, "doc_id", "text", _kinds()).select("doc", "chunk_index", "chunk_type", "token_count", "start_line", "end_line", "chunk_id")


def ingest_cleaned_totals(spark, d):
    """Documents cleaned, then cut: chunks and estimated tokens per source and type."""
    docs = table(spark, d, "documents").select("doc_id", "source", "mime_type", "source_type", cleaned(F.col("text"), F.coalesce(F.col("mime_type") == "text/html", F.lit(False))).alias("text"))
    chunks = chunked(docs, "doc_id", "text", _kinds(), carry=["source"])
    return chunks.groupBy("source", "chunk_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def _answers(spark, d):
    """Events taken as answers: the exercise is the number in their properties, which also gives its difficulty; the quality follows from the value."""
    k = F.get_json_object("props", "$.k")
    difficulty = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.pmod(k.cast("int"), F.lit(3)) + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("learner"), k.alias("exercise"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.pmod(F.floor("value"), F.lit(6)).cast("int").alias("quality"), difficulty.alias("difficulty"))


def sm2_fold(spark, d):
    return review_states(_answers(spark, d)).select("learner", "exercise", "last_at", "reviews", "correct", "streak", "misses", "repetitions", "interval_days", F.round("ease", 4).alias("ease"), "due_at", "weak", "mastered")


def sm2_counts(spark, d):
    """Per learner: exercises, answers, correct ones, weak, mastered, due at the time of the last event, and accuracy."""
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))  # one row
    s = review_states(_answers(spark, d)).crossJoin(F.broadcast(now))
    return s.groupBy("learner").agg(
        F.count("*").alias("exercises"), F.sum("reviews").alias("reviews"), F.sum("correct").alias("correct"), F.max("last_at").alias("last_at"), F.count_if("weak").alias("weak"),
        F.count_if("mastered").alias("mastered"), F.count_if(F.col("due_at") <= F.col("now")).alias("due"), F.round(F.sum("correct") / F.sum("reviews"), 4).alias("accuracy"),
    )


def session_queue(spark, d):
    """The first ten exercises of each learner's next session: due ones by priority, then by due date."""
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))  # one row
    s = review_states(_answers(spark, d)).crossJoin(F.broadcast(now)).where(in_mode("due", F.col("now")))
    priority = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.pmod(F.col("exercise").cast("int"), F.lit(3)) + 1).cast("int"))
    order = Window.partitionBy("learner").orderBy(*session_order(priority, F.col("due_at")), "exercise")
    return s.withColumn("place", F.row_number().over(order)).where("place <= 10").select("learner", "place", "exercise", "due_at")


def link_discovery(spark, d):
    """Targets that the links of web chunks name, and how many chunks name them."""
    c = table(spark, d, "document_chunks").select("id", "content").where("content is not null").distinct()
    md = F.regexp_extract_all("content", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    return c.select("id", F.explode(F.array_union(page_links(F.col("content")), F.array_distinct(md))).alias("target")).groupBy("target").agg(F.count("*").alias("chunks"))


# The answers of each learner and exercise numbered, then one step of the state for each number.
_FOLD = """WITH RECURSIVE a AS (SELECT user_id::VARCHAR AS learner, json_extract_string(props, '$.k') AS exercise, ts, ((floor(value)::BIGINT % 6) + 6) % 6 AS q, json_extract_string(props, '$.k')::INT % 3 AS level,
  row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
s AS (SELECT learner, exercise, 0::BIGINT AS n, NULL::TIMESTAMP AS last_at, 0::BIGINT AS correct, 0::BIGINT AS streak, 0::BIGINT AS misses, 0::BIGINT AS repetitions, 0::BIGINT AS days, 2.5::DOUBLE AS ease, false AS mastered FROM a WHERE n = 1
  UNION ALL
  SELECT s.learner, s.exercise, a.n, a.ts, correct + (q >= 3)::INT, CASE WHEN q >= 3 THEN streak + 1 ELSE 0 END, CASE WHEN q >= 3 THEN 0 ELSE misses + 1 END, CASE WHEN q >= 3 THEN repetitions + 1 ELSE 0 END,
    CASE WHEN q < 3 THEN 0 WHEN repetitions = 0 THEN 1 WHEN repetitions = 1 THEN 6 WHEN q = 3 THEN greatest(1, floor(floor(days * ease) * 0.8::DOUBLE)::BIGINT) ELSE floor(days * ease)::BIGINT END,
    greatest(1.3::DOUBLE, CASE WHEN q >= 3 AND repetitions = 0 THEN (CASE level WHEN 0 THEN 2.5 WHEN 1 THEN 2.3 ELSE 2.0 END)::DOUBLE ELSE ease END + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)),
    q >= 3 AND (mastered OR repetitions + 1 >= 5 AND (correct + 1) / a.n >= 0.85)
  FROM s JOIN a ON a.learner = s.learner AND a.exercise = s.exercise AND a.n = s.n + 1),
last AS (SELECT *, n AS reviews FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY learner, exercise ORDER BY n DESC) = 1)
"""
QUERIES = {
    "ingest_chunks": (ingest_chunks, None),
    "ingest_cleaned_totals": (ingest_cleaned_totals, None),
    "sm2_fold": (sm2_fold, _FOLD + "SELECT learner, exercise, last_at, reviews, correct, streak, misses, repetitions, days AS interval_days, round(ease, 4) AS ease, last_at + days * INTERVAL 1 DAY AS due_at, misses >= 3 AS weak, mastered FROM last"),
    "sm2_counts": (
        sm2_counts,
        _FOLD
        + """SELECT learner, count(*) AS exercises, sum(reviews) AS reviews, sum(correct) AS correct, max(last_at) AS last_at, count(*) FILTER (WHERE misses >= 3) AS weak, count(*) FILTER (WHERE mastered) AS mastered,
        count(*) FILTER (WHERE last_at + days * INTERVAL 1 DAY <= now) AS due, round(sum(correct) / sum(reviews), 4) AS accuracy FROM last, (SELECT max(ts) AS now FROM events) GROUP BY 1""",
    ),
    "session_queue": (
        session_queue,
        _FOLD
        + """SELECT learner, row_number() OVER (PARTITION BY learner ORDER BY exercise::INT % 3, due_at, exercise) AS place, exercise, due_at FROM (SELECT *, last_at + days * INTERVAL 1 DAY AS due_at FROM last), (SELECT max(ts) AS now FROM events)
        WHERE due_at <= now AND NOT mastered QUALIFY place <= 10""",
    ),
    "link_discovery": (
        link_discovery,
        r"""SELECT target, count(*) AS chunks FROM (SELECT DISTINCT id, target FROM (SELECT id, unnest(list_concat(regexp_extract_all(content, '\]\(([^)\s]+)\)', 1), list_filter(list_transform(regexp_extract_all(content, '(?i)<a\s[^>]*href\s*=\s*["'']([^"''#]+)', 1), lambda x: trim(x)), lambda x: x <> ''))) AS target
        FROM (SELECT DISTINCT id, content FROM document_chunks WHERE content IS NOT NULL))) GROUP BY 1""",
    ),
}
