"""Queries on evaluation data, indexes and the joins between them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions import cleaning as C
from lorecast.functions.keys import first_of, key, metadata_matches, without_key
from lorecast.operators.matching import containing
from lorecast.operators.retrieval import tokens
from lorecast.operators.reviews import in_mode, review_states
from lorecast.plans.ingest import _FOLD, _answers
from lorecast.plans.relations import K
from lorecast.plans.retrieval import _DENSE, _PAIRS, _TOKENS, _dense, pair_search_audit
from lorecast.plans.retrieval import K as TOP
from lorecast.session import table
from lorecast.sources import sinks

KEYWORDS = ("iterator", "cache", "decorator", "缓冲区", "Puffer", "tampon")
DRILL_TYPES = ("text", "text_heading", "function", "class", "code_block", "code_block_python", "code_block_java")
SEED = "17"


def _pairs(spark, d):
    return table(spark, d, "eval_qa_pairs").withColumn("id", key("id")).where("id is not null").dropDuplicates(["id"])


def _chunks(spark, d, *cols):
    return table(spark, d, "document_chunks").select(key("id").alias("chunk_id"), *cols).where("chunk_id is not null").dropDuplicates(["chunk_id"])


def audit_by_month(spark, d):
    """The audit of searches joined to its pairs: hits, recall and verdicts per month and difficulty."""
    pairs = _pairs(spark, d).select(F.col("id").alias("query"), F.lower("difficulty").alias("difficulty"), F.date_format("created_at", "yyyy-MM").alias("month"))
    r = pair_search_audit(spark, d).join(pairs, "query")
    verdict = lambda v: F.count_if(F.col("verdict") == v).alias(v.replace(" ", "_"))
    return r.groupBy("month", "difficulty").agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 4).alias("hit"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.stddev_pop("hit"), 4).alias("deviation"), *(verdict(v) for v in ("chunk hit", "chunk drift", "miss")))


def documents_with_base(spark, d):
    """Documents with the base they belong to: how many of each base and kind."""
    bases = table(spark, d, "knowledge_bases").select(F.col("id").alias("kb_id"), "name", "visibility")
    return table(spark, d, "documents").select("kb_id", "source_type").join(bases, "kb_id", "left").groupBy("name", "visibility", "source_type").agg(F.count("*").alias("documents"))


def _mentions(spark, d):
    """(id, doc_id): the first document whose title holds the last three words of a question."""
    named = _pairs(spark, d).select("id", F.regexp_extract("question", r"(\S+ \S+ \S+)\?$", 1).alias("needle")).where("needle <> ''")
    docs = table(spark, d, "documents").select("doc_id", "title")
    return containing(named.select("needle").distinct(), "needle", docs, "title").groupBy("needle").agg(F.min("doc_id").alias("doc_id")).join(named, "needle")


def title_mentions(spark, d):
    return _mentions(spark, d).select("id", "needle", "doc_id")


def stale_references(spark, d):
    """How each pair's chunks are found: directly, by the document whose title the question ends like, or not at all, and how many."""
    pairs = _pairs(spark, d).select("id", "expected_chunk_ids")
    chunks = _chunks(spark, d, F.col("doc_id").alias("of"))
    direct = pairs.select("id", F.explode("expected_chunk_ids").alias("raw")).select("id", key("raw").alias("chunk_id")).distinct().join(chunks, "chunk_id", "left_semi").groupBy("id").agg(F.count("*").alias("direct"))
    ids = table(spark, d, "documents").select("doc_id", F.col("id").alias("of"))
    titled = _mentions(spark, d).join(ids, "doc_id").join(chunks.groupBy("of").agg(F.count("*").alias("titled")), "of").select("id", "titled")
    how = F.when(F.col("direct") > 0, "direct").when(F.col("titled") > 0, "by title").otherwise("none")
    return pairs.select("id").join(direct, "id", "left").join(titled, "id", "left").select("id", how.alias("how"), F.coalesce("direct", "titled", F.lit(0)).alias("chunks"))


def id_overlap(spark, d):
    """Ids of chunks, of vectors and of expected chunks: how many are in which of them."""
    c = table(spark, d, "document_chunks")
    of = lambda df, name: df.where("id is not null").distinct().withColumn("name", F.lit(name))
    spaces = of(c.select(key("id").alias("id")), "chunk").unionAll(of(c.select(key("vector_id").alias("id")), "vector"))
    spaces = spaces.unionAll(of(table(spark, d, "eval_qa_pairs").select(F.explode("expected_chunk_ids").alias("raw")).select(key("raw").alias("id")), "expected"))
    has = [F.max(F.col("name") == n).alias(n) for n in ("chunk", "vector", "expected")]
    return spaces.groupBy("id").agg(*has).groupBy("chunk", "vector", "expected").agg(F.count("*").alias("ids"))


def chunk_titles(spark, d):
    """Chunks by the title of their document."""
    docs = table(spark, d, "documents").select(F.col("id").alias("doc_id"), "title")
    return _chunks(spark, d, "doc_id", "token_count").join(docs, "doc_id").groupBy("title").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def pair_samples(spark, d):
    """Pairs with the documents of their expected chunks and the beginning of each document's first chunk."""
    c = table(spark, d, "document_chunks").select(key("id").alias("chunk_id"), "doc_id", "chunk_index", "content").where("chunk_id is not null").distinct()
    named = _pairs(spark, d).select("id", F.explode("expected_chunk_ids").alias("raw")).select("id", key("raw").alias("chunk_id")).dropna().distinct()
    first = c.where("content is not null").groupBy("doc_id").agg(F.min(F.struct("chunk_index", "chunk_id", F.substring("content", 1, 80).alias("head")))["head"].alias("sample"))
    docs = table(spark, d, "documents").select(F.col("id").alias("doc_id"), "title")
    return named.join(c.select("chunk_id", "doc_id").distinct(), "chunk_id").select("id", "doc_id").distinct().join(docs, "doc_id", "left").join(first, "doc_id", "left").select("id", "title", "sample")


def hint_chunks(spark, d):
    """Of the document whose title a question ends like the four chunks that hold most of the question's words."""
    pairs = _pairs(spark, d).select("id", tokens(F.col("question")).alias("hints"))
    ids = table(spark, d, "documents").select("doc_id", F.col("id").alias("of"))
    chunks = _chunks(spark, d, F.col("doc_id").alias("of"), F.lower("content").alias("low")).where("low is not null")
    rows = _mentions(spark, d).select("id", "doc_id").join(ids, "doc_id").join(chunks, "of").join(pairs, "id")
    scored = rows.select("id", "chunk_id", F.size(F.filter("hints", lambda h: F.contains(F.col("low"), h))).alias("held")).where("held > 0")
    order = Window.partitionBy("id").orderBy(F.desc("held"), "chunk_id")
    return scored.withColumn("place", F.row_number().over(order)).where("place <= 4")


def base_resolution(spark, d):
    """The base of each dataset: by its id, else the first whose name begins with the first part of the dataset's, else the one with most documents."""
    sets = table(spark, d, "eval_datasets").select(key("id").alias("id"), "kb_id", F.substring_index("name", "-", 1).alias("part")).dropDuplicates(["id"])
    bases = table(spark, d, "knowledge_bases").select(F.col("id").alias("base"), F.lower("name").alias("base_name"))
    named = bases.withColumn("part", F.split("base_name", " ").getItem(0)).groupBy("part").agg(F.min("base").alias("by_name"))
    most = table(spark, d, "documents").where("kb_id is not null").groupBy("kb_id").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", F.col("kb_id").alias("most")))["most"].alias("most"))
    found = sets.join(bases.select(F.col("base").alias("kb_id"), F.col("base").alias("by_id")), "kb_id", "left").join(named, "part", "left").crossJoin(F.broadcast(most))  # one row
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("size")
    return found.select("id", how.alias("how"), F.coalesce("by_id", "by_name", "most").alias("base"))


def keyword_documents(spark, d):
    """The five documents that hold each word of the trade most often, whatever its case."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"))
    hits = F.explode(F.array(*(F.struct(F.lit(w).alias("word"), ((F.length("t") - F.length(F.replace("t", F.lit(w.lower()), F.lit("")))) / len(w)).cast("int").alias("hits")) for w in KEYWORDS)))
    order = Window.partitionBy("word").orderBy(F.desc("hits"), "doc_id")
    return docs.select("doc_id", hits.alias("x")).select("doc_id", "x.word", "x.hits").where("hits > 0").withColumn("place", F.row_number().over(order)).where("place <= 5")


def gt_counters(spark, d):
    """What evaluation pairs are worth: ten counters over all of them."""
    p = _pairs(spark, d)
    chunks = _chunks(spark, d, F.lit(True).alias("there"))
    refs = p.select("id", F.explode("expected_chunk_ids").alias("raw")).select("id", key("raw").alias("chunk_id")).join(chunks, "chunk_id", "left")
    per = refs.groupBy("id").agg(F.count("*").alias("refs"), F.count_if(F.col("chunk_id").isNull()).alias("blank"), F.count_if("there").alias("found"), F.countDistinct("chunk_id").alias("different"))
    sets = table(spark, d, "eval_datasets").select(key("id").alias("dataset_id"), F.lit(True).alias("known")).dropna().distinct()
    r = p.select("id", key("dataset_id").alias("dataset_id"), "relevant_doc_titles", "reference_answer", "is_stale").join(per, "id", "left").join(sets, "dataset_id", "left").fillna(0, ["refs", "blank", "found", "different"])
    return r.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("refs") > 0).alias("with_refs"), F.count_if(F.col("refs") == 0).alias("without_refs"), F.sum("refs").alias("refs"), F.sum("found").alias("refs_found"), F.sum("blank").alias("refs_blank"),
        F.count_if((F.col("refs") > 0) & (F.col("found") == F.col("refs"))).alias("complete"), F.count_if(F.col("different") < F.col("refs") - F.col("blank")).alias("repeating"), F.count_if(F.coalesce("is_stale", F.lit(False))).alias("stale"), F.count_if(F.col("known").isNull()).alias("without_dataset"),
    )


def missed_references(spark, d):
    """Per dataset the expected chunks that exist and those that are missed."""
    p = _pairs(spark, d).select("id", key("dataset_id").alias("dataset_id"), F.explode("expected_chunk_ids").alias("raw")).select("id", "dataset_id", key("raw").alias("chunk_id")).dropna(subset=["chunk_id"]).distinct()
    return p.join(_chunks(spark, d, F.lit(True).alias("there")), "chunk_id", "left").groupBy("dataset_id").agg(F.count_if("there").alias("matched"), F.count_if(F.col("there").isNull()).alias("missed"))


def sampled_chunks(spark, d):
    """A seeded sample: five documents of each base, then two chunks of each."""
    by = lambda col: F.md5(F.concat(F.lit(SEED), F.col(col)))
    docs = table(spark, d, "documents").select("kb_id", F.col("id").alias("doc_id")).withColumn("n", F.row_number().over(Window.partitionBy("kb_id").orderBy(by("doc_id")))).where("n <= 5")
    chunks = _chunks(spark, d, "doc_id").join(docs.select("kb_id", "doc_id"), "doc_id")
    return chunks.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(by("chunk_id")))).where("n <= 2").select("kb_id", "doc_id", "chunk_id")


def last_turns(spark, d):
    """The last ten messages of each conversation, in order of time."""
    m = table(spark, d, "messages").where("created_at is not null").select("id", key("conversation_id").alias("conversation_id"), "created_at").where("conversation_id is not null").distinct()
    back = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    ten = m.withColumn("back", F.row_number().over(back)).where("back <= 10")
    return ten.select("conversation_id", "id", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("back"))).alias("place"))


def title_patterns(spark, d):
    """Documents whose title is like what a user typed, wildcards included."""
    docs = table(spark, d, "documents").where("title is not null").select("title")
    hits = [F.count_if(F.col("title").like(f"%{p}%")).alias(f"p{i}") for i, p in enumerate(("Notes", "na_i", "%`"))]
    return docs.agg(*hits)


def metadata_filter(spark, d):
    """Chunks of each base whose metadata say French and Markdown."""
    kept = table(spark, d, "document_chunks").select(key("id").alias("id"), "kb_id", "metadata_json").where(metadata_matches(F.col("metadata_json"), {"language": "fr", "file_extension": ".md"}))
    return kept.groupBy("kb_id").agg(F.countDistinct("id").alias("chunks"))


def metadata_keys(spark, d):
    """What else metadata say once the language is taken out, and of how many chunks."""
    left = without_key(F.col("metadata_json"), "language")
    keys = F.array_join(F.array_sort(F.coalesce(F.json_object_keys(left), F.array().cast("array<string>"))), ",")
    return _chunks(spark, d, "metadata_json").select(keys.alias("other_keys")).groupBy("other_keys").agg(F.count("*").alias("chunks"))


def label_sources(spark, d):
    """What stands for a pair's labels: its titles, else its tags, else nothing; an empty list counts as none."""
    p = _pairs(spark, d).select("question_type", F.size(first_of(F.col("relevant_doc_titles"), F.col("tags"))).alias("n"))
    return p.groupBy("question_type").agg(F.count("*").alias("pairs"), F.sum("n").alias("labels"), F.count_if(F.col("n") == 0).alias("without"))


def vector_lengths(spark, d):
    """How many vectors have another length than 64."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    return v.agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") != 64).alias("other_length"))


def rating_summary(spark, d):
    """The mean rating of each model and how often each was given."""
    m = table(spark, d, "messages").where("user_rating is not null").dropDuplicates(["id"])
    counts = m.groupBy("llm_model", "user_rating").agg(F.count("*").alias("n"))
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_rating", "n"))), lambda x: F.concat_ws(":", x["user_rating"].cast("string"), x["n"].cast("string"))), ",")
    return counts.groupBy("llm_model").agg(F.round(F.sum(F.col("user_rating") * F.col("n")) / F.sum("n"), 4).alias("mean"), pairs.alias("histogram"))  # a row per rating


def base_quality(spark, d):
    """Per base: signs before and after line cleaning, what part goes, types of chunks and tokens per chunk."""
    c = _chunks(spark, d, "kb_id", "chunk_type", "content", "token_count")
    after = F.length(C.without_noise(C.trimmed_lines(F.col("content"))))
    sums = c.groupBy("kb_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("before"), F.sum(after).alias("after"), F.round(F.avg("token_count"), 1).alias("avg_tokens"))
    types = c.groupBy("kb_id", F.coalesce("chunk_type", F.lit("-")).alias("kind")).agg(F.count("*").alias("n"))
    named = types.groupBy("kb_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws(":", x["kind"], x["n"].cast("string"))), ",").alias("types"))  # a row per type
    return sums.join(named, sums.kb_id.eqNullSafe(named.kb_id)).select(sums.kb_id, "chunks", "before", "after", F.round(100 * (F.col("before") - F.col("after")) / F.col("before"), 1).alias("removed_pct"), "avg_tokens", "types")


def embedding_inputs(spark, d):
    """What would be embedded of each chunk: its document's title before it."""
    docs = table(spark, d, "documents").select(F.col("id").alias("doc_id"), "title")
    rows = _chunks(spark, d, "doc_id", "content").where("content is not null").join(docs, "doc_id", "left")
    return rows.select("chunk_id", F.sha2(C.titled(F.coalesce("title", F.lit("")), F.col("content")), 256).alias("hash"), C.model_tokens(F.col("content")).alias("billed"))


def page_headers(spark, d):
    """The header that each document's page would bear."""
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.sha2(C.front_matter(F.col("title"), F.col("source")), 256).alias("hash"))


def ordered_dump(spark, d):
    """Chunks by title of their document and place in it."""
    docs = table(spark, d, "documents").select(F.col("id").alias("doc_id"), "title")
    return _chunks(spark, d, "doc_id", "chunk_index").join(docs, "doc_id").select("title", "chunk_index", "chunk_id").orderBy("title", "chunk_index", "chunk_id")


def exercise_candidates(spark, d):
    """Chunks worth an exercise that no pair expects: of a drilled type and at least 15 tokens, per base."""
    named = table(spark, d, "eval_qa_pairs").select(F.explode("expected_chunk_ids").alias("raw")).select(key("raw").alias("chunk_id")).dropna().distinct()
    c = _chunks(spark, d, "kb_id", "chunk_type", "token_count").where(F.col("chunk_type").isin(*DRILL_TYPES) & (F.col("token_count") >= 15))
    return c.join(named, "chunk_id", "left_anti").groupBy("kb_id").agg(F.count("*").alias("chunks"))


def index_verified(spark, d):
    """Per base the chunks of the table, those of them that the index of vectors holds, and whether these are all."""
    c = _chunks(spark, d, "kb_id")
    index = table(spark, d, "document_chunks").select(key("vector_id").alias("chunk_id")).dropna()
    return sinks.verified(c, index, "chunk_id", "kb_id")


def base_deletion(spark, d):
    """What is left of each table once the bases without visibility are deleted with all that hangs on them."""
    bases = table(spark, d, "knowledge_bases").select(F.col("id").alias("kb_id"), "visibility")
    sets = table(spark, d, "eval_datasets").select(key("id").alias("dataset_id"), "kb_id").distinct()
    pairs = table(spark, d, "eval_qa_pairs").select(key("id").alias("qa_id"), key("dataset_id").alias("dataset_id")).distinct()
    refs = table(spark, d, "eval_qa_pairs").select(key("id").alias("qa_id"), F.explode("expected_chunk_ids").alias("raw")).select("qa_id", key("raw").alias("chunk_id")).distinct()
    left = sinks.cascaded(bases.where("visibility is null").select("kb_id"), [("knowledge_bases", bases, "kb_id", None), ("eval_datasets", sets, "dataset_id", "kb_id"), ("eval_qa_pairs", pairs, "qa_id", "dataset_id"), ("references", refs, "chunk_id", "qa_id")])
    parts = [df.agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(n)) for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def merged_documents(spark, d):
    """Chunks per document once documents with one text in one base are merged into the first."""
    docs = table(spark, d, "documents").select("id", "kb_id", "doc_hash", "created_at", "doc_id").where("doc_hash is not null")
    first = docs.groupBy("kb_id", "doc_hash").agg(F.min(F.struct("created_at", "doc_id", "id"))["id"].alias("new"))
    canonical = docs.join(first, ["kb_id", "doc_hash"]).where("id <> new").select(F.col("id").alias("old"), "new")
    return sinks.remapped(_chunks(spark, d, "doc_id"), canonical, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"))


def reindexed_chunks(spark, d):
    """Chunks per base after a reindex of the documents of web imports, where documents without text fail and keep their old chunks."""
    old = _chunks(spark, d, F.col("doc_id").alias("of"), "kb_id")
    docs = table(spark, d, "documents").select(F.col("id").alias("of"), "kb_id", "text", "source_type").where("source_type = 'url'")
    new = docs.where(F.length("text") > 0).select(F.sha2(F.concat_ws("|", "of", "text"), 256).alias("chunk_id"), "of", "kb_id")  # one chunk each stands for the pipeline's
    return sinks.reindexed(old, new, docs.select("of"), "of").groupBy("kb_id").agg(F.count("*").alias("chunks"))


def counter_check(spark, d):
    """Documents whose stored counters are not what their text gives, per kind: signs, words and hash."""
    t = table(spark, d, "documents").select("source_type", "n_chars", "word_count", "doc_hash", "text")
    wrong = lambda stored, made: F.count_if(~stored.eqNullSafe(made))
    words = F.when(F.col("text").isNotNull(), C.word_count(F.col("text")))
    return t.groupBy("source_type").agg(F.count("*").alias("documents"), wrong(F.col("n_chars"), F.length("text").cast("bigint")).alias("signs"), wrong(F.col("word_count"), words).alias("words"), wrong(F.col("doc_hash"), F.sha2("text", 256)).alias("hashes"))


def nearest_vectors(spark, d):
    """The vector most like each query vector, other than itself."""
    return _dense(spark, d, 2).where("doc <> query").groupBy("query").agg(F.min(F.struct("rank", "doc", F.round("score", 4).alias("score"))).alias("best")).select("query", "best.doc", "best.score")


def exercise_modes(spark, d):
    """Of all exercises, seen by the first learner: how many are in each mode of a session."""
    answers = _answers(spark, d)
    one = answers.agg(F.min("learner").alias("learner"), F.max("at").alias("now"))  # one row
    states = review_states(answers.join(F.broadcast(one.select("learner")), "learner")).select("exercise", "reviews", "correct", "due_at", "mastered")
    all_of = answers.select("exercise").dropna().distinct().join(states, "exercise", "left").crossJoin(F.broadcast(one))
    return all_of.agg(*(F.count_if(in_mode(m, F.col("now"))).alias(m) for m in ("new", "due", "review", "wrong", "all")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest of each base's ids from rows in order: a task holds one running hash."""
    started, base, n, digest, out = False, None, 0, None, []
    for batch in batches:
        for kb, chunk in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or kb != base:
                if started:
                    out.append((base, n, digest.hexdigest()[:16]))
                started, base, n, digest = True, kb, 0, hashlib.sha256()
            digest.update(("|" if n else "").encode() + chunk.encode())
            n += 1
    if started:
        out.append((base, n, digest.hexdigest()[:16]))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["kb_id", "chunks", "version"])


def collection_versions(spark, d):
    """Per base the number of its chunks and the version that their sorted ids give."""
    ids = table(spark, d, "document_chunks").select("kb_id", "id").where("id is not null").distinct()
    return ids.repartition("kb_id").sortWithinPartitions("kb_id", "id").mapInArrow(_digest, "kb_id string, chunks bigint, version string")


_P = f"p AS (SELECT DISTINCT ON ({K('id')}) * REPLACE ({K('id')} AS id) FROM eval_qa_pairs WHERE {K('id')} IS NOT NULL)"
_C = f"c AS (SELECT DISTINCT ON ({K('id')}) *, {K('id')} AS chunk_id FROM document_chunks WHERE {K('id')} IS NOT NULL)"
_R = f"r AS (SELECT DISTINCT id, {K('raw')} AS chunk_id FROM (SELECT id, unnest(expected_chunk_ids) AS raw FROM p) WHERE {K('raw')} IS NOT NULL)"
_M = r"m AS (SELECT q.id, needle, min(d.doc_id) AS doc_id FROM (SELECT id, regexp_extract(question, '(\S+ \S+ \S+)\?$', 1) AS needle FROM p) q JOIN documents d ON contains(d.title, needle) WHERE needle <> '' GROUP BY 1, 2)"
_NOISE = C.NOISE.replace("'", "''")
QUERIES = {
    "audit_by_month": (
        audit_by_month,
        _PAIRS
        + f"""SELECT strftime(q.created_at, '%Y-%m') AS month, lower(q.difficulty) AS difficulty, count(*) AS queries, round(avg(h), 4) AS hit, round(avg(rec), 4) AS recall, round(stddev_pop(h), 4) AS deviation,
        count(*) FILTER (WHERE n > 0 AND got > 0) AS chunk_hit, count(*) FILTER (WHERE n > 0 AND got = 0 AND near > 0) AS chunk_drift, count(*) FILTER (WHERE n > 0 AND got = 0 AND near = 0) AS miss
        FROM (SELECT *, CASE WHEN n > 0 THEN (got > 0)::INT ELSE 0 END AS h, CASE WHEN n > 0 THEN round(got / least(n, {TOP}), 6) END AS rec FROM r) r JOIN (SELECT DISTINCT ON ({K('id')}) {K('id')} AS id, created_at, difficulty FROM eval_qa_pairs) q ON q.id = r.query GROUP BY 1, 2""",
    ),
    "documents_with_base": (documents_with_base, "SELECT k.name, k.visibility, d.source_type, count(*) AS documents FROM documents d LEFT JOIN knowledge_bases k ON k.id = d.kb_id GROUP BY 1, 2, 3"),
    "title_mentions": (title_mentions, f"WITH {_P}, {_M} SELECT * FROM m"),
    "stale_references": (
        stale_references,
        f"""WITH {_P}, {_C}, {_R}, {_M}, x AS (SELECT r.id, count(*) AS direct FROM r JOIN c USING (chunk_id) GROUP BY 1), t AS (SELECT m.id, count(*) AS titled FROM m JOIN documents d USING (doc_id) JOIN c ON c.doc_id = d.id GROUP BY 1)
        SELECT p.id, CASE WHEN direct > 0 THEN 'direct' WHEN titled > 0 THEN 'by title' ELSE 'none' END AS how, coalesce(direct, titled, 0) AS chunks FROM p LEFT JOIN x USING (id) LEFT JOIN t USING (id)""",
    ),
    "id_overlap": (
        id_overlap,
        f"""WITH s AS (SELECT {K('id')} AS id, 'chunk' AS n FROM document_chunks UNION SELECT {K('vector_id')}, 'vector' FROM document_chunks UNION SELECT {K('raw')}, 'expected' FROM (SELECT unnest(expected_chunk_ids) AS raw FROM eval_qa_pairs))
        SELECT chunk, vector, expected, count(*) AS ids FROM (SELECT id, bool_or(n = 'chunk') AS chunk, bool_or(n = 'vector') AS vector, bool_or(n = 'expected') AS expected FROM s WHERE id IS NOT NULL GROUP BY 1) GROUP BY 1, 2, 3""",
    ),
    "chunk_titles": (chunk_titles, f"WITH {_C} SELECT d.title, count(*) AS chunks, sum(c.token_count) AS tokens FROM c JOIN documents d ON d.id = c.doc_id GROUP BY 1"),
    "pair_samples": (
        pair_samples,
        f"""WITH {_P}, {_R}, f AS (SELECT doc_id, arg_min(content[1:80], (chunk_index, {K('id')})) AS sample FROM document_chunks WHERE content IS NOT NULL AND {K('id')} IS NOT NULL GROUP BY 1)
        SELECT x.id, d.title, f.sample FROM (SELECT DISTINCT r.id, k.doc_id FROM r JOIN document_chunks k ON {K('k.id')} = r.chunk_id) x LEFT JOIN documents d ON d.id = x.doc_id LEFT JOIN f ON f.doc_id = x.doc_id""",
    ),
    "hint_chunks": (
        hint_chunks,
        f"""WITH {_P}, {_C}, {_M}, h AS (SELECT id, {_TOKENS.format('question')} AS hints FROM p WHERE question IS NOT NULL)
        SELECT id, chunk_id, held::INT AS held, row_number() OVER (PARTITION BY id ORDER BY held DESC, chunk_id) AS place FROM (SELECT m.id, c.chunk_id, len(list_filter(hints, lambda x: contains(lower(c.content), x))) AS held FROM m JOIN documents d USING (doc_id) JOIN c ON c.doc_id = d.id JOIN h ON h.id = m.id WHERE c.content IS NOT NULL) WHERE held > 0 QUALIFY place <= 4""",
    ),
    "base_resolution": (
        base_resolution,
        f"""WITH s AS (SELECT DISTINCT ON ({K('id')}) {K('id')} AS id, kb_id, split_part(name, '-', 1) AS part FROM eval_datasets), n AS (SELECT split_part(lower(name), ' ', 1) AS part, min(id) AS by_name FROM knowledge_bases GROUP BY 1),
        b AS (SELECT max_by(kb_id, (n, kb_id)) AS most FROM (SELECT kb_id, count(*) AS n FROM documents WHERE kb_id IS NOT NULL GROUP BY 1))
        SELECT s.id, CASE WHEN k.id IS NOT NULL THEN 'id' WHEN by_name IS NOT NULL THEN 'name' ELSE 'size' END AS how, coalesce(k.id, by_name, most) AS base FROM s LEFT JOIN knowledge_bases k ON k.id = s.kb_id LEFT JOIN n USING (part), b""",
    ),
    "keyword_documents": (
        keyword_documents,
        "SELECT *, row_number() OVER (PARTITION BY word ORDER BY hits DESC, doc_id) AS place FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{w}' AS word, ((length(lower(text)) - length(replace(lower(text), '{w.lower()}', ''))) // {len(w)})::INT AS hits FROM documents WHERE text IS NOT NULL" for w in KEYWORDS) + ") WHERE hits > 0 QUALIFY place <= 5",
    ),
    "gt_counters": (
        gt_counters,
        f"""WITH {_P}, {_C}, e AS (SELECT id, {K('raw')} AS chunk_id FROM (SELECT id, unnest(expected_chunk_ids) AS raw FROM p)),
        per AS (SELECT e.id, count(*) AS refs, count(*) FILTER (WHERE e.chunk_id IS NULL) AS blank, count(c.chunk_id) AS found, count(DISTINCT e.chunk_id) AS different FROM e LEFT JOIN c USING (chunk_id) GROUP BY 1), s AS (SELECT DISTINCT {K('id')} AS dataset_id FROM eval_datasets)
        SELECT count(*) AS pairs, count(*) FILTER (WHERE coalesce(refs, 0) > 0) AS with_refs, count(*) FILTER (WHERE coalesce(refs, 0) = 0) AS without_refs, sum(coalesce(refs, 0)) AS refs, sum(coalesce(found, 0)) AS refs_found, sum(coalesce(blank, 0)) AS refs_blank,
        count(*) FILTER (WHERE refs > 0 AND found = refs) AS complete, count(*) FILTER (WHERE different < refs - blank) AS repeating, count(*) FILTER (WHERE is_stale) AS stale, count(*) FILTER (WHERE s.dataset_id IS NULL) AS without_dataset FROM p LEFT JOIN per USING (id) LEFT JOIN s ON s.dataset_id = {K('p.dataset_id')}""",
    ),
    "missed_references": (
        missed_references,
        f"WITH {_P}, {_C}, {_R} SELECT {K('p.dataset_id')} AS dataset_id, count(c.chunk_id) AS matched, count(*) - count(c.chunk_id) AS missed FROM r JOIN p USING (id) LEFT JOIN c USING (chunk_id) GROUP BY 1",
    ),
    "sampled_chunks": (
        sampled_chunks,
        f"""WITH {_C}, d AS (SELECT kb_id, id FROM documents QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY md5('{SEED}' || id)) <= 5)
        SELECT d.kb_id, d.id AS doc_id, chunk_id FROM c JOIN d ON d.id = c.doc_id QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY md5('{SEED}' || chunk_id)) <= 2""",
    ),
    "last_turns": (
        last_turns,
        f"""SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY back DESC) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS back
        FROM (SELECT DISTINCT id, {K('conversation_id')} AS conversation_id, created_at FROM messages WHERE created_at IS NOT NULL AND {K('conversation_id')} IS NOT NULL) QUALIFY back <= 10)""",
    ),
    "title_patterns": (title_patterns, "SELECT count(*) FILTER (WHERE title LIKE '%Notes%') AS p0, count(*) FILTER (WHERE title LIKE '%na_i%') AS p1, count(*) FILTER (WHERE title LIKE '%%`%') AS p2 FROM documents"),
    "metadata_filter": (
        metadata_filter,
        f"SELECT kb_id, count(DISTINCT {K('id')}) AS chunks FROM document_chunks WHERE json_extract_string(metadata_json, '$.language') = 'fr' AND json_extract_string(metadata_json, '$.file_extension') = '.md' GROUP BY 1",
    ),
    "metadata_keys": (metadata_keys, f"WITH {_C} SELECT other_keys, count(*) AS chunks FROM (SELECT array_to_string(list_sort(list_filter(coalesce(json_keys(metadata_json), []), lambda k: k <> 'language')), ',') AS other_keys FROM c) GROUP BY 1"),
    "label_sources": (
        label_sources,
        f"WITH {_P} SELECT question_type, count(*) AS pairs, sum(n) AS labels, count(*) FILTER (WHERE n = 0) AS without FROM (SELECT question_type, CASE WHEN len(relevant_doc_titles) > 0 THEN len(relevant_doc_titles) ELSE coalesce(len(tags), 0) END AS n FROM p) GROUP BY 1",
    ),
    "vector_lengths": (vector_lengths, "SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS other_length FROM embeddings WHERE embedding IS NOT NULL"),
    "rating_summary": (
        rating_summary,
        "SELECT llm_model, round(sum(user_rating * n) / sum(n), 4) AS mean, string_agg(user_rating || ':' || n, ',' ORDER BY user_rating) AS histogram FROM (SELECT llm_model, user_rating, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM messages) WHERE user_rating IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    ),
    "base_quality": (
        base_quality,
        f"""WITH {_C}, x AS (SELECT kb_id, coalesce(chunk_type, '-') AS kind, token_count, length(content) AS before, length(array_to_string(list_filter(string_split(regexp_replace(content, '(?m)[ \\t]+$', '', 'g'), chr(10)), lambda l: NOT regexp_matches(l, '{_NOISE}')), chr(10))) AS after FROM c),
        t AS (SELECT kb_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS types FROM (SELECT kb_id, kind, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1)
        SELECT s.kb_id, chunks, before, after, round(100 * (before - after) / before, 1) AS removed_pct, avg_tokens, types FROM (SELECT kb_id, count(*) AS chunks, sum(before) AS before, sum(after) AS after, round(avg(token_count), 1) AS avg_tokens FROM x GROUP BY 1) s JOIN t ON t.kb_id IS NOT DISTINCT FROM s.kb_id""",
    ),
    "embedding_inputs": (
        embedding_inputs,
        f"WITH {_C} SELECT chunk_id, sha256(CASE WHEN trim(coalesce(d.title, '')) <> '' THEN d.title || ' —— ' || content ELSE content END) AS hash, (length(content) // 4)::INT AS billed FROM c LEFT JOIN documents d ON d.id = c.doc_id WHERE content IS NOT NULL",
    ),
    "page_headers": (
        page_headers,
        r"SELECT doc_id, sha256('---' || chr(10) || 'title: ' || title || chr(10) || 'topic: ' || coalesce(source, '') || chr(10) || 'version: ' || coalesce(nullif(regexp_extract(title, '\d+\.\d+'), ''), '3.13') || chr(10) || '---' || chr(10)) AS hash FROM documents WHERE title IS NOT NULL",
    ),
    "ordered_dump": (ordered_dump, f"WITH {_C} SELECT d.title, c.chunk_index, c.chunk_id FROM c JOIN documents d ON d.id = c.doc_id"),
    "exercise_candidates": (
        exercise_candidates,
        f"WITH {_P}, {_C} SELECT kb_id, count(*) AS chunks FROM c WHERE chunk_type IN {DRILL_TYPES} AND token_count >= 15 AND chunk_id NOT IN (SELECT {K('raw')} FROM (SELECT unnest(expected_chunk_ids) AS raw FROM eval_qa_pairs) WHERE {K('raw')} IS NOT NULL) GROUP BY 1",
    ),
    "index_verified": (
        index_verified,
        f"WITH {_C} SELECT kb_id, count(*) AS expected, count(*) FILTER (WHERE chunk_id IN (SELECT {K('vector_id')} FROM document_chunks WHERE {K('vector_id')} IS NOT NULL)) AS indexed, count(*) = indexed AS complete FROM c GROUP BY 1",
    ),
    "base_deletion": (
        base_deletion,
        f"""WITH k AS (SELECT id FROM knowledge_bases WHERE visibility IS NULL), s AS (SELECT DISTINCT {K('id')} AS id, kb_id FROM eval_datasets), sg AS (SELECT id FROM s WHERE kb_id IN (FROM k)), q AS (SELECT DISTINCT {K('id')} AS id, {K('dataset_id')} AS dataset_id FROM eval_qa_pairs),
        qg AS (SELECT id FROM q WHERE dataset_id IN (FROM sg)), e AS (SELECT DISTINCT {K('id')} AS id, {K('raw')} AS c FROM (SELECT id, unnest(expected_chunk_ids) AS raw FROM eval_qa_pairs))
        SELECT 'knowledge_bases' AS table_name, count(*) AS rows FROM knowledge_bases WHERE visibility IS NOT NULL UNION ALL SELECT 'eval_datasets', count(*) FROM s WHERE id NOT IN (FROM sg) UNION ALL SELECT 'eval_qa_pairs', count(*) FROM q WHERE id NOT IN (FROM qg) UNION ALL SELECT 'references', count(*) FROM e WHERE id NOT IN (FROM qg)""",
    ),
    "merged_documents": (
        merged_documents,
        f"""WITH {_C}, n AS (SELECT id, first_value(id) OVER (PARTITION BY kb_id, doc_hash ORDER BY created_at NULLS FIRST, doc_id, id) AS new FROM documents WHERE doc_hash IS NOT NULL AND kb_id IS NOT NULL)
        SELECT coalesce(n.new, c.doc_id) AS doc_id, count(*) AS chunks FROM c LEFT JOIN n ON n.id = c.doc_id GROUP BY 1""",
    ),
    "reindexed_chunks": (
        reindexed_chunks,
        f"""WITH {_C}, u AS (SELECT id, kb_id, coalesce(length(text), 0) > 0 AS ok FROM documents WHERE source_type = 'url')
        SELECT kb_id, count(*) AS chunks FROM (SELECT c.kb_id FROM c WHERE c.doc_id IS NULL OR c.doc_id NOT IN (SELECT id FROM u WHERE ok) UNION ALL SELECT kb_id FROM u WHERE ok) GROUP BY 1""",
    ),
    "counter_check": (
        counter_check,
        r"""SELECT source_type, count(*) AS documents, count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS signs,
        count(*) FILTER (WHERE word_count IS DISTINCT FROM CASE WHEN text IS NOT NULL THEN len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) END) AS words,
        count(*) FILTER (WHERE doc_hash IS DISTINCT FROM sha256(text)) AS hashes FROM documents GROUP BY 1""",
    ),
    "nearest_vectors": (
        nearest_vectors,
        _DENSE + "SELECT query, arg_min(doc, rank) AS doc, round(arg_min(score, rank), 4) AS score FROM dense WHERE doc <> query AND rank <= 2 GROUP BY 1",
    ),
    "exercise_modes": (
        exercise_modes,
        _FOLD
        + """, x AS (SELECT DISTINCT json_extract_string(props, '$.k') AS exercise FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
        o AS (SELECT *, last_at + days * INTERVAL 1 DAY AS due_at FROM last WHERE learner = (SELECT min(user_id) FROM events)::VARCHAR), n AS (SELECT max(ts) AS now FROM events)
        SELECT count(*) FILTER (WHERE reviews IS NULL) AS new, count(*) FILTER (WHERE due_at <= now AND NOT mastered) AS due, count(*) FILTER (WHERE due_at <= now) AS review, count(*) FILTER (WHERE reviews > correct) AS wrong, count(*) AS "all" FROM x LEFT JOIN o USING (exercise), n""",
    ),
    "collection_versions": (
        collection_versions,
        "SELECT kb_id, count(*) AS chunks, sha256(string_agg(id, '|' ORDER BY id))[1:16] AS version FROM (SELECT DISTINCT kb_id, id FROM document_chunks WHERE id IS NOT NULL) GROUP BY kb_id",
    ),
}
