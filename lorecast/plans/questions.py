"""Queries on what messages ask and how questions are prepared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions import questions as Q
from lorecast.functions.keys import key
from lorecast.functions.roles import ROLES, readable_role
from lorecast.plans.relations import K as key_sql
from lorecast.session import table


def intent_classify(spark, d):
    """Intents of user messages, whatever the spelling of the role: how many of each, and their signs."""
    m = table(spark, d, "messages").where(F.col("content").isNotNull() & (readable_role(F.col("role")) == "user")).select("id", "content").distinct()
    return m.select(Q.intent(F.col("content")).alias("intent"), F.length("content").alias("n")).groupBy("intent").agg(F.count("*").alias("messages"), F.sum("n").alias("signs"))


def query_clean(spark, d):
    q = table(spark, d, "eval_qa_pairs").where("question is not null").select("id", "question").distinct()
    return q.select("id", Q.cleaned_question(F.col("question")).alias("cleaned"))


def prompt_build(spark, d):
    """For each user message the prompt of its turns so far, as a hash and a length.

    Turns bear their readable role; one whose role can't be read stays in the history under the role as written.
    """
    m = table(spark, d, "messages").where("conversation_id is not null and created_at is not null and content is not null and role is not null")
    m = m.select("id", key("conversation_id").alias("c"), F.coalesce(readable_role(F.col("role")), F.lower(F.trim("role"))).alias("role"), "content", "created_at").distinct()
    w = Window.partitionBy("c").orderBy("created_at", "id").rowsBetween(-6, -1)
    turns = m.withColumn("history", F.collect_list(F.struct("role", "content")).over(w)).where("role = 'user'")
    p = Q.prompt(F.array().cast("array<string>"), F.col("history"), F.col("content"))
    return turns.select("id", F.length(p).alias("signs"), F.sha2(p, 256).alias("hash"))


def question_ready(spark, d):
    """Per subject and intent the questions that can be searched as they stand, once cleaned and with abbreviations spelled out."""
    p = table(spark, d, "eval_qa_pairs").where("question is not null").select("id", "subject", "question").distinct()
    clean = Q.spelled_out(Q.cleaned_question(F.col("question")), whole_words=False)
    rows = p.select("subject", Q.intent(F.col("question")).alias("intent"), Q.retrieval_ready(clean, F.lit(0)).alias("ready"), F.length(clean).alias("n"))
    return rows.groupBy("subject", "intent").agg(F.count("*").alias("questions"), F.count_if("ready").alias("ready"), F.sum("n").alias("signs"))


def question_standardize(spark, d):
    """Each user message resolved against the turns before it, cleaned and spelled out: what is searched, and whether it needs no rewriting."""
    m = table(spark, d, "messages").where("conversation_id is not null and created_at is not null and content is not null and role is not null")
    m = m.select("id", key("conversation_id").alias("c"), F.coalesce(readable_role(F.col("role")), F.lower(F.trim("role"))).alias("role"), "content", "created_at").distinct()
    w = Window.partitionBy("c").orderBy("created_at", "id").rowsBetween(-6, -1)
    turns = m.withColumn("history", F.collect_list(F.struct("role", "content")).over(w)).where("role = 'user'")
    named = turns.select("id", "content", F.size("history").alias("turns"), Q.entities(F.col("history")).alias("named"))
    clean = named.select("id", "turns", "named", Q.spelled_out(Q.cleaned_question(Q.resolved(F.col("content"), F.col("named")))).alias("cleaned"))
    return clean.select("id", "named", "cleaned", Q.retrieval_ready(F.col("cleaned"), F.col("turns")).alias("ready"))


def question_arithmetic(spark, d):
    """The arithmetic in messages that ask for a tool."""
    m = table(spark, d, "messages").where("content is not null").select("id", "content").distinct()
    return m.where(Q.intent(F.col("content")) == "tool").select("id", Q.arithmetic(F.col("content")).alias("expression"))


def expanded_terms(questions, dictionary):
    """``questions`` (..., text) with ``terms``: up to five related terms of the entries (entry, related) that the text holds, the
    longest entries first, none that the text holds itself. The dictionary is a parameter of bounded size and is broadcast."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("entry")).alias("n"), F.col("entry"), F.col("related"))))
    one = dictionary.agg(order.alias("entries"))
    low = F.lower("text")
    hit = F.filter("entries", lambda e: F.contains(low, F.lower(e["entry"])))
    fresh = F.filter(F.array_distinct(F.flatten(F.transform(hit, lambda e: e["related"]))), lambda t: ~F.contains(low, F.lower(t)))
    return questions.crossJoin(F.broadcast(one)).withColumn("terms", F.slice(fresh, 1, Q.KEPT_TERMS)).drop("entries")


def term_expansion(spark, d):
    """Questions with the tags that belong to the subjects they name behind them; the dictionary is what the pairs themselves say."""
    p = table(spark, d, "eval_qa_pairs").select("id", "subject", "tags", F.col("question").alias("text")).dropDuplicates(["id"])
    counts = p.select("subject", F.explode("tags").alias("tag")).where("subject is not null and tag is not null").groupBy("subject", "tag").agg(F.count("*").alias("n"))
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "tag"))).where("rank <= 10")
    dictionary = first.groupBy(F.col("subject").alias("entry")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("related"))  # at most ten a subject
    rows = expanded_terms(p.where("text is not null").select("id", "text"), dictionary)
    return rows.select("id", Q.appended(F.col("text"), F.col("terms")).alias("expanded"))


def _contexts(spark, d):
    """Each pair with up to five of its expected chunks, in the order in which it names them."""
    pairs = table(spark, d, "eval_qa_pairs").select(key("id").alias("id"), "question", "reference_answer", "expected_chunk_ids").dropDuplicates(["id"])
    named = pairs.select("id", F.posexplode("expected_chunk_ids").alias("pos", "raw")).where("pos < 5").select("id", "pos", key("raw").alias("chunk_id"))
    chunks = table(spark, d, "document_chunks").select(key("id").alias("chunk_id"), "doc_id", "content").where("content is not null").dropDuplicates(["chunk_id"])
    titles = table(spark, d, "documents").select(F.col("id").alias("doc_id"), "title")
    found = named.join(chunks, "chunk_id").join(titles, "doc_id", "left").select("id", F.struct("pos", F.coalesce("title", F.lit("")).alias("title"), "content").alias("c"))
    return pairs.join(found.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("contexts")), "id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<pos int, title string, content string>>")))  # at most five


def prompt_contexts(spark, d):
    """The prompt of each pair's question with its expected chunks, as a length and a hash."""
    p = Q.prompt(F.transform("contexts", lambda c: c["content"]), F.array().cast("array<struct<role string, content string>>"), F.col("question"))
    return _contexts(spark, d).where("question is not null").select("id", F.length(p).alias("signs"), F.sha2(p, 256).alias("hash"))


def cited_answers(spark, d):
    """Each reference answer with up to three of its chunks quoted below it."""
    quoted = Q.footnote(F.col("reference_answer"), F.transform("contexts", lambda c: F.struct(c["title"].alias("title"), c["content"].alias("content"))))
    return _contexts(spark, d).where("reference_answer is not null").select("id", F.length(quoted).alias("signs"), F.sha2(quoted, 256).alias("hash"))


def _sql(patterns) -> str:
    return ("(?i)" + "|".join(patterns)).replace("'", "''")


_KNOW = "(?i)" + "|".join(w.replace("'", "''") for w in Q.KNOWLEDGE)
_READ = "regexp_replace(lower(role), '[\\s:：\\[\\]().*#_-]+', '', 'g')"
_ROLE = "(CASE " + " ".join(f"WHEN {_READ} IN ({', '.join(repr(x) for x in xs)}) THEN '{r}'" for r, xs in ROLES.items()) + " ELSE lower(trim(role)) END)"
_INTENT = f"""(SELECT *, CASE WHEN g THEN 'greeting' WHEN m THEN 'meta' WHEN r AND k THEN 'knowledge' WHEN r AND o THEN 'tool' WHEN r THEN 'clarification' WHEN o THEN 'tool' WHEN k THEN 'knowledge' WHEN length(t) <= {Q.TINY} THEN 'clarification' END AS intent
  FROM (SELECT *, regexp_matches(t, '{_sql(Q.GREETING)}') AS g, regexp_matches(t, '{_sql(Q.META)}') AS m, length(t) <= {Q.SHORT} AND regexp_matches(t, '{_sql(Q.CLARIFICATION)}') AS r, regexp_matches(t, '{_sql(Q.TOOL)}') AS o, regexp_matches(t, '{_KNOW}') AS k FROM (SELECT *, trim(@TEXT@) AS t FROM @ROWS@)))"""
_NARROWED = f"translate(trim(regexp_replace(trim(regexp_replace(trim(question), '{_sql(Q.LEADING)}', '')), '{_sql(Q.TRAILING)}', '')), '{Q.WIDE}', '{Q.NARROW.replace(chr(39), chr(39) * 2)}')"
_CLEANED = f"""(SELECT *, CASE WHEN s <> '' THEN s ELSE trim(question) END AS cleaned FROM (SELECT *, regexp_replace(regexp_replace(replace(replace({_NARROWED}, 'ｐｙｔｈｏｎ', 'python'), 'ＰＹＴＨＯＮ', 'python'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t\\n\\r\\f]{{2,}}', ' ', 'g')[1:{Q.LONGEST}] AS s FROM @ROWS@))"""


def _in(sql: str, rows: str, text: str = "") -> str:
    return sql.replace("@ROWS@", rows).replace("@TEXT@", text)


_SPELLED = "cleaned"
for _short, _full in Q.ABBREVIATIONS.items():
    _SPELLED = f"replace({_SPELLED}, '{_short}', '{_full}')"
_READY = f"""length(trim(x)) >= {Q.READY_SIGNS} AND regexp_matches(x, '(?i){"|".join(w for w in Q.KNOWLEDGE if w not in Q.TOO_PLAIN)}') AND NOT regexp_matches(x, '{Q.POINTS_BACK}') AND NOT regexp_matches(x, '{Q.OPEN_ENDED}') AND NOT regexp_matches(x, '{Q.ADDRESSES}')
  AND NOT (regexp_matches(trim(x), '{Q.GENERIC_START}') AND length(trim(x)) < {Q.GENERIC_SIGNS} AND NOT regexp_matches(x, '{Q.SPECIFIC}')) AND NOT regexp_matches(trim(x), '{Q.FRAGMENT}')"""
_MATH = "content"
for _word, _sign in Q.OPERATORS:
    _MATH = f"replace({_MATH}, '{_word}', '{_sign}')"
_CONTEXTS = f"""WITH p AS (SELECT DISTINCT ON ({key_sql('id')}) {key_sql('id')} AS id, question, reference_answer, expected_chunk_ids FROM eval_qa_pairs),
n AS (SELECT id, pos, {key_sql('raw')} AS chunk_id FROM (SELECT id, unnest(expected_chunk_ids) AS raw, unnest(range(len(expected_chunk_ids))) AS pos FROM p) WHERE pos < 5),
c AS (SELECT DISTINCT ON ({key_sql('id')}) {key_sql('id')} AS chunk_id, doc_id, content FROM document_chunks WHERE content IS NOT NULL),
f AS (SELECT n.id, list(c.content ORDER BY pos) AS texts, list(coalesce(d.title, '') ORDER BY pos) AS titles FROM n JOIN c USING (chunk_id) LEFT JOIN documents d ON d.id = c.doc_id GROUP BY 1)
"""
QUERIES = {
    "intent_classify": (
        intent_classify,
        f"SELECT intent, count(*) AS messages, sum(length(content)) AS signs FROM {_in(_INTENT, f'(SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL AND {_ROLE} = {chr(39)}user{chr(39)})', 'content')} GROUP BY 1",
    ),
    "query_clean": (query_clean, f"SELECT id, cleaned FROM {_in(_CLEANED, '(SELECT DISTINCT id, question FROM eval_qa_pairs WHERE question IS NOT NULL)')}"),
    "question_ready": (
        question_ready,
        f"""SELECT subject, intent, count(*) AS questions, count(*) FILTER (WHERE {_READY}) AS ready, sum(length(x)) AS signs FROM (SELECT *, {_SPELLED} AS x FROM {_in(_INTENT, _in(_CLEANED, '(SELECT DISTINCT id, subject, question FROM eval_qa_pairs WHERE question IS NOT NULL)'), 'question')}) GROUP BY 1, 2""",
    ),
    "question_standardize": (question_standardize, None),
    "question_arithmetic": (
        question_arithmetic,
        f"SELECT id, trim(regexp_replace(split_part({_MATH}, '=', 1), '[^0-9+\\-*/().,%\\s]', '', 'g')) AS expression FROM {_in(_INTENT, '(SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL)', 'content')} WHERE intent = 'tool'",
    ),
    "term_expansion": (
        term_expansion,
        """WITH p AS (SELECT DISTINCT ON (id) id, subject, tags, question AS text FROM eval_qa_pairs),
        t AS (SELECT subject, tag, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, tag) AS rank FROM (SELECT subject, unnest(tags) AS tag FROM p) WHERE subject IS NOT NULL AND tag IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 10),
        h AS (SELECT p.id, t.tag, min((-length(t.subject), t.subject, t.rank)) AS place FROM p JOIN t ON contains(lower(p.text), lower(t.subject)) WHERE NOT contains(lower(p.text), lower(t.tag)) GROUP BY 1, 2),
        f AS (SELECT id, list(tag ORDER BY place) AS tags FROM h GROUP BY 1)
        SELECT p.id, CASE WHEN len(f.tags) > 0 THEN text || ' ' || array_to_string(f.tags[1:5], ' ') ELSE text END AS expanded FROM p LEFT JOIN f USING (id) WHERE text IS NOT NULL""",
    ),
    "prompt_contexts": (
        prompt_contexts,
        _CONTEXTS
        + """SELECT id, length(x) AS signs, sha256(x) AS hash FROM (SELECT id, concat_ws(chr(10) || chr(10), nullif(array_to_string(list_transform(coalesce(texts, []), lambda t, i: '[' || i || '] ' || t), chr(10) || chr(10)), ''), question) AS x FROM p LEFT JOIN f USING (id) WHERE question IS NOT NULL)""",
    ),
    "cited_answers": (
        cited_answers,
        _CONTEXTS
        + r"""SELECT id, length(x) AS signs, sha256(x) AS hash FROM (SELECT id, CASE WHEN regexp_matches(reference_answer, '\[\d+\]') OR texts IS NULL THEN reference_answer ELSE reference_answer || chr(10) || chr(10) || array_to_string(list_transform(texts[1:3], lambda t, i: '[' || i || '] ' || titles[i] || ': ' || t[1:80]), chr(10)) END AS x
        FROM p LEFT JOIN f USING (id) WHERE reference_answer IS NOT NULL)""",
    ),
    "prompt_build": (
        prompt_build,
        f"""SELECT id, length(p) AS signs, sha256(p) AS hash FROM (SELECT id, role, concat_ws(chr(10) || chr(10), nullif(coalesce(array_to_string(list(role || ': ' || content) OVER (PARTITION BY c ORDER BY created_at, id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), ''), ''), content) AS p
        FROM (SELECT DISTINCT id, {key_sql('conversation_id')} AS c, {_ROLE} AS role, content, created_at FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL AND content IS NOT NULL AND role IS NOT NULL)) WHERE role = 'user'""",
    ),
}
