"""Queries on retrieval: rows whose id is divisible by 100 ask, all rows answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.functions.keys import key, metadata_matches
from lorecast.operators import metrics
from lorecast.operators import retrieval as R
from lorecast.plans.relations import K as key_sql
from lorecast.session import table, write_shared

K = 5
#: Candidates of a search: twice as many as are asked for, and thirty at least.
CANDIDATES = max(2 * K, 30)


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "title", "text")


def _asking(spark, d):
    return _docs(spark, d).where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query"), F.col("title").alias("text"))


def bm25_index_stats(spark, d):
    """The most and least telling terms: document frequency and weight of every term."""
    docs = _docs(spark, d)
    stats = R.term_statistics(R.postings(docs, "doc_id", "text"), docs.count())
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    """The best documents for each title; a query that matches fewer gets the first documents of the corpus after them."""
    asking, docs = _asking(spark, d), _docs(spark, d)
    found = R.bm25_top_k(asking, docs, "doc_id", "text", K)
    return R.filled(found, asking, docs, "doc_id", K).select("query", "doc", "rank", F.round("score", 4).alias("score"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null")


def _dense(spark, d, k):
    v = _vectors(spark, d)
    return R.dense_top_k(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", k)


def dense_topk(spark, d):
    return _dense(spark, d, 10).select("query", "doc", "rank", F.round("score", 4).alias("score"))


def _both(spark, d):
    """The dense and the lexical list of each query, ``CANDIDATES`` long, written once. A vector bears the id of its document."""
    sparse = R.bm25_top_k(_asking(spark, d), _docs(spark, d), "doc_id", "text", CANDIDATES)
    columns = ["query", "doc", "score", "rank"]
    lists = _dense(spark, d, CANDIDATES).select(*columns, F.lit("dense").alias("list")).unionByName(sparse.select(*columns, F.lit("sparse").alias("list")))
    lists = write_shared(lists, "lists")
    return lists.where("list = 'dense'").drop("list"), lists.where("list = 'sparse'").drop("list")


def hybrid_fusion(spark, d):
    """Dense neighbours and lexical matches of each query, fused by weighted reciprocal ranks."""
    return R.fused(*_both(spark, d)).where("rank <= 10").select("query", "doc", "rank", F.round("score", 6).alias("score"))


def search_strategies(spark, d):
    """One search by each strategy: candidates are at least twice what is asked for, and thirty."""
    dense, sparse = _both(spark, d)
    named = {"dense": dense, "sparse": sparse, "hybrid": R.fused(dense, sparse)}
    parts = [lists.where(F.col("rank") <= K).select(F.lit(n).alias("strategy"), "query", "doc", "rank", F.round("score", 6).alias("score")) for n, lists in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def multi_query(spark, d):
    """Each document asked for by its title and by its beginning; of both lists every result keeps its better score."""
    docs = _docs(spark, d)
    asked = docs.where("doc_id % 100 = 0").select("doc_id", F.posexplode(F.array("title", F.substring("text", 1, 80))).alias("sub", "text")).where("text is not null")
    found = R.bm25_top_k(asked.select(F.struct("doc_id", "sub").alias("query"), "text"), docs, "doc_id", "text", 2 * K)
    lists = found.select(F.col("query.doc_id").alias("query"), F.col("query.sub").alias("sub"), "doc", "score")
    return R.merged(lists, K).select("query", "doc", "rank", F.round("score", 4).alias("score"))


def filtered_search(spark, d):
    """Chunks of French Markdown files for each title: the filter on the metadata comes before the search."""
    chunks = _chunks(spark, d).where(metadata_matches(F.col("metadata_json"), {"language": "fr", "file_extension": ".md"}))
    found = R.bm25_top_k(_asking(spark, d), chunks, "chunk_id", "content", K)
    return found.select("query", "doc", "rank", F.round("score", 4).alias("score"))


def ablation_grid(spark, d):
    """The fusion's weight varied in one plan: the measures of each setting over all queries."""
    dense, sparse = _both(spark, d)
    both = dense.select("query", "doc", F.col("rank").alias("rd")).join(sparse.select("query", "doc", F.col("rank").alias("rs")), ["query", "doc"], "full_outer")
    grid = both.withColumn("alpha", F.explode(F.array(*(F.lit(a / 10) for a in (0, 3, 6, 10)))))
    score = F.coalesce(F.col("alpha") / F.col("rd"), F.lit(0.0)) + F.coalesce((1 - F.col("alpha")) / F.col("rs"), F.lit(0.0))
    order = Window.partitionBy("alpha", "query").orderBy(F.desc(F.round(score, 9)), F.asc_nulls_last("rd"), F.asc_nulls_last("rs"))
    ranked = grid.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10)
    g, want, total = F.col("got"), F.col("want"), F.col("total")
    per = _judged(spark, d, ranked, "alpha").select("alpha", metrics.hit_at_k(g, want, K).alias("hit"), metrics.reciprocal_rank(g, want).alias("mrr"), metrics.ndcg_at_k(g, want, K, total).alias("ndcg"))
    return per.groupBy("alpha").agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 4).alias("hit"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"))


def _chunks(spark, d):
    return table(spark, d, "document_chunks").select(key("id").alias("chunk_id"), "doc_id", "content", "metadata_json").where("chunk_id is not null and content is not null").dropDuplicates(["chunk_id"])


def _pair_search(spark, d):
    """Questions of pairs whose id is divisible by 100 (its first eight digits) with what they expect and, by stage, the chunks found."""
    pairs = table(spark, d, "eval_qa_pairs").select(key("id").alias("query"), F.col("question").alias("text"), "expected_chunk_ids").where("query is not null and text is not null").dropDuplicates(["query"])
    pairs = pairs.where(F.conv(F.substring("query", 1, 8), 16, 10).cast("bigint") % 100 == 0)
    chunks = _chunks(spark, d)
    found = write_shared(R.bm25_top_k(pairs, chunks, "chunk_id", "content", CANDIDATES).select("query", "doc", "score", "rank"), "found")
    again = R.reranked(found, pairs, chunks.select("chunk_id", "content"), "chunk_id", "content", K).select("query", "doc", "rank")
    want = pairs.select("query", F.array_distinct(F.filter(F.transform(F.coalesce("expected_chunk_ids", F.array().cast("array<string>")), key), lambda x: x.isNotNull())).alias("want"))
    listed = lambda df, name: df.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias(name))  # noqa: E731 - at most CANDIDATES ids
    parents = found.where(F.col("rank") <= K).join(chunks.select(F.col("chunk_id").alias("doc"), "doc_id"), "doc").groupBy("query").agg(F.array_sort(F.collect_set("doc_id")).alias("got_docs"))
    owners = want.select("query", F.explode("want").alias("chunk_id")).join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query").agg(F.array_sort(F.collect_set("doc_id")).alias("want_docs"))  # as many as a pair expects
    rows = want.join(listed(found, "got"), "query", "left").join(listed(again, "again"), "query", "left").join(parents, "query", "left").join(owners, "query", "left")
    none = F.array().cast("array<string>")
    return rows.select("query", "want", *(F.coalesce(c, none).alias(c) for c in ("got", "again", "got_docs", "want_docs")))


def pair_search_audit(spark, d):
    """Per question: the place of the first expected chunk, hit and recall against what five results can hold, and the verdict:
    an expected chunk, another one of its document, or neither among the first results."""
    r = _pair_search(spark, d)
    first = F.slice("got", 1, K)
    recall = F.when(F.size("want") > 0, F.size(F.array_intersect(first, F.col("want"))) / F.least(F.size("want"), F.lit(K)))
    hit = F.arrays_overlap(first, F.col("want"))
    place = F.array_min(F.filter(F.transform("want", lambda w: F.array_position("got", w)), lambda p: p > 0))
    verdict = F.when(F.size("want") == 0, "unlabelled").when(hit, "chunk hit").when(F.arrays_overlap("got_docs", "want_docs"), "chunk drift").otherwise("miss")
    return r.select("query", place.alias("first_place"), hit.cast("int").alias("hit"), F.round(recall, 6).alias("recall"), verdict.alias("verdict"))


def stage_audit(spark, d):
    """Over all labelled questions: hits among the candidates, among the first, and among the reranked, and what reranking keeps, gains and loses."""
    r = _pair_search(spark, d).where(F.size("want") > 0)
    wide, narrow, again = F.arrays_overlap("got", "want"), F.arrays_overlap(F.slice("got", 1, K), F.col("want")), F.arrays_overlap("again", "want")
    return r.agg(F.count("*").alias("queries"), F.count_if(wide).alias("hit_candidates"), F.count_if(narrow).alias("hit_first"), F.count_if(again).alias("hit_reranked"), F.count_if(narrow & again).alias("kept"), F.count_if(~narrow & again).alias("gained"), F.count_if(narrow & ~again).alias("lost"))


def failure_audit(spark, d):
    """Labelled questions without an expected chunk among the first results, with what came instead."""
    r = _pair_search(spark, d).where((F.size("want") > 0) & ~F.arrays_overlap(F.slice("got", 1, K), F.col("want")))
    return r.select("query", F.array_join(F.slice("got", 1, 3), ",").alias("instead"), F.size("want").alias("expected"))


def rerank_lexical(spark, d):
    asking, docs = _asking(spark, d), _docs(spark, d)
    candidates = R.bm25_top_k(asking, docs, "doc_id", "text", 20)
    return R.reranked(candidates, asking, docs, "doc_id", "text", K).select("query", "doc", "rank", F.round("score", 4).alias("score"))


def _totals(spark, d):
    """(query, label, total): each query's label and how many other rows of the table have it, whether found or not."""
    v = _vectors(spark, d)
    sizes = v.groupBy("label").agg(F.count("*").alias("rows"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label").join(sizes, "label", "left")
    return asked.select("query", "label", F.coalesce(F.col("rows") - 1, F.lit(0)).alias("total"))  # no label: nothing is wanted


def _judged(spark, d, ranked, *by):
    """Per query (and ``by``) the ids found in order, those of them that are wanted, and the number wanted.

    Rows of the query's label count as relevant, except the query itself. Each result is told by its own label.
    """
    labels = _vectors(spark, d).select(F.col("vec_id").alias("doc"), F.col("label").alias("doc_label"))
    hits = ranked.select(*by, "query", "rank", "doc").join(labels, "doc").join(_totals(spark, d), "query")
    wanted = (F.col("doc_label") == F.col("label")) & (F.col("doc") != F.col("query"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "doc", F.coalesce(wanted, F.lit(False)).alias("wanted"))))
    lists = hits.groupBy(*by, "query", "total").agg(in_order.alias("hits"))
    doc = lambda x: x["doc"]
    return lists.select(*by, "query", F.transform("hits", doc).alias("got"), F.transform(F.filter("hits", lambda x: x["wanted"]), doc).alias("want"), "total")


def _lists(spark, d, k=10):
    return _judged(spark, d, _dense(spark, d, k))


def retrieval_metrics(spark, d):
    m = metrics.measured(_lists(spark, d), K)
    return m.select("query", "hit", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


def retrieval_summary(spark, d):
    """The same measures at several cutoffs, averaged."""
    lists = _lists(spark, d)
    parts = [metrics.summary(metrics.measured(lists, k)).withColumn("k", F.lit(k)) for k in (1, 3, 5, 10)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_TOKENS = """list_distinct(list_concat(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_+\\-]+'), lambda t: NOT regexp_full_match(t, '[0-9]+') AND (length(t) >= 2 OR regexp_full_match(t, '[a-z]'))),
 regexp_extract_all(lower({0}), '[一-鿿]{{2}}'), regexp_extract_all(lower({0}), '[一-鿿]([一-鿿]{{2}})', 1)))"""


def _bm25(name: str, docs: str, queries: str) -> str:
    """CTEs that give {name}_scored (query, doc, score) of ``docs`` (doc, text) for ``queries`` (query, text)."""
    return f"""{name}_ts AS (SELECT doc, {_TOKENS.format("coalesce(text, '')")} AS ts FROM ({docs})),
{name}_post AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM {name}_ts), {name}_n AS (SELECT count(*)::DOUBLE AS n, sum(len(ts)) / count(*) AS avgdl FROM {name}_ts),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term), {name}_raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {name}_df, {name}_n),
{name}_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw),
{name}_asked AS (SELECT query, unnest(ts) AS term FROM (SELECT query, {_TOKENS.format('text')} AS ts FROM ({queries}))),
{name}_scored AS (SELECT query, doc, sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_asked JOIN {name}_idf USING (term) JOIN {name}_post USING (term), {name}_n GROUP BY 1, 2)
"""


_DOCS, _TITLES = "SELECT doc_id AS doc, text FROM documents", "SELECT doc_id AS query, title AS text FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL"
_BM25 = "WITH " + _bm25("b", _DOCS, _TITLES)
_DENSE_OF = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_inner_product(e, e)) + 1e-9 AS m FROM v),
s AS (SELECT q.vec_id AS query, x.vec_id AS doc, list_inner_product(q.e, x.e) / q.m / x.m AS score FROM n q, n x WHERE q.vec_id % 100 = 0)
"""
_DENSE = "WITH " + _DENSE_OF + ", dense AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s QUALIFY rank <= 10)\n"
_LISTS = _DENSE + """, got AS (SELECT query, list(doc ORDER BY rank) AS got FROM dense GROUP BY 1),
sizes AS (SELECT label, count(*) AS rows FROM v GROUP BY 1),
want AS (SELECT q.vec_id AS query, coalesce(any_value(z.rows) - 1, 0) AS total, coalesce(list(DISTINCT d.doc) FILTER (WHERE x.label = q.label AND d.doc <> q.vec_id), []) AS want FROM v q LEFT JOIN sizes z ON z.label = q.label LEFT JOIN dense d ON d.query = q.vec_id LEFT JOIN v x ON x.vec_id = d.doc WHERE q.vec_id % 100 = 0 GROUP BY 1),
l AS (SELECT query, got, want, total FROM got JOIN want USING (query)),
pos AS (SELECT query, got, want, total, list_filter(list_transform(got, lambda x, i: CASE WHEN list_contains(want, x) THEN i END), lambda p: p IS NOT NULL) AS places FROM l)
"""
_BOTH = "WITH " + _DENSE_OF + ", " + _bm25("b", _DOCS, _TITLES) + f""", dense AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s QUALIFY rank <= {CANDIDATES}),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM b_scored QUALIFY rank <= {CANDIDATES}),
fo AS (SELECT query, doc, d.rank AS rd, l.rank AS rs FROM dense d FULL JOIN sparse l USING (query, doc)),
f AS (SELECT *, coalesce(0.6 / rd, 0)::DOUBLE + coalesce(0.4 / rs, 0)::DOUBLE AS score FROM fo),
hybrid AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, rd NULLS LAST, rs NULLS LAST) AS rank FROM f)
"""
_CHUNKS = f"SELECT DISTINCT ON ({key_sql('id')}) {key_sql('id')} AS doc, doc_id, content AS text, metadata_json FROM document_chunks WHERE content IS NOT NULL AND {key_sql('id')} IS NOT NULL"
_PAIRS = f"""WITH c AS MATERIALIZED ({_CHUNKS}), p AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT ON ({key_sql('id')}) {key_sql('id')} AS query, question AS text, expected_chunk_ids FROM eval_qa_pairs WHERE question IS NOT NULL AND {key_sql('id')} IS NOT NULL) WHERE ('0x' || query[1:8])::BIGINT % 100 = 0),
{_bm25('b', 'SELECT doc, text FROM c', 'SELECT query, text FROM p')}, found AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM b_scored QUALIFY rank <= {CANDIDATES}),
a AS (SELECT query, list(term) AS asked FROM b_asked GROUP BY 1),
again AS (SELECT f.query, f.doc, row_number() OVER (PARTITION BY f.query ORDER BY len(list_intersect(asked, ts))::DOUBLE / greatest(len(asked), 1) DESC, f.rank) AS rank FROM found f JOIN a USING (query) JOIN b_ts t ON t.doc = f.doc QUALIFY rank <= {K}),
e AS (SELECT DISTINCT query, {key_sql('raw')} AS doc FROM (SELECT query, unnest(expected_chunk_ids) AS raw FROM p) WHERE {key_sql('raw')} IS NOT NULL),
r AS (SELECT p.query, coalesce((SELECT count(*) FROM e WHERE e.query = p.query), 0) AS n, (SELECT min(f.rank) FROM found f JOIN e USING (query, doc) WHERE f.query = p.query) AS place, (SELECT count(*) FROM found f JOIN e USING (query, doc) WHERE f.query = p.query AND f.rank <= {K}) AS got,
  (SELECT count(*) FROM again g JOIN e USING (query, doc) WHERE g.query = p.query) AS got_again,
  (SELECT count(*) FROM found f JOIN c ON c.doc = f.doc JOIN (SELECT e.query, c.doc_id FROM e JOIN c USING (doc)) w ON w.query = f.query AND w.doc_id = c.doc_id WHERE f.query = p.query AND f.rank <= {K}) AS near FROM p)
"""


def _measures(k: int) -> str:
    return f"""SELECT query, (len(list_filter(places, lambda p: p <= {k})) > 0)::INT AS hit, coalesce(1.0::DOUBLE / list_min(places), 0) AS mrr,
    CASE WHEN total > 0 THEN coalesce(list_sum(list_transform(list_filter(places, lambda p: p <= {k}), lambda p: 1 / log2(p + 1))), 0) / list_sum(list_transform(range(1, least(total, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg,
    CASE WHEN total > 0 THEN len(list_filter(places, lambda p: p <= {k}))::DOUBLE / total END AS recall FROM pos"""


QUERIES = {
    "bm25_index_stats": (bm25_index_stats, _BM25 + "SELECT term, df, round(idf, 6) AS idf FROM b_idf"),
    "bm25_topk": (
        bm25_topk,
        _BM25
        + f""", k AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM b_scored QUALIFY rank <= {K}),
        q AS (SELECT DISTINCT query FROM ({_TITLES})), first AS (SELECT doc_id AS doc FROM documents ORDER BY doc_id LIMIT {2 * K}),
        more AS (SELECT q.query, first.doc, (SELECT count(*) FROM k WHERE k.query = q.query) + row_number() OVER (PARTITION BY q.query ORDER BY first.doc) AS rank FROM q, first WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query = q.query AND k.doc = first.doc))
        SELECT query, doc, rank, round(score, 4) AS score FROM k UNION ALL SELECT query, doc, rank, 0.0 FROM more WHERE rank <= {K}""",
    ),
    "dense_topk": (dense_topk, _DENSE + "SELECT query, doc, rank, round(score, 4) AS score FROM dense"),
    "hybrid_fusion": (hybrid_fusion, _BOTH + "SELECT query, doc, rank, round(score, 6) AS score FROM hybrid WHERE rank <= 10"),
    "search_strategies": (
        search_strategies,
        _BOTH + " UNION ALL ".join(f"SELECT '{n}' AS strategy, query, doc, rank, round(score, 6) AS score FROM {n} WHERE rank <= {K}" for n in ("dense", "sparse", "hybrid")),
    ),
    "multi_query": (
        multi_query,
        "WITH " + _bm25("b", _DOCS, "SELECT doc_id * 2 AS query, title AS text FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL UNION ALL SELECT doc_id * 2 + 1, text[1:80] FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL")
        + f", m AS (SELECT query // 2 AS query, doc, max(score) AS score FROM b_scored GROUP BY 1, 2) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank, round(score, 4) AS score FROM m QUALIFY rank <= {K}",
    ),
    "filtered_search": (
        filtered_search,
        f"WITH c AS MATERIALIZED ({_CHUNKS}), " + _bm25("b", "SELECT doc, text FROM c WHERE json_extract_string(metadata_json, '$.language') = 'fr' AND json_extract_string(metadata_json, '$.file_extension') = '.md'", _TITLES)
        + f"SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank, round(score, 4) AS score FROM b_scored QUALIFY rank <= {K}",
    ),
    "ablation_grid": (
        ablation_grid,
        _BOTH
        + f""", g AS (SELECT query, doc, alpha, row_number() OVER (PARTITION BY alpha, query ORDER BY round(coalesce(alpha / rd, 0) + coalesce((1 - alpha) / rs, 0), 9) DESC, rd NULLS LAST, rs NULLS LAST) AS rank FROM fo, (SELECT unnest([0.0, 0.3, 0.6, 1.0])::DOUBLE AS alpha) QUALIFY rank <= 10),
        j AS (SELECT g.*, coalesce(x.label = q.label AND x.vec_id <> q.vec_id, false) AS wanted, coalesce((SELECT count(*) FROM v o WHERE o.label = q.label) - 1, 0) AS total FROM g JOIN v q ON q.vec_id = g.query JOIN v x ON x.vec_id = g.doc),
        o AS (SELECT *, row_number() OVER (PARTITION BY alpha, query ORDER BY rank, doc) AS place FROM j),
        m AS (SELECT alpha, query, max((wanted AND place <= {K})::INT) AS hit, coalesce(1.0::DOUBLE / min(place) FILTER (WHERE wanted), 0) AS mrr,
          CASE WHEN any_value(total) > 0 THEN coalesce(sum(1 / log2(place + 1)) FILTER (WHERE wanted AND place <= {K}), 0) / list_sum(list_transform(range(1, least(any_value(total), {K}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM o GROUP BY 1, 2)
        SELECT alpha, count(*) AS queries, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM m GROUP BY 1""",
    ),
    "pair_search_audit": (
        pair_search_audit,
        _PAIRS
        + f"""SELECT query, place AS first_place, CASE WHEN n > 0 THEN (got > 0)::INT ELSE 0 END AS hit, CASE WHEN n > 0 THEN round(got / least(n, {K}), 6) END AS recall,
        CASE WHEN n = 0 THEN 'unlabelled' WHEN got > 0 THEN 'chunk hit' WHEN near > 0 THEN 'chunk drift' ELSE 'miss' END AS verdict FROM r""",
    ),
    "stage_audit": (
        stage_audit,
        _PAIRS
        + "SELECT count(*) AS queries, count(*) FILTER (WHERE place IS NOT NULL) AS hit_candidates, count(*) FILTER (WHERE got > 0) AS hit_first, count(*) FILTER (WHERE got_again > 0) AS hit_reranked, count(*) FILTER (WHERE got > 0 AND got_again > 0) AS kept, count(*) FILTER (WHERE got = 0 AND got_again > 0) AS gained, count(*) FILTER (WHERE got > 0 AND got_again = 0) AS lost FROM r WHERE n > 0",
    ),
    "failure_audit": (
        failure_audit,
        _PAIRS + f"SELECT query, coalesce((SELECT string_agg(doc, ',' ORDER BY rank) FROM found WHERE found.query = r.query AND rank <= 3), '') AS instead, n::INT AS expected FROM r WHERE n > 0 AND got = 0",
    ),
    "rerank_lexical": (
        rerank_lexical,
        _BM25
        + f""", c AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS before FROM b_scored QUALIFY before <= 20),
        a AS (SELECT query, list(term) AS asked FROM b_asked GROUP BY 1),
        r AS (SELECT query, doc, before, len(list_intersect(asked, ts))::DOUBLE / greatest(len(asked), 1) AS score FROM c JOIN a USING (query) JOIN b_ts USING (doc))
        SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, before) AS rank, round(score, 4) AS score FROM r QUALIFY rank <= {K}""",
    ),
    "retrieval_metrics": (retrieval_metrics, _LISTS + f"SELECT query, hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM ({_measures(K)})"),
    "retrieval_summary": (
        retrieval_summary,
        _LISTS
        + " UNION ALL ".join(
            f"SELECT count(*) AS queries, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, round(stddev_pop(mrr), 4) AS mrr_deviation, {k} AS k FROM ({_measures(k)})"
            for k in (1, 3, 5, 10)
        ),
    ),
}
