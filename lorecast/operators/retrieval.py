"""Retrieval over tables: tokens, BM25, dense top-k in blocks, fusion, merging and reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.operators.skew import salted_join
from lorecast.session import write_shared

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of one block of vectors; a pair of blocks is one task's unit of work.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096
#: So many query vectors are broadcast (some 20 MB of 128 numbers each).
BROADCAST_QUERIES = 20_000
#: So many pairs of query and term are broadcast (some 50 MB).
BROADCAST_TERMS = 2_000_000
#: Documents that a task scores at once, pairs of query and document it then looks at, and cells of the table of its documents' terms:
#: its memory follows these and not how many queries ask for a term.
BLOCK_DOCS, BLOCK_PAIRS, BLOCK_CELLS = 512, 1 << 18, 1 << 24
#: Scores this near count as equal where documents are left out.
SLACK = 1e-8


def tokens(text: Column) -> Column:
    """Distinct tokens in order: Latin words and code names of the lower-cased text without pure numbers, and pairs of Han signs."""
    named = lambda t: ~t.rlike("^[0-9]+$") & ((F.length(t) >= 2) | t.rlike("^[a-z]$"))
    words = lambda low: F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9_+\-]+)"), F.lit(1)), named)
    even = lambda low: F.regexp_extract_all(low, F.lit("([一-鿿]{2})"), F.lit(1))
    odd = lambda low: F.regexp_extract_all(low, F.lit("(?:[一-鿿])([一-鿿]{2})"), F.lit(1))
    found = lambda low: F.array_distinct(F.when(low.rlike("[一-鿿]"), F.concat(words(low), even(low), odd(low))).otherwise(words(low)))
    return F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))  # lower-cased once


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, dl, term): a row per document and distinct token, ``dl`` the document's number of tokens."""
    rows = docs.select(F.col(id_col).alias("doc"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ts")).withColumn("dl", F.size("ts"))
    return rows.select("doc", "dl", F.explode("ts").alias("term"))


def term_statistics(index: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf): log((N - df + 0.5) / (df + 0.5)); terms below 0 get a quarter of the mean over all terms."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, doc, score) of all documents that share a token with a query; ``queries`` has (query, text).

    Postings of frequent terms are spread over many tasks.
    """
    index = write_shared(postings(docs, id_col, text_col), "postings")  # the index is read three times
    n = docs.count()
    length = index.count() / max(1, n)
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term"))
    weighted = asked.join(term_statistics(index, n), "term").select("query", "term", "idf")
    weight = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.lit(float(length or 1))))
    return salted_join(index, weighted, ["term"], "inner", F.col("doc")).groupBy("query", "doc").agg(F.sum(weight).alias("score"))


class _Asked:
    """Queries as rows of (query, term), the heaviest terms of each query first, as arrays that batches are looked up in."""

    def __init__(self, rows: pa.Table, n_queries: int):
        query, idf = (rows[c].to_numpy() for c in ("q", "idf"))
        order = np.lexsort((-idf, query))
        terms = rows["term"].combine_chunks()
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        self.terms = pc.unique(terms)
        self.codes = pc.index_in(terms, value_set=self.terms).to_numpy(zero_copy_only=False)[order]
        self.queries, self.idf = query[order], idf[order]
        self.n = n_queries
        counts = np.bincount(self.queries, minlength=n_queries)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        upto = np.cumsum(np.append(0, np.maximum(self.idf, 0)))
        most = upto[self.ends][self.queries] + np.spacing(upto[-1]) * counts[self.queries]  # never less for rounding
        #: The most that a row and those after it in its query can add, which never rises, and those after it alone.
        self.rest, self.after = most - upto[:-1], most - upto[1:]


def _first_of_each(query: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of each query, ties by name."""
    order = np.argsort(name, kind="stable")
    order = order[np.argsort(-np.round(score[order], 9), kind="stable")]
    order = order[np.argsort(query[order], kind="stable")]
    sorted_q = query[order]
    begins = np.flatnonzero(np.append(True, sorted_q[1:] != sorted_q[:-1])) if len(order) else np.array([], int)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


class _Held:
    """The ``k`` best documents of each query so far. ``least`` is what a further one must reach, -inf while there are fewer."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.full(n_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept = self.new = 0

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if not len(query):
            return
        self.parts.append((query, score, name))
        self.new += len(query)
        if self.new > max(self.kept, self.k * len(self.least)) / 2:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        query, score, name = (np.concatenate(x) for x in zip(*self.parts))
        keep = _first_of_each(query, score, name, self.k)
        query, score, name = query[keep], score[keep], name[keep]
        self.parts, self.kept, self.new = [(query, score, name)], len(query), 0
        full = np.bincount(query, minlength=len(self.least)) == self.k
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True))
        last = last[full[query[last]]]
        self.least[query[last]] = score[last] - SLACK  # ties at nine digits still come in


def _match_block(a: _Asked, held: _Held, codes: np.ndarray, of: np.ndarray, weight: np.ndarray, names: np.ndarray) -> None:
    """Scores a few documents against all queries. ``codes`` and ``of``: a row per posting with the number of its term and document.

    A query looks only at documents that have one of its heavier terms: those whose absence leaves too little for a place among
    its best. The other terms are looked up for these alone, as long as what is left can still reach a place.
    """
    n = len(weight)
    sizes = np.bincount(codes, minlength=len(a.terms))
    there = np.flatnonzero(sizes)
    if n > 1 and n * len(there) > BLOCK_CELLS:
        for part, half in ((of < n // 2, slice(0, n // 2)), (of >= n // 2, slice(n // 2, n))):
            _match_block(a, held, codes[part], of[part] - half.start, weight[half], names[half])
        return
    row = np.full(len(a.terms), len(there))  # the last row: terms that no document here has
    row[there] = np.arange(len(there))
    has = np.zeros((len(there) + 1, n), bool)
    has[row[codes], of] = True
    docs = of[np.argsort(row[codes], kind="stable")]  # by term
    sizes = sizes[there]
    begins = np.cumsum(sizes) - sizes
    rows = row[a.codes]
    heavy = a.rest * weight.max(initial=0) >= held.least[a.queries]
    asked = np.bincount(a.queries[heavy], minlength=a.n)  # the first of each query, as what is left falls
    heavy = np.flatnonzero(heavy & (rows < len(there)))
    asking = np.unique(a.queries[heavy])
    step = max(1, BLOCK_PAIRS // n)
    for at in range(0, len(asking), step):
        own = asking[at : at + step]
        lo, hi = np.searchsorted(a.queries[heavy], [own[0], own[-1] + 1])
        e = heavy[lo:hi]
        base, times, first = np.searchsorted(own, a.queries[e]) * n, sizes[rows[e]], begins[rows[e]]
        met, total = np.zeros(len(own) * n, bool), np.zeros(len(own) * n)
        for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(np.cumsum(times) // BLOCK_PAIRS)) + 1):
            t = times[part]
            place = np.repeat(first[part] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            pair = np.repeat(base[part], t) + docs[place]
            met[pair] = True
            total += np.bincount(pair, np.repeat(a.idf[e[part]], t), len(total))
        pair = np.flatnonzero(met)
        query, doc = np.divmod(pair, n)
        query, total = own[query], total[pair]
        found = _look_up(a, held, has, rows, weight, query, doc, total, a.starts[query] + asked[query])
        query, doc, score = (np.concatenate(x) for x in zip(*found))
        if len(query) > held.k * len(own):
            keep = _first_of_each(query, score, names[doc], held.k)
            query, doc, score = query[keep], doc[keep], score[keep]
        held.add(query, score, names[doc])


def _look_up(a: _Asked, held: _Held, has: np.ndarray, rows: np.ndarray, weight: np.ndarray, query: np.ndarray, doc: np.ndarray, total: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, doc, score) of the pairs that reach the query's least score. ``total`` holds the terms before ``at``; the others come one by one."""
    need, ends = held.least[query] / weight[doc], a.ends[query]
    while True:
        on = total + a.after[at - 1] >= need
        query, doc, total, at, need, ends = (x[on] for x in (query, doc, total, at, need, ends))
        over = at == ends
        yield query[over], doc[over], total[over] * weight[doc[over]]
        if over.all():
            return
        if over.any():
            query, doc, total, at, need, ends = (x[~over] for x in (query, doc, total, at, need, ends))
        total += a.idf[at] * has[rows[at], doc]
        at += 1


def _match(asked, length: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: _Asked = asked.value
        held, kind = _Held(a.n, k), None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column(1)))  # blocks of documents of like length
            docs, dl, terms = batch.columns
            kind = docs.type
            ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            codes = pc.index_in(terms.flatten(), value_set=a.terms)
            weight = (K1 + 1) / (1 + K1 * (1 - B + B * dl.to_numpy(zero_copy_only=False) / length))
            names = docs.to_numpy(zero_copy_only=False)
            for at in range(0, len(docs), BLOCK_DOCS):
                to = min(at + BLOCK_DOCS, len(docs))
                begin = ends[at - 1] if at else 0
                own = codes.slice(begin, ends[to - 1] - begin)
                of = np.repeat(np.arange(to - at), np.diff(ends[at:to], prepend=begin))[pc.is_valid(own).to_numpy(zero_copy_only=False)]
                _match_block(a, held, own.drop_null().to_numpy(zero_copy_only=False), of, weight[at:to], names[at:to])
        held.settle()
        for query, score, name in held.parts:
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(name, kind), pa.array(score, pa.float64())], names=["q", "doc", "score"])

    return run


def bm25_top_k(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the ``k`` best documents of each query (query, text), ties by document.

    While all queries together ask for no more than ``BROADCAST_TERMS`` terms, which is counted first, these go to every task;
    documents are scored where they lie, a block at a time, and only k rows per query and task are shuffled. More are joined by
    term (``bm25_scores``). Queries that share no token with any document give no rows.
    """
    index = write_shared(docs.select(F.col(id_col).alias("doc"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ts")).withColumn("dl", F.size("ts")).select("doc", "dl", "ts"), "terms")
    total = index.agg(F.count("*").alias("n"), F.sum("dl").alias("terms")).first()
    asked = write_shared(queries.select("query", F.explode(tokens(F.col("text"))).alias("term")), "asked")
    if asked.count() > BROADCAST_TERMS:
        return top_k(bm25_scores(queries, docs, id_col, text_col), k)
    ids = asked.select("query").distinct().toArrow()["query"].combine_chunks()  # no more than there are terms
    numbered = queries.sparkSession.createDataFrame(pa.table({"query": ids, "q": pa.array(np.arange(len(ids)))})) if len(ids) else asked.select("query", F.lit(0).cast("bigint").alias("q"))
    stats = term_statistics(index.select("doc", F.explode("ts").alias("term")), total.n)
    weighted = asked.join(numbered, "query").join(stats, "term").select("term", "q", "idf").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(_Asked(weighted, max(1, len(ids))))
    length = (total.terms or 0) / max(1, total.n)
    kind = docs.schema[id_col].dataType.simpleString()
    found = index.mapInArrow(_match(shared, float(length or 1), k), f"q bigint, doc {kind}, score double")
    return top_k(found, k, "q").join(numbered, "q").select("query", "doc", "score", "rank")


def top_k(scores: DataFrame, k: int, by: str = "query", item: str = "doc") -> DataFrame:
    """``scores`` with rank 1 to ``k`` within each query, ties by item; Spark keeps k rows per task before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(df: DataFrame, id_col: str, vec_col: str, size: int, name: str) -> DataFrame:
    n = max(1, math.ceil(df.count() / size))
    block = F.pmod(F.xxhash64(id_col), F.lit(n))
    return df.select(block.alias(name), F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).alias("row")).groupBy(name).agg(F.collect_list("row").alias(f"{name}s"))  # about ``size`` rows


def _compare(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v in zip(batch.column("qs"), batch.column("vs")):
                qi, qm = _matrix(q)
                vi, vm = _matrix(v)
                sims = qm @ vm.T
                best = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]  # ids ascend in a block, so ties go to the least
                keep = best.shape[1]
                rows = np.repeat(np.arange(len(qi)), keep)
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(rows)), vi.take(pa.array(best.ravel())), pa.array(sims[rows, best.ravel()])], names=["query", "doc", "score"])

    return run


def _normal(ids: pa.Array, vecs: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids in order and their vectors at unit length, as the rows of a matrix."""
    order = pc.sort_indices(ids)
    ids, vecs = ids.take(order), vecs.take(order)
    m = np.asarray(vecs.flatten(), np.float64).reshape(len(ids), -1)
    return ids, m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def _matrix(rows: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
    return _normal(rows.values.field("id"), rows.values.field("v"))


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row, ties by name."""
    for key in (np.argsort(names, axis=1, kind="stable"), None):
        order = key if key is not None else np.argsort(-scores, axis=1, kind="stable")[:, :k]
        scores, names = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
    return scores, names


def _scan(queries, k: int):
    """The ``k`` nearest vectors of a partition for every query, kept as batches stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qm = queries.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = qi.type
        for batch in batches:
            if not batch.num_rows:
                continue
            vi, vm = _normal(batch.column(0), batch.column(1))
            names = vi.to_numpy(zero_copy_only=False)
            for at in range(0, len(qi), QUERY_BLOCK):
                sims = np.round(qm[at : at + QUERY_BLOCK] @ vm.T, 9)
                near = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the least
                found = np.take_along_axis(sims, near, 1), names[near]
                held[at] = _best(np.concatenate([held[at][0], found[0]], 1), np.concatenate([held[at][1], found[1]], 1), k) if at in held else found
        for at, (scores, names) in held.items():
            rows = np.repeat(np.arange(len(scores)), scores.shape[1]) + at
            yield pa.RecordBatch.from_arrays([qi.take(pa.array(rows)), pa.array(names.ravel(), kind), pa.array(scores.ravel())], names=["query", "doc", "score"])

    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the ``k`` nearest rows of ``vectors`` by cosine for each row of ``queries``, exactly.

    Up to ``BROADCAST_QUERIES`` queries, counted first, go to every task, which scans its vectors where they lie and leaves k
    rows per query. More are cut into blocks of fixed size like the vectors, and each pair of blocks is compared as matrices.
    """
    kind = queries.schema[id_col].dataType.simpleString()
    few = queries.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).limit(BROADCAST_QUERIES + 1)
    if few.count() <= BROADCAST_QUERIES:
        asked = few.toArrow().combine_chunks()
        if not asked.num_rows:
            return queries.select(F.col(id_col).alias("query"), F.col(id_col).alias("doc"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        batch = asked.to_batches()[0]
        shared = queries.sparkSession.sparkContext.broadcast(_normal(batch.column(0), batch.column(1)))
        return top_k(vectors.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(_scan(shared, k), f"query {kind}, doc {kind}, score double"), k)
    q = _blocks(queries, id_col, vec_col, QUERY_BLOCK, "q")
    v = _blocks(vectors, id_col, vec_col, VECTOR_BLOCK, "v")
    near = v.crossJoin(q).select("qs", "vs").mapInArrow(_compare(k), f"query {kind}, doc {kind}, score double")
    return top_k(near, k)


def fused(dense: DataFrame, sparse: DataFrame, alpha: float = 0.6, rrf_k: int = 0) -> DataFrame:
    """(query, doc, score, rank): weighted reciprocal ranks of two ranked lists; a list without a document gives 0 for it."""
    d = dense.select("query", "doc", F.col("rank").alias("rd"))
    s = sparse.select("query", "doc", F.col("rank").alias("rs"))
    both = d.join(s, ["query", "doc"], "full_outer")
    score = F.coalesce(alpha / (rrf_k + F.col("rd")), F.lit(0.0)) + F.coalesce((1 - alpha) / (rrf_k + F.col("rs")), F.lit(0.0))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("rd"), F.asc_nulls_last("rs"))
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order)).select("query", "doc", "score", "rank")


def filled(ranked: DataFrame, queries: DataFrame, docs: DataFrame, id_col: str, k: int) -> DataFrame:
    """``ranked`` (query, doc, score, rank) with each query of ``queries`` brought to ``k`` rows by the first documents in order of
    their ids, at score 0, as far as there are any that it lacks."""
    first = docs.select(F.col(id_col).alias("doc")).orderBy("doc").limit(2 * k).agg(F.array_sort(F.collect_list("doc")).alias("first"))  # one row of 2 k ids
    had = queries.select("query").distinct().join(ranked.groupBy("query").agg(F.collect_list("doc").alias("had")), "query", "left")  # at most k ids a query
    short = had.withColumn("had", F.coalesce("had", F.array().cast(ranked.select(F.array("doc").alias("a")).schema["a"].dataType))).where(F.size("had") < k)
    lacking = F.slice(F.array_except("first", "had"), 1, F.lit(k) - F.size("had"))
    more = short.crossJoin(F.broadcast(first)).select("query", F.posexplode(lacking).alias("at", "doc"), F.size("had").alias("n"))
    return ranked.select("query", "doc", "score", "rank").unionByName(more.select("query", "doc", F.lit(0.0).alias("score"), (F.col("n") + F.col("at") + 1).cast("int").alias("rank")))


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Results of several sub-queries (query, sub, doc, score): the best score of each document, then the first k."""
    best = lists.groupBy("query", "doc").agg(F.max("score").alias("score"))
    return top_k(best, k)


def reranked(candidates: DataFrame, queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Candidates (query, doc, rank) in the order of the share of the query's tokens that the document's text has, then of rank."""
    asked = queries.select("query", tokens(F.col("text")).alias("asked"))
    known = docs.join(candidates.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi").select(F.col(id_col).alias("doc"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("has"))
    both = candidates.select("query", "doc", F.col("rank").alias("before")).join(known, "doc").join(asked, "query")
    scored = both.withColumn("score", F.size(F.array_intersect("asked", "has")) / F.greatest(F.size("asked"), F.lit(1)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "before")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "doc", "score", "rank", "before")
