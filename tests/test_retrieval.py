import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorecast.operators import metrics as M
from lorecast.operators import retrieval as R


def test_fusion_of_two_lists(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query int, doc string, rank int")
    got = {r.doc: (round(r.score, 6), r.rank) for r in R.fused(rank([(1, "a", 1), (1, "b", 2)]), rank([(1, "b", 1), (1, "c", 2)])).collect()}
    assert got == {"b": (0.7, 1), "a": (0.6, 2), "c": (0.2, 3)}
    alone = R.fused(rank([(1, "a", 1), (1, "b", 2)]), rank([]))
    assert [(r.doc, r.rank) for r in alone.orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_merge_keeps_the_best_score(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "a", 0.9), (1, 2, "b", 0.7), (2, 1, "b", 0.1)], "query int, sub int, doc string, score double")
    assert [(r.query, r.doc, r.rank) for r in R.merged(rows, 1).orderBy("query").collect()] == [(1, "a", 1), (2, "b", 1)]


@pytest.mark.parametrize(("block", "few"), [(7, 0), (4096, 0), (7, 100)])
def test_dense_equals_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(R, "VECTOR_BLOCK", block)
    monkeypatch.setattr(R, "BROADCAST_QUERIES", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    v[10:30] = v[10]  # copies: ties go to the least id
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(n @ n.T, 9)
    want = {(q, int(x), r + 1) for q in range(0, 60, 10) for r, x in enumerate(np.argsort(-sims[q], kind="stable")[:6])}
    got = R.dense_top_k(df.where("id % 10 = 0"), df, "id", "v", 6).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.query, r.doc, r.rank) for r in got} == want
    named = df.selectExpr("concat('n', id) as id", "v")
    assert R.dense_top_k(named.where("id = 'n3'"), named, "id", "v", 2).where("rank = 1").first().doc == "n3"
    assert R.dense_top_k(df.limit(0), df, "id", "v", 2).count() == 0 and R.dense_top_k(df, df.limit(0), "id", "v", 2).count() == 0


def test_tokens(spark):
    row = spark.createDataFrame([("The C++ HashMap, 42 x 7z 多线程 hash_map the",)], "t string").select(R.tokens(F.col("t")).alias("ts")).first()
    assert row.ts == ["the", "c++", "hashmap", "x", "7z", "hash_map", "多线", "线程"]


def test_bm25_with_hot_terms_spread(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog dog"), (3, None), (4, "")], "id int, text string")
    queries = spark.createDataFrame([(9, "red fox"), (8, "")], "query int, text string")
    got = {(r.query, r.doc): r.score for r in R.bm25_scores(queries, docs, "id", "text").collect()}
    assert set(got) == {(9, 1), (9, 2)} and got[9, 1] > got[9, 2]


@pytest.mark.parametrize("most", [0, 10**6])
def test_bm25_top_k_equals_all_scores(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_TERMS", most)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(150)] + [(900, None)], "id bigint, text string").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, 4))) for i in range(12)] + [("none", "zzz"), ("blank", "")], "query string, text string")
    want = {(r.query, r.doc, r["rank"], round(r.score, 8)) for r in R.top_k(R.bm25_scores(queries, docs, "id", "text"), 5).collect()}
    assert {(r.query, r.doc, r["rank"], round(r.score, 8)) for r in R.bm25_top_k(queries, docs, "id", "text", 5).collect()} == want and len(want) == 60
    assert R.bm25_top_k(queries.limit(0), docs, "id", "text", 5).count() == 0 and R.bm25_top_k(queries, docs.limit(0), "id", "text", 5).count() == 0


def _matched(texts, idf, queries, k, batch=10**6):
    """What a task finds in ``texts`` (lists of terms) for ``queries`` (likewise): (query, doc, score)."""
    rows = [(t, q, idf[t]) for q, ts in enumerate(queries) for t in ts]
    asked = R._Asked(pa.table({"term": pa.array([r[0] for r in rows], pa.string()), "q": pa.array([r[1] for r in rows], pa.int64()), "idf": pa.array([r[2] for r in rows], pa.float64())}), len(queries))
    table = pa.table({"doc": pa.array(range(len(texts)), pa.int64()), "dl": pa.array([len(t) for t in texts], pa.int32()), "ts": pa.array(texts, pa.list_(pa.string()))})
    run = R._match(SimpleNamespace(value=asked), 6.0, k)
    return [r for b in run(iter(table.combine_chunks().to_batches(batch))) for r in zip(*(c.to_pylist() for c in b.columns))]


def test_memory_of_a_task_does_not_follow_who_asks_for_a_term():
    """4,000 queries ask 3,000 documents for a term that all have: twelve million pairs, of which each block sees a part."""
    texts = [["the", f"d{i}", *(["longer"] * (i % 2))] for i in range(3000)]
    tracemalloc.start()
    got = _matched(texts, {"the": 1.0, "longer": 0.1} | {f"d{i}": 5.0 for i in range(3000)}, [["the", f"d{i % 3000}"] for i in range(4000)], 2, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    best = {}
    for q, doc, score in got:
        best.setdefault(q, []).append((-round(score, 9), doc))
    assert all(sorted(best[q])[:2][0][1] == q % 3000 and sorted(best[q])[1][1] == (0 if q % 3000 else 2) for q in range(4000))


@pytest.mark.parametrize(("docs", "pairs", "cells", "batch"), [(512, 1 << 18, 1 << 24, 10**6), (7, 20, 1 << 24, 40), (16, 1, 50, 90), (3, 10**6, 1, 10**6)])
def test_blocks_leave_out_nothing(monkeypatch, docs, pairs, cells, batch):
    """Against brute force, with weights below zero and of zero, copies (ties), empty documents and queries that ask for a term nobody has."""
    for name, value in (("BLOCK_DOCS", docs), ("BLOCK_PAIRS", pairs), ("BLOCK_CELLS", cells)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(docs)
    words = [f"w{i}" for i in range(30)]
    share = np.linspace(0.02, 0.9, 30)
    idf = {w: round(float(np.log((1 - p + 0.01) / (p + 0.01))), 3) if p < 0.8 else [-0.5, 0.0][i % 2] for i, (w, p) in enumerate(zip(words, share))} | {"nobody": 3.0}
    texts = [[w for w, p in zip(words, share) if rng.random() < p] for _ in range(200)] + [[], []]
    texts += texts[:60]
    queries = [sorted(rng.choice(words, rng.integers(1, 8), replace=False)) + ["nobody"] * int(i % 3 == 0) for i in range(50)] + [["w29"], ["nobody"], []]
    want = set()
    for q, ts in enumerate(queries):
        found = []
        for i, text in enumerate(texts):
            if both := set(ts) & set(text):
                found.append((-round(sum(idf[t] for t in both) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(text) / 6)), 9), i))
        want |= {(q, i, -s) for s, i in sorted(found)[:4]}
    assert {(q, i, round(s, 9)) for q, i, s in _matched(texts, idf, queries, 4, batch)} == want and len(want) > 190


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["c", "x"]), (2, ["a"], []), (3, [], ["a"]), (4, ["a", "b"], ["a", "b"])], "query int, got array<string>, want array<string>")
    rows = {r.query: r for r in M.measured(df, 2).collect()}
    assert rows[1].hit == 0 and abs(rows[1].mrr - 1 / 3) < 1e-9 and rows[1].recall == 0 and rows[1].ndcg == 0
    assert rows[2].hit == 0 and rows[2].mrr == 0 and rows[2].recall is None
    assert rows[3].mrr == 0 and rows[3].recall == 0
    assert rows[4].hit == 1 and rows[4].mrr == 1 and abs(rows[4].ndcg - 1) < 1e-9 and rows[4].recall == 1
    s = M.summary(M.measured(df, 2)).first()
    assert s.queries == 4 and s.hit == 0.25
