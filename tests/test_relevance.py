"""Relevance is taken from the whole table, not from what the search found."""

import math

import numpy as np
import pytest

from lorecast.plans import retrieval

N, LABELS = 301, {7: None, 100: None, 200: "lone"}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Few labels over random vectors: of each label far more rows than a list of ten can hold."""
    d = str(tmp_path_factory.mktemp("relevance"))
    v = np.random.default_rng(1).normal(size=(N, 6))
    label = [LABELS.get(i, f"l{i % 3}") for i in range(N)]
    spark.createDataFrame([(i, x.tolist(), lab) for i, (x, lab) in enumerate(zip(v, label))], "vec_id bigint, embedding array<double>, label string").write.parquet(f"{d}/embeddings.parquet")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    dense = {q: [int(x) for x in np.argsort(-np.round(n[q] @ n.T, 9), kind="stable")[:10]] for q in range(0, N, 100)}
    return d, label, dense


def _measures(label, q, got, k):
    want = {i for i in range(N) if label[q] is not None and label[i] == label[q] and i != q}
    places = [r for r, x in enumerate(got, 1) if x in want]
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(want), k) + 1))
    first = [p for p in places if p <= k]
    return (int(bool(first)), 1 / places[0] if places else 0, sum(1 / math.log2(p + 1) for p in first) / ideal if want else 0, len(first) / len(want) if want else None)


def test_recall_counts_what_the_search_missed(spark, planted):
    d, label, dense = planted
    rows = {r.query: r for r in retrieval.retrieval_metrics(spark, d).collect()}
    assert set(rows) == set(dense)
    for q, got in dense.items():
        hit, mrr, ndcg, recall = _measures(label, q, got, retrieval.K)
        assert rows[q].hit == hit and rows[q].mrr == pytest.approx(mrr, abs=1e-6) and rows[q].ndcg == pytest.approx(ndcg, abs=1e-6)
        assert rows[q].recall == (None if recall is None else pytest.approx(recall, abs=1e-6))
    assert rows[100].recall is None and rows[200].recall is None and rows[0].recall < 0.1
    ten = next(r for r in retrieval.retrieval_summary(spark, d).collect() if r.k == 10)
    assert ten.queries == 4 and ten.recall == pytest.approx(np.mean([_measures(label, q, dense[q], 10)[3] for q in (0, 300)]), abs=1e-4)
