import itertools
import random

import pytest

from lorecast.llm import mixing
from lorecast.llm.mixing import actual_shares, fill_budget, mixed


def test_small_budgets_are_filled_as_brute_force_fills_them():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 4)))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, 120)
        took = fill_budget(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(took, counts))
        best = max(s for ks in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(n * k for n, k in zip(lengths, ks))) <= budget)
        assert sum(n * k for n, k in zip(lengths, took)) == best


def test_large_budget_is_hit_exactly():
    rng = random.Random(5)
    lengths = list(range(20, 3000, 3))
    counts = [rng.randint(1, 400) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    for part in (0.1, 0.37, 0.9):
        took = fill_budget(lengths, counts, int(total * part))
        assert sum(n * k for n, k in zip(lengths, took)) == int(total * part)
        middle = sum(took[: len(took) // 2]) / max(1, sum(counts[: len(took) // 2]))
        assert abs(middle - part) < 0.05  # lengths stay in proportion


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, "big" if i % 3 else ("small" if i % 9 else "tiny"), rng.randint(1, 50)) for i in range(3000)]
    rows += [(9000 + i, "big", 7) for i in range(600)] + [(9990, None, 5), (9991, "small", 0), (9992, "small", None), (9993, "other", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


@pytest.fixture(scope="module")
def targets(spark):
    rows = [("m", "big", 0.5, 1), ("m", "small", 0.3, 2), ("m", "tiny", 0.1, 4), ("m", "absent", 0.1, 3), ("n", "tiny", 0.9, 2), ("n", "big", 0.1, 1), ("n", "big", 0.1, 1), ("o", "absent", 1.0, 1), ("o", "big", None, 1)]
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")


@pytest.mark.parametrize(("hot_rows", "rank_rows"), [(500_000, 10_000), (100, 50)])
def test_shares_and_repeats(docs, targets, monkeypatch, hot_rows, rank_rows):
    monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
    mix = mixed(docs, "doc_id", targets, hot_rows=hot_rows)
    rows = mix.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    limit = {("m", "big"): 1, ("m", "small"): 2, ("m", "tiny"): 4, ("n", "tiny"): 2, ("n", "big"): 1}
    assert all(0 < r.uses <= limit[r.mix_name, r.source] for r in rows)
    got = {(r.mix_name, r.source): r for r in actual_shares(mix, docs, targets).collect()}
    assert got["m", "absent"].used_tokens == 0 and got["o", "absent"].actual_share == 0
    assert abs(got["m", "big"].actual_share - 0.5 / 0.9) < 1e-3 and abs(got["m", "tiny"].actual_share - 0.1 / 0.9) < 1e-3
    assert abs(got["n", "tiny"].actual_share - 0.9) < 1e-3
    again = mixed(docs.repartition(5), "doc_id", targets, hot_rows=hot_rows)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_the_choice_does_not_depend_on_the_number_of_documents_of_a_length(docs, targets, monkeypatch):
    whole = sorted(map(tuple, mixed(docs, "doc_id", targets).collect()))
    monkeypatch.setattr(mixing, "RANK_ROWS", 5)
    assert sorted(map(tuple, mixed(docs, "doc_id", targets).collect())) == whole


def test_given_total_and_empty(docs, targets):
    mix = mixed(docs, "doc_id", targets, total_tokens=10**9)
    got = {(r.mix_name, r.source): r for r in actual_shares(mix, docs, targets).collect()}
    assert got["m", "tiny"].used_tokens == 4 * got["m", "tiny"].available_tokens and got["m", "tiny"].most_uses == 4
    assert mixed(docs.limit(0), "doc_id", targets).count() == 0 and mixed(docs, "doc_id", targets.limit(0)).count() == 0
