import datetime as dt

import pytest

from lorecast.operators.references import orphan_references, orphan_report, pair_orphans
from lorecast.operators.skew import hot_keys, salted_join

KEYS = ["a", "b"]


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([("x", "1", 0), ("x", "2", 0), ("y", None, 0), ("x", "1", 9)], "a string, b string, note int")


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(1, "x", "1"), (2, "x", "3"), (3, "x", None), (4, "z", None), (5, None, "2"), (6, None, "9"), (7, None, None), (8, "y", "1"), (2, "x", "3"), (9, "y", None)]
    return spark.createDataFrame(rows, "note int, a string, b string")


@pytest.mark.parametrize("hot_rows", [1, 500_000])
@pytest.mark.parametrize(("match", "want"), [("simple", [2, 2, 8]), ("partial", [2, 2, 4, 6, 8]), ("full", [2, 2, 3, 4, 5, 6, 8, 9])])
def test_match_semantics(refs, parents, match, want, hot_rows):
    got = orphan_references(refs, parents, KEYS, match, hot_rows)
    assert got.columns == refs.columns
    assert sorted(r.note for r in got.collect()) == want


@pytest.mark.parametrize("hot_rows", [1, 500_000])
def test_records_that_come_later(spark, hot_rows):
    refs = spark.createDataFrame([(1, "x", "1", 5), (2, "x", "2", 5), (3, "x", None, 5), (4, "z", "1", 5), (5, "x", "2", None), (6, "x", "3", 5)], "n int, a string, b string, at int")
    records = spark.createDataFrame([("x", "1", 5), ("x", "2", 9), ("x", "2", 7), ("x", "3", None)], "a string, b string, since int")
    for match, want in (("simple", {(2, True), (4, False)}), ("partial", {(2, True), (4, False)}), ("full", {(2, True), (3, False), (4, False)})):
        got = orphan_references(refs, records, KEYS, match, hot_rows, ("at", "since"))
        assert {(r.n, r.late) for r in got.collect()} == want, match
    late = orphan_references(refs, records.where("b = '2'"), KEYS, "partial", hot_rows, ("at", "since")).where("n = 3")
    assert [r.late for r in late.collect()] == [True]


def test_empty_tables_and_bad_match(refs, parents):
    assert orphan_references(refs.limit(0), parents, KEYS).count() == 0
    assert sorted(r.note for r in orphan_references(refs, parents.limit(0), KEYS).collect()) == [1, 2, 2, 8]
    with pytest.raises(ValueError):
        orphan_references(refs, parents, KEYS, "loose")


def _tables(spark):
    t = lambda day: dt.datetime(2024, 3, day)
    pairs = spark.createDataFrame(
        [
            ("Q1", " D1 ", ["c1", "C1 ", None, "", "gone", "never"], t(5), "x"),
            ("q1", " D1 ", ["c1", "C1 ", None, "", "gone", "never"], t(5), "x"),
            ("q2", None, None, t(5), "x"),
            ("q3", "d2", ["c2", "back"], t(5), "x"),
            ("q4", "d9", ["c2"], None, "x"),
            ("q5", "​  ", [], t(1), "x"),
        ],
        "id string, dataset_id string, expected_chunk_ids array<string>, created_at timestamp, record_at string",
    )
    datasets = spark.createDataFrame([("D1", t(1)), ("d2", t(9)), ("d2", t(9))], "id string, created_at timestamp")
    chunks = spark.createDataFrame([("c1", None), ("c2", t(6)), ("back", t(2))], "id string, created_at timestamp")
    logs = spark.createDataFrame([("GONE", " Delete"), ("back", "bulk_delete"), ("never", "update"), (None, None)], "resource_id string, action string")
    return pairs, datasets, chunks, logs


@pytest.mark.parametrize("hot_rows", [1, 500_000])
def test_pair_orphans(spark, hot_rows):
    got = pair_orphans(*_tables(spark), hot_rows)
    assert {(r.qa_id, r.ref_field, r.ref_id, r.orphan_kind) for r in got.collect()} == {
        ("q1", "expected_chunk_ids", "gone", "deleted"),
        ("q1", "expected_chunk_ids", "never", "missing"),
        ("q3", "dataset_id", "d2", "late"),
        ("q3", "expected_chunk_ids", "c2", "late"),
        ("q4", "dataset_id", "d9", "missing"),
    }
    assert got.count() == 5
    report = {(r.ref_table, r.month, r.orphan_kind): (r.orphans, r.pairs) for r in orphan_report(got).collect()}
    assert report[("eval_datasets", None, "missing")] == (1, 1) and report[("document_chunks", "2024-03", "late")] == (1, 1)


def test_salted_join_equals_plain(spark):
    left = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as k")
    right = spark.createDataFrame([("hot", 1), ("5", 2), ("hot", 3)], "k string, v int")
    hot, n = hot_keys(left, ["k"], 100)
    assert n == 1 and [r.salts for r in hot.collect()] == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = salted_join(left, right, ["k"], how, left["id"], 100), left.join(right, "k", how)
        assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "full", left["id"])


def test_every_hot_key_is_salted(spark):
    """600 hot keys, more rows for some: each gets as many salts as it needs, and none is left whole."""
    left = spark.range(600 * 20).selectExpr("id", "cast(id % 600 as string) as k").unionByName(spark.range(500).selectExpr("id + 20000 as id", "'7' as k"))
    hot, n = hot_keys(left, ["k"], 20)
    assert n == 600 and sorted(r.salts for r in hot.collect())[-2:] == [1, 26]
    few, m = hot_keys(left, ["k"], 20, most=10)
    assert m == 1 and few.first().salts > 1
    right = left.select("k").distinct()
    assert salted_join(left, right, ["k"], "left_semi", left["id"], 20).count() == 600 * 20 + 500
    assert salted_join(left, right, ["k"], "left_anti", left["id"], 20).count() == 0


def test_written_tables_are_released(spark):
    from lorecast.session import release_shared, shared_dir, write_shared

    release_shared(spark)
    made = write_shared(spark.range(3), "t")
    path = made.inputFiles()[0]
    assert path.startswith(shared_dir(spark)) or shared_dir(spark).replace("file://", "") in path
    assert release_shared(spark) == 1 and release_shared(spark) == 0
