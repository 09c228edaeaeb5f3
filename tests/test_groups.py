"""Groups are streamed through, not gathered."""

import hashlib

from lorecast.plans import relations

ROWS = [("b", "d1", 1, "two é"), ("a", "d1", 0, "one"), ("a", "d1", 0, "one"), ("c", "d1", 1, "two é"), ("d", "d1", 2, None), ("e", None, 0, "x"), ("f", "", 0, ""), ("g", "", 1, "y")]


def test_document_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame(ROWS, "id string, doc_id string, chunk_index int, content string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    want = {"d1": (3, "one two é two é"), None: (1, "x"), "": (2, " y")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        df = relations.doc_text_from_chunks(spark, str(tmp_path))
        rows = {r.doc_id: (r.chunks, r.signs, r.hash) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == {k: (n, len(t), hashlib.sha256(t.encode()).hexdigest()) for k, (n, t) in want.items()}
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_no_chunks(spark, tmp_path):
    spark.createDataFrame([], "id string, doc_id string, chunk_index int, content string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    assert relations.doc_text_from_chunks(spark, str(tmp_path)).collect() == []


def test_tags_are_distinct_before_they_are_gathered(spark, tmp_path):
    pairs = [("1", "how", ["types", "loops"]), ("2", "how", ["loops", None]), ("3", None, ["z"]), ("4", "why", None), ("5", "why", []), ("1", "how", ["types", "loops"])]
    spark.createDataFrame(pairs, "id string, question_type string, tags array<string>").write.parquet(f"{tmp_path}/eval_qa_pairs.parquet")
    df = relations.tag_sets(spark, str(tmp_path))
    assert {r.question_type: (r.pairs, r.with_both, r.all_tags) for r in df.collect()} == {"how": (2, 1, "loops,types"), None: (1, 0, "z"), "why": (2, 0, "")}
    assert "collect_set" not in df._jdf.queryExecution().toString()
