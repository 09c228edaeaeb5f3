from lorecast.plans import relations


def test_vectors_without_chunk_are_told_from_those_of_another(spark, tmp_path):
    rows = [("a", "k", "b"), ("b", "k", " A "), ("c", "k", "gone"), ("c", "k", "gone"), ("d", "k", None), ("e", "m", "a"), ("f", None, "f"), ("g", None, "x")]
    spark.createDataFrame(rows, "id string, kb_id string, vector_id string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    got = {r.kb_id: (r.both, r.only_vector, r.only_chunk) for r in relations.orphan_vectors(spark, str(tmp_path)).collect()}
    assert got == {"k": (2, 1, 2), "m": (0, 1, 1), None: (1, 1, 1)}
