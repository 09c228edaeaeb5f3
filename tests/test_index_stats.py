"""The term statistics hold every term, also those of one document."""

import math

from oracle import duck, rows_of

from lorecast.plans import retrieval


def test_terms_of_one_document_are_kept(spark, tmp_path):
    spark.createDataFrame([(1, "t", "red fox"), (2, "t", "red dog dog"), (3, "t", None), (4, "t", "")], "doc_id bigint, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.term: (r.df, r.idf) for r in retrieval.bm25_index_stats(spark, str(tmp_path)).collect()}
    rare = round(math.log(3.5) - math.log(1.5), 6)
    assert rows == {"fox": (1, rare), "dog": (1, rare), "red": (2, 0.0)}


def test_all_terms_of_the_documents(spark):
    columns, want = duck(retrieval.QUERIES["bm25_index_stats"][1])
    got = retrieval.bm25_index_stats(spark, "/root/testdata/sf0.01")
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want)
