import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorecast.llm.canonical import canonical, canonicalizer, look_alike_classes, look_alike_pairs

CANON = canonicalizer()
SIGNS = "aeoú̧̈é ü​­ﬁａеοⅰ 　一⼀가각\n½²①№ёक़ཱི"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(SIGNS), max_size=30) | st.text(max_size=30))
def test_segments_give_what_the_whole_text_gives(text):
    whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(CANON.table))
    assert CANON.look(text) == whole
    assert CANON(CANON(text)) == CANON(text) == CANON(whole)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("аaеepрпптоoοσvνлl ё̈"), max_size=12), st.text(alphabet=st.sampled_from("аaеepрпптоoοσvνлl ё̈"), max_size=12))
def test_equal_forms_are_equal_looks(a, b):
    assert (CANON(a) == CANON(b)) == (CANON.look(a) == CANON.look(b))


@pytest.mark.parametrize(("text", "form"), [("привет мир", "привет мир"), ("пpивeт миp", "привет мир"), ("ёлка", "ёлка"), ("λόγοs", "λόγοs"), ("λόγoν", "λόγον"), ("раусе", "payce"), ("Ѕсоре о", "Scope o")])
def test_words_of_one_script_keep_its_letters(text, form):
    assert CANON(text) == unicodedata.normalize("NFC", form)


@pytest.mark.parametrize(("a", "b"), [("ｆｕｌｌ", "full"), ("é", "é"), ("a b", "a b"), ("a​b", "ab"), ("oﬃce", "office"), ("раusе", "pause"), ("⼀", "一"), ("ⅿ", "m"), ("о̂", "ô"), ("e​́", "é"), ("，", ",")])
def test_looks_the_same(a, b):
    assert CANON(a) == CANON(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("a b", "a\nb"), ("n²", "n2"), ("①", "1"), ("№", "No"), ("½", "1/2"), ("σ", "o"), ("γ", "y"), ("ı", "i"), ("™", "TM"), ("a b", "ab")])
def test_looks_different(a, b):
    assert CANON(a) != CANON(b)


def _rows(spark):
    long = "x y " * 40_000
    rows = [
        ("A1", "full", 1), ("a2 ", "ｆull", 2), ("a2 ", "ｆull", 2), ("a3", "full", 3), ("a4", "ful​l", 4), ("b1", "Full", 5), ("c1", None, 6),
        (None, "full", 7), ("d1", "", 8), ("d2", "​", 9), ("e1", long, 10), ("e2", long.replace(" ", " "), 11),
    ]
    return spark.createDataFrame(rows, "id string, content string, form int")


@pytest.mark.parametrize("hot_rows", [1, 500_000])
def test_pairs_and_classes(spark, hot_rows):
    pairs = {(r.id_1, r.id_2) for r in look_alike_pairs(_rows(spark), "id", "content", hot_rows).collect()}
    assert pairs == {("a1", "a2"), ("a1", "a4"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4"), ("d1", "d2"), ("e1", "e2")}
    rows = look_alike_classes(_rows(spark), "id", "content", hot_rows).collect()
    assert len(rows) == 8
    got = {r.id: (r.class_id, r.texts, r.links) for r in rows}
    assert got["a1"] == ("a1", 3, 2) and got["a2"] == ("a1", 3, 3) and got["e2"] == ("e1", 2, 1)
    for i, (_, _, links) in got.items():
        assert links == sum(i in p for p in pairs)


def test_empty_and_null(spark):
    df = _rows(spark)
    assert look_alike_pairs(df.limit(0), "id", "content").count() == 0
    got = {r.form: r.c for r in df.select("form", canonical(F.col("content")).alias("c")).collect()}
    assert got[6] is None and got[8] == "" and got[9] == "" and got[2] == "full" and got[10] == got[11]
