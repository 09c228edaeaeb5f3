import pytest
from pyspark.sql import functions as F

from lorecast.functions import questions as Q
from lorecast.functions.keys import first_of, metadata_matches, without_key
from lorecast.operators.matching import containing


@pytest.mark.parametrize("hot_rows", [2, 500_000])
def test_containing_equals_brute_force(spark, hot_rows):
    texts = ["abcabc", "bca", "xy", "a", "", None, "列表与字典", "ab", "ABC", "zz abc zz", "abc"]
    needles = ["abc", "bc", "a", "", None, "列表", "zz abc", "q", "y", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted((r.id, r.needle) for r in containing(asked, "needle", df, "t", hot_rows).collect())
    assert got == sorted({(i, n) for i, t in enumerate(texts) for n in needles if t and n and n in t})
    assert containing(asked.limit(0), "needle", df, "t").count() == 0 and containing(asked, "needle", df.limit(0), "t").count() == 0


def test_metadata(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2"}', ["x"], None), ('{"a": "2"}', [], ["y"]), (None, None, None), ("no json", [], [])], "m string, p array<string>, q array<string>")
    assert [r.v for r in df.select(metadata_matches(F.col("m"), {"a": "1", "b": "2"}).alias("v")).collect()] == [True, False, False, False]
    assert df.select(without_key(F.col("m"), "a").alias("v")).first().v == '{"b":"2"}'
    assert [r.v for r in df.select(first_of(F.col("p"), F.col("q")).alias("v")).collect()] == [["x"], ["y"], [], []]


def test_entities_and_resolution(spark):
    history = [("user", "what is a List"), ("assistant", "a list, or a tuple; see 函数 here"), ("user", "and Dict?"), ("assistant", "dict and set")]
    rows = [(history, " 它 怎么用"), ([("user", "only a tuple")], "这个 有什么用"), ([], "它 怎么用"), (history, "plain question"), ([("system", "dict")] + history * 3, "上面 的")]
    df = spark.createDataFrame(rows, "h array<struct<role string, content string>>, q string")
    got = df.select(Q.entities(F.col("h")).alias("e"), Q.resolved(F.col("q"), Q.entities(F.col("h"))).alias("r")).collect()
    assert got[0].e == ["tuple", "函数", "set", "List", "Dict"] and got[0].r == " tuple 怎么用"
    assert got[1].e == ["tuple"] and got[1].r == "tuple 有什么用" and got[2].e == [] and got[2].r == "它 怎么用" and got[3].r == "plain question"
    assert len(got[4].e) == 5 and got[4].r.endswith(" 上面 的")


def test_spelling_readiness_and_arithmetic(spark):
    df = spark.createDataFrame([("用 API 和 json 写 html",), ("如何用redis做缓存",), ("它和redis的区别是什么",), ("为什么这样不好",), ("3加4等于多少",), ("123乘以2",), (None,)], "q string")
    rows = df.select(Q.spelled_out(F.col("q")).alias("s"), Q.spelled_out(F.col("q"), False).alias("p"), Q.retrieval_ready(F.col("q"), F.lit(0)).alias("r"), Q.arithmetic(F.col("q")).alias("a")).collect()
    assert rows[0].s == "用 API 和 JSON 数据格式 写 html" and [r.r for r in rows] == [True, True, False, False, False, False, False]
    assert rows[4].a == "3+4" and rows[5].a == "123*2" and rows[6].s is None
    kept = spark.createDataFrame([("use a list", ["List", "tuple", "set"]), ("x", [])], "t string, k array<string>").select(Q.appended(F.col("t"), F.col("k")).alias("v")).collect()
    assert [r.v for r in kept] == ["use a list tuple set", "x"]
