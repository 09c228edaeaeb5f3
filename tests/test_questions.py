import pytest
from pyspark.sql import functions as F

from lorecast.functions import questions as Q


@pytest.mark.parametrize(
    ("text", "want"),
    [("Hello!", "greeting"), ("谢谢", "greeting"), ("what can you do", "meta"), ("没懂", "clarification"), ("举个例子", "knowledge"), ("什么是装饰器", "knowledge"), ("3 + 4", "tool"), ("今天天气", "tool"), ("explain closures please", "knowledge"), ("why", "clarification"), ("a long remark about nothing in particular", None), (None, None)],
)
def test_intent(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(Q.intent(F.col("t")).alias("v")).first().v == want


def test_cleaning_prompt_and_footnote(spark):
    df = spark.createDataFrame([(" 请问一下，列表怎么排序？谢谢", [("user", "a"), ("assistant", "b")] * 4, ["c1", "c2"], [("T", "x" * 100)]), ("谢谢", [], [], [])], "q string, h array<struct<role string, content string>>, c array<string>, s array<struct<title string, content string>>")
    rows = df.select(Q.cleaned_question(F.col("q")).alias("q"), Q.prompt(F.col("c"), F.col("h"), F.col("q")).alias("p"), Q.footnote(F.lit("answer"), F.col("s")).alias("f"), Q.footnote(F.lit("see [1]"), F.col("s")).alias("g")).collect()
    assert rows[0].q == ",列表怎么排序?" and rows[1].q == "谢谢"
    assert rows[0].p.startswith("[1] c1\n\n[2] c2\n\nuser: a") and rows[0].p.count("user: a") == 3 and rows[1].p == "谢谢"
    assert rows[0].f == "answer\n\n[1] T: " + "x" * 80 and rows[1].f == "answer" and rows[0].g == "see [1]"
