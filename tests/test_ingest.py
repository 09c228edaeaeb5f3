import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from lorecast.functions import cleaning as C
from lorecast.operators import chunking as K
from lorecast.operators.reviews import START, Review, in_mode, is_right, quality_of, review_states
from lorecast.sources import files, sinks
from lorecast.streaming import activity


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("expr", "text", "want"),
    [
        (C.sanitized, "a b​ｃ́e\x07\t", "a bć" + "e\t"),
        (C.without_tags, "<p>a</p> \n <b class='x'>b</b> #include <stdio.h> a < b", "a\nb #include <stdio.h> a < b"),
        (C.trimmed_lines, "a \t\nb  ", "a\nb"),
        (C.normal_space, " \u00a0a\r\n\r\n\r\n\rb ", "a\n\nb"),
        (C.without_noise, "keep\n\n---\nAll Rights Reserved\n## Example:\nHome\nalso", "keep\nalso"),
        (C.distinct_paragraphs, "A b\n\na B \n\nc\n\nA b", "A b\n\nc\n\nA b"),
        (C.distinct_paragraphs, "", ""),
        (C.token_estimate, "abc", 1),
        (C.word_count, " a\u00a0b \n c", 3),
    ],
)
def test_cleaning(spark, expr, text, want):
    assert one(spark, text, expr) == want
    assert one(spark, None, expr) in (None, -1)


def _of(chunks):
    return [x[:2] for x in chunks]


def test_markdown_chunks():
    text = "intro that is long enough to be kept here\n# Head\nbody body body body body body\n```python\n# not a head\nprint('a long enough line of code')\n```\ntail that is long enough to be kept too"
    got = _of(K.markdown_chunks(text))
    assert [k for k, _ in got] == ["text", "text", "code_block_python", "text"] and got[2][1].startswith("```python") and got[1][1].startswith("# Head")
    assert [k for k, _ in _of(K.markdown_chunks("# Head\n" + "body " * 10))] == ["text_heading"]
    assert list(K.markdown_chunks("# short")) == [] and list(K.markdown_chunks("")) == []
    long = _of(K.markdown_chunks("\n".join(["x" * 99] * 200)))
    assert len(long) == 4 and sum(len(c.replace("\n", "")) for _, c in long) == 99 * 200
    assert [k for k, _ in _of(K.markdown_chunks("```\n" + "y" * 40 + "\n```\n```js\n" + "z" * 40 + "\n# in code"))] == ["code_block", "code_block_js"]


def test_lines_of_markdown_are_all_kept_in_order():
    lines = [f"{'# ' if i % 50 == 0 else ''}line {i} " + "w" * (i * 7 % 200) for i in range(900)]
    chunks = list(K.markdown_chunks("\n".join(lines)))
    assert [line for _, c, _, _ in chunks for line in c.split("\n")] == [line.rstrip() if n in {b - 1 for *_, b in chunks} else line for n, line in enumerate(lines)]
    assert [a for *_, a, _ in chunks][1:] == [b for *_, b in chunks][:-1] and all(len(c) <= 6004 + 220 for _, c, _, _ in chunks)


@pytest.mark.parametrize(("language", "text", "kinds"), [
    ("python", "import a\n\ndef f(x):\n    return x\n\nclass B:\n    def g(self):\n        pass\n@wraps\nx = 1", ["text", "function", "class", "function", "function"]),
    ("go", "package a\nfunc (s *S) Run(x int) {\n}\ntype S struct {\n}", ["text", "function", "class"]),
    ("rust", "use a;\nfn run() {}\nstruct S;\nimpl S {}", ["text", "function", "class", "class"]),
    ("javascript", "let a\nfunction run() {}\nclass S {}", ["text", "function", "class"]),
    ("c", "#include <a.h>\nint main(void) {\n}\ntypedef struct node {", ["text", "function", "class"]),
    ("csharp", "using A;\nabstract class B\n  public int Run(int x) {", ["text", "class", "function"]),
    ("java", "import a;\npublic class B {\npublic static void main(String[] x) {", ["text", "class", "function"]),
    ("unknown", "a = 1\ndef f(): pass", ["text", "function"]), (None, "def f(): pass\nclass A: pass", ["text", "class"]),
])
def test_code_chunks_by_language(spark, language, text, kinds):
    df = spark.createDataFrame([(1, text, language)], "doc_id int, text string, language string")
    rows = K.chunked(df, "doc_id", "text", F.lit("code"), F.col("language"), carry=["language"]).orderBy("chunk_index").collect()
    assert [r.chunk_type for r in rows] == kinds and "\n".join(r.content for r in rows) == text and rows[-1].end_line == text.count("\n") + 1 and rows[0].language == language


def test_long_code_and_prose_chunks():
    code = "\n".join(f"x{i} = {'1' * 90}" for i in range(300))
    got = list(K.code_chunks(code, [0] * 300))
    assert "\n".join(c for _, c, _, _ in got) == code and all(6004 <= len(c) < 6200 for _, c, _, _ in got[:-1]) and {k for k, *_ in got} == {"text"}
    paragraphs = [f"{i} " + "word " * 300 for i in range(5)]
    prose = [c for _, c, _, _ in K.prose_chunks("\n\n".join(paragraphs))]
    assert len(prose) == 3 and prose[1].startswith(prose[0][-200:].strip())
    sentences = [c for _, c, _, _ in K.prose_chunks("A sentence of some length. " * 400)]
    assert all(len(c) <= 4004 for c in sentences) and re.sub(r"\s", "", "".join(sentences)) == re.sub(r"\s", "", "A sentence of some length. " * 400)


def test_chunked_table(spark):
    df = spark.createDataFrame([(1, "# Head\n" + "body " * 20, ".md", "x"), (2, None, ".md", "x"), (3, "plain " * 20, None, "y"), (4, "", ".py", None)], "doc_id int, text string, ext string, kind string")
    rows = K.chunked(df, "doc_id", "text", K.chunk_kind(F.col("ext"), F.lit(None).cast("string"), F.col("kind"))).collect()
    assert sorted((r.doc, r.chunk_type, r.chunk_index) for r in rows) == [("1", "text_heading", 0), ("3", "text", 0)]
    assert len({r.chunk_id for r in rows}) == 2 and all(r.preview == r.content[:200] for r in rows)
    assert K.chunked(df.limit(0), "doc_id", "text", F.lit("prose")).count() == 0


T0 = dt.datetime(2024, 1, 1)


def answers(spark, rows):
    return spark.createDataFrame([(u, e, T0 + dt.timedelta(hours=h) if h is not None else None, i, q) for i, (u, e, h, q) in enumerate(rows)], "learner string, exercise string, at timestamp_ntz, id bigint, quality int")


def test_reviews(spark):
    s = START
    for q in (5, 5, 5, 4, 5):
        s = s.answered(q)
    assert s.repetitions == 5 and s.interval_days > 30 and s.ease > 2.5 and s.mastered
    s = s.answered(1)
    assert (s.misses, s.repetitions, s.interval_days, s.mastered) == (1, 0, 0, False) and s.answered(9).last_quality == 5
    eases = [START.answered(5, x).ease for x in ("easy", "medium", "hard", "odd", None)]
    assert eases == pytest.approx([2.6, 2.4, 2.1, 2.6, 2.6]) and START.answered(3).interval_days == 1
    assert Review(2, 2, 2, 0, 2, 6, 2.5).answered(3).interval_days == 12 and Review(2, 2, 2, 0, 2, 0, 1.3).answered(3).interval_days == 1
    rows = [("a", "1", h, q) for h, q in ((5, 1), (1, 5), (3, 4))] + [("a", "1", None, 5), ("b", "1", 1, None), (None, "1", 1, 5)] + [("hot", "1", h, h % 6) for h in range(500)]
    got = {r.learner: r for r in review_states(answers(spark, rows).repartition(5)).collect()}
    want = START
    for q in (5, 4, 1):
        want = want.answered(q)
    assert set(got) == {"a", "hot"} and got["a"].reviews == 3 and got["a"].interval_days == want.interval_days and abs(got["a"].ease - want.ease) < 1e-9
    assert got["hot"].reviews == 500 and got["a"].due_at == T0 + dt.timedelta(hours=5)
    assert review_states(answers(spark, [("a", "1", 1, 5)]).limit(0)).count() == 0


def test_sessions(spark):
    rows = [("new", None, None, None, None), ("due", 2, 2, T0, False), ("later", 2, 1, T0 + dt.timedelta(days=9), False), ("mastered", 9, 9, T0, True)]
    df = spark.createDataFrame(rows, "exercise string, reviews int, correct int, due_at timestamp_ntz, mastered boolean")
    now = F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz")
    got = {m: {r.exercise for r in df.where(in_mode(m, now)).collect()} for m in ("new", "due", "review", "wrong", "all")}
    assert got == {"new": {"new"}, "due": {"due"}, "review": {"due", "mastered"}, "wrong": {"later"}, "all": {"new", "due", "later", "mastered"}}
    with pytest.raises(ValueError):
        in_mode("odd", now)
    one = spark.createDataFrame([("a", "A"), ("b", "A"), (None, "A")], "x string, y string").select(quality_of(is_right(F.col("x"), F.col("y"))).alias("q"))
    assert [r.q for r in one.collect()] == [4, 1, 1]


def _run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_review_stream_equals_batch(spark, tmp_path):
    rows = [(u, str(e), h, (h * 7 + e) % 6) for u in "ab" for e in range(3) for h in range(10)]
    df = answers(spark, rows)
    df.repartition(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run(activity.review_stream(stream), "update", "reviews")
    got = {(r.learner, r.exercise): r.ease for r in spark.table("reviews").collect()}
    want = {(r.learner, r.exercise): r.ease for r in review_states(df).collect()}
    assert got == pytest.approx(want)


def test_activity_and_ingest_streams(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), "a") for m in (1, 2, 70, 75, 300)] + [(None, "a")]
    df = spark.createDataFrame(rows, "at timestamp, kind string")
    df.write.parquet(str(tmp_path / "ev"))
    _run(activity.hourly_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev")), "at", "kind"), "complete", "hours")
    assert sorted(r.events for r in spark.table("hours").collect()) == [1, 2, 2]
    docs = spark.createDataFrame([("k", "x", T0), ("k", "x", T0), ("k", "y", T0), ("l", "x", T0)], "kb_id string, text string, at timestamp")
    docs.write.parquet(str(tmp_path / "docs"))
    fresh = activity.fresh_documents(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), "kb_id", "text", "at")
    q = fresh.writeStream.foreachBatch(activity.append_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "src" / "docs").mkdir(parents=True)
    (tmp_path / "src" / "docs" / "a.md").write_bytes("# Tïtle\xa0".encode())
    (tmp_path / "src" / "b.py").write_bytes(b"x = '\xff'")
    (tmp_path / "src" / "c.png").write_bytes(b"123")
    (tmp_path / "src" / "big.txt").write_bytes(b"x" * 200)
    rows = {r.path: r for r in files.read_tree(spark, str(tmp_path / "src"), most_bytes=100).collect()}
    assert set(rows) == {"docs/a.md", "b.py"} and rows["b.py"].language == "python" and rows["docs/a.md"].mime_type == "text/markdown"
    assert files.read_tree(spark, str(tmp_path / "src"), ["docs/"]).count() == 1
    html = "<html><head><title> A <b>b</b>\n c </title></head><a href='/x'>1</a><a class=q href=\"/y#z\">2</a><a href='/x'>3</a>"
    assert one(spark, html, files.page_title) == "A b c" and one(spark, html, files.page_links) == ["/x", "/y"]
    assert one(spark, html, lambda c: files.page_title(c, [" c", "x"])) == "A b" and one(spark, "x = 1", lambda c: files.headed(c, F.lit("b.py"))) == "# Language: python\n# File: b.py\n\nx = 1"
    (tmp_path / "ann.json").write_text(json.dumps([{"question": "q", "doc": "d", "chunk_indices": [1, 2]}, {"question": "r", "doc": "e"}]))
    assert sorted((r.question, r.chunk_index) for r in files.read_annotations(spark, str(tmp_path / "ann.json")).collect() if r.chunk_index) == [("q", 1), ("q", 2)]
    up = spark.createDataFrame([("k", bytearray(b"x")), ("k", bytearray(b"x")), ("l", bytearray(b"x"))], "kb_id string, content binary")
    known = up.where("kb_id = 'l'").select("kb_id", F.sha2("content", 256).alias("doc_hash"))
    assert files.new_uploads(up, known).count() == 1
    old = spark.createDataFrame([("k", 1, "a"), ("l", 2, "b")], "kb_id string, id int, v string")
    sinks.write_partitions(old, str(tmp_path / "t"))
    sinks.write_partitions(spark.createDataFrame([("k", 3, "c")], old.schema), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.id for r in back.collect()) == [2, 3]
    both = old.unionByName(spark.createDataFrame([("m", 1, "z")], old.schema))
    assert {r.id: r.v for r in sinks.latest(both, ["id"], [F.desc("kb_id")]).collect()} == {1: "z", 2: "b"}
    children = spark.createDataFrame([(1, 10), (2, 20)], "parent int, c int")
    parents, kids = sinks.cascade(old, children, old.where("id = 1"), "id", "parent")
    assert [r.id for r in parents.collect()] == [2] and [r.c for r in kids.collect()] == [20]
    moved = sinks.remapped(old, spark.createDataFrame([("l", "k")], "old string, new string"), "kb_id")
    assert {r.kb_id for r in moved.collect()} == {"k"}
    assert sinks.with_columns_of(old, {"w": F.lit(1)}).first().w == 1
    assert sinks.markdown_table(old.orderBy("id")).split("\n")[2] == "| k | 1 | a |"
    assert sinks.latex_table(old.orderBy("id")).split("\n")[2] == "k & 1 & a \\\\"
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(sinks.REPORT_ROWS + 1))
    sinks.write_report(old, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    check = sinks.rebuilt(old.selectExpr("kb_id", "cast(id as string) as chunk_id"), str(tmp_path / "index")).collect()
    assert all(r.complete and r.expected == 1 for r in check)
    fresh = sinks.reindexed(old, old.where("id = 1").withColumn("v", F.lit("new")), old.select("id"), "id")
    assert {r.id: r.v for r in fresh.collect()} == {1: "new", 2: "b"}
    levels = sinks.cascaded(old.where("id = 1").select("id"), [("a", old, "id", None), ("b", children, "c", "parent"), ("c", children.selectExpr("c as of", "c + 1 as leaf"), "leaf", "of")])
    assert [r.id for r in levels["a"].collect()] == [2] and [r.c for r in levels["b"].collect()] == [20] and [r.leaf for r in levels["c"].collect()] == [21]
