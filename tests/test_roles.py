"""Messages of users are taken by their readable role, however it is spelled."""

import datetime
import hashlib

from oracle import duck, rows_of

from lorecast.plans import questions

T = [datetime.datetime(2024, 1, 1, 0, i) for i in range(9)]
ROWS = [
    ("m1", "c", "human", "hello", T[0]), ("m2", "c", "Bot", "good day", T[1]), ("m3", "c", " 用户 ", "什么是装饰器", T[2]), ("m4", "c", "narrator", "aside", T[3]),
    ("m5", "c", "USER:", "3 + 4", T[4]), ("m6", "c", "ki", "7", T[5]), ("m7", "c", None, "lost", T[6]), ("m8", "c", "système", "rules", T[7]), ("m9", "d", "élève", "why", T[8]),
]


def _planted(spark, tmp_path):
    spark.createDataFrame(ROWS, "id string, conversation_id string, role string, content string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/messages.parquet")
    return str(tmp_path)


def test_intents_of_users_in_any_spelling(spark, tmp_path):
    rows = questions.intent_classify(spark, _planted(spark, tmp_path)).collect()
    assert {r.intent: (r.messages, r.signs) for r in rows} == {"greeting": (1, 5), "knowledge": (1, 6), "tool": (1, 5), "clarification": (1, 3)}


def test_prompts_of_users_in_any_spelling(spark, tmp_path):
    turns = ["user: hello", "assistant: good day", "user: 什么是装饰器", "narrator: aside"]
    want = {"m1": "hello", "m3": "\n".join(turns[:2]) + "\n\n什么是装饰器", "m5": "\n".join(turns) + "\n\n3 + 4", "m9": "why"}
    rows = questions.prompt_build(spark, _planted(spark, tmp_path)).collect()
    assert {r.id: (r.signs, r.hash) for r in rows} == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}


def test_all_messages(spark):
    for name in ("intent_classify", "prompt_build"):
        columns, want = duck(questions.QUERIES[name][1])
        got = questions.QUERIES[name][0](spark, "/root/testdata/sf0.01")
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want), name
