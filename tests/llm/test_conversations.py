import datetime as dt
import random

import pytest

from lorecast.llm.conversations import dropped_conversations, rebuilt_conversations, reply_cycles, topological_order

DDL = "id string, conversation_id string, role string, content string, created_at timestamp_ntz, slice int, reply string"


def at(second):
    return None if second is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def frame(spark, rows):
    return spark.createDataFrame([(str(i), c, r, t, at(s), 7, None) for i, (c, r, t, s) in enumerate(rows)], DDL)


CASES = [
    ("ok", [("User", "a", 1), (" 助手", "b", 2), ("user", "c", 3), ("bot", "d", 3)], None),
    ("copy", [("user", "a", 1), ("human", "a", 1), ("ai", "b", 2), ("assistant", "b", 2)], None),
    ("sys", [("system", "s", 2), ("user", "a", 1), ("ai", "b", 3)], None),
    ("onlysys", [("system", "s", 1), ("user", "  ​", 2), ("ai", None, 3)], "empty"),
    ("blank", [("user", "", 1)], "empty"),
    ("notime", [("user", "a", 1), ("ai", "b", None)], "broken"),
    ("norole", [("user", "a", 1), ("?", "b", 2)], "broken"),
    ("nullrole", [("user", "a", 1), (None, "b", 2)], "broken"),
    ("starts", [("ai", "b", 1), ("user", "a", 2), ("ai", "c", 3)], "broken"),
    ("twice", [("user", "a", 1), ("ai", "b", 2), ("ai", "c", 3)], "broken"),
    ("twice_open", [("user", "a", 1), ("ai", "b", 2), ("ai", "c", 3), ("user", "d", 4)], "broken"),
    ("open", [("user", "a", 1), ("ai", "b", 2), ("user", "c", 3)], "missing_reply"),
    ("unanswered", [("user", "a", 1), ("user", "b", 2), ("ai", "c", 3)], "missing_reply"),
    ("ties", [("ai", "b", 1), ("user", "a", 1)], None),
    ("untimed", [("system", "s", None)], "empty"),
]


@pytest.mark.parametrize("slice_rows", [1, 200_000])
def test_reasons_and_rebuilding(spark, slice_rows):
    rows = [(f" {c.upper()}", *r) for c, turns, _ in CASES for r in turns] + [(None, "user", "lost", 1), ("  ", "ai", "lost", 1)]
    random.Random(3).shuffle(rows)
    df = frame(spark, rows + rows[:7])
    got = {r.conversation_id: r.reason for r in dropped_conversations(df, slice_rows=slice_rows).collect()}
    assert got == {c: why for c, _, why in CASES if why}
    kept = {}
    for r in rebuilt_conversations(df, slice_rows=slice_rows).orderBy("conversation_id", "position").collect():
        kept.setdefault(r.conversation_id, []).append((r.position, r.role, r.content))
    assert set(kept) == {c for c, _, why in CASES if not why}
    assert kept["ok"] == [(1, "user", "a"), (2, "assistant", "b"), (3, "user", "c"), (4, "assistant", "d")]
    assert kept["sys"] == [(1, "user", "a"), (2, "system", "s"), (3, "assistant", "b")]


def test_slices_give_what_whole_conversations_give(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(3)}", rng.choice(["user", "ai", "system"]), str(i), rng.randrange(300)) for i in range(400)]
    rows += [("long", "user" if i % 2 == 0 else "ai", str(i), i) for i in range(500)]
    df = frame(spark, rows)
    whole, cut = (sorted(map(tuple, dropped_conversations(df, slice_rows=n).collect())) for n in (10**6, 10))
    assert whole == cut and "long" not in dict(whole)
    a, b = (sorted(map(tuple, rebuilt_conversations(df, slice_rows=n).collect())) for n in (10**6, 10))
    assert a == b and len(a) == 500


def test_empty_table(spark):
    df = frame(spark, [("c", "user", "a", 1)]).limit(0)
    assert dropped_conversations(df).count() == 0 and rebuilt_conversations(df).count() == 0


def test_given_replies(spark):
    row = lambda i, c, r, s, p: (i, c, r, i[0], at(s), 0, p)
    df = spark.createDataFrame(
        [
            row("1", "good", "user", 1, None), row("2", "good", "ai", 2, "1"),
            row("3", "cycle", "user", 1, "4"), row("4", "cycle", "ai", 1, "3"),
            row("5", "lost", "user", 1, None), row("6", "lost", "ai", 2, "99"),
            row("7", "early", "user", 5, None), row("8", "early", "ai", 2, "7"),
            row("9", "copies", "user", 1, None), row("90", "copies", "user", 1, None), row("91", "copies", "ai", 2, "90"),
        ],
        DDL,
    )
    for n in (1, 10**6):
        got = {r.conversation_id: r.reason for r in dropped_conversations(df, "reply", n).collect()}
        assert got == {"cycle": "broken", "lost": "broken", "early": "broken"}
    assert [tuple(r) for r in reply_cycles(df, "reply").collect()] == [("cycle", 2)]


def test_kahn_leaves_cycles_over():
    nodes = [(3, 0, 0), (1, 0, 1), (2, 0, 2), (0, 0, 3), (0, 0, 4)]
    assert topological_order(nodes, {1: [0], 3: [4], 4: [3]}) == [1, 2, 0]
