import pytest
from tokenizers import Tokenizer

from lorecast.llm.tokens import decoded, token_counts, token_ids

TEXTS = [
    None, "", " ", "   a  b\n\n c\t", "<|endoftext|> it's we'LL 12345 ½ ²", "请注意，模块加载器。", "é é ﬁ 😀👩‍👩‍👧 ​\x00\x1c\x85 x", "a" * 5000 + " b" * 3000,
    "word " * 60_000, "same", "same", "\r\n\r\n  x", " ", "don't 'sx 'S",
]


@pytest.mark.parametrize(("block_chars", "hot_rows"), [(10, 1), (2_000_000, 500_000)])
def test_ids_counts_and_round_trip(spark, block_chars, hot_rows):
    whole = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "w" if i % 3 else None) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string").repartition(3)
    got = token_ids(df, ["doc_id", "word"], "text", block_chars=block_chars, hot_rows=hot_rows)
    assert got.dtypes == [("doc_id", "bigint"), ("word", "string"), ("ids", "array<int>")]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == (whole.encode(t, add_special_tokens=False).ids if t else []), repr(t)[:40]
        assert rows[i].word == ("w" if i % 3 else None)
    counts = {r.doc_id: r.n for r in token_counts(df, ["doc_id"], "text", "n", block_chars=block_chars).collect()}
    assert counts == {i: len(r.ids) for i, r in rows.items()}
    back = {r.doc_id: r.text for r in decoded(got, "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_decoding_of_odd_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [15496, -1, 99999, 995]), (4, [None, 15496]), (5, [187])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in decoded(df, "doc_id").collect()} == {1: "", 2: "", 3: "Hello,"[:5] + decoded_token(995), 4: "Hello", 5: "\ufffd" if len(decoded_token(187)) != 1 or decoded_token(187) == "\ufffd" else decoded_token(187)}


def decoded_token(i):
    whole = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    return whole.decode([i])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_ids(df, ["doc_id"], "text").count() == 0
    with pytest.raises(ValueError):
        token_ids(df, ["doc_id"], "text", "doc_id")
