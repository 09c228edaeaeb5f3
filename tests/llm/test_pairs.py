import numpy as np
import pytest

from lorecast.llm.pairs import Counts, Grams, Languages, answer_counts, code_states, defective_pairs, end_likelihoods, fitted_languages, pair_texts
from lorecast.llm.sampling import sampled

DATA = "/root/testdata/sf0.1"
Q = "Why does `kuligu_riba` fail when the string buffer rebuilds the inner scope?"

CASES = [
    (Q, None, "empty"), (Q, " ​", "empty"), (Q, "N/A", "empty"), (Q, "<p> </p>", "empty"), (Q, "```\n```", "empty"), (Q, "待补充", "empty"), (Q, "???", "empty"), (Q, "**TBD**", "empty"),
    (Q, Q, "copy"), (Q, "Q: why does kuligu_riba fail, when the string buffer rebuilds the inner scope", "copy"), (Q, Q.upper(), "copy"), (Q, Q.replace("o", "о"), "copy"), (Q, f"Question: {Q}\nAnswer: {Q}", "copy"),
    (Q, "I’m sorry, but there is not enough context for me to respond.", "refusal"), (Q, "抱歉，我无法回答这个问题。", "refusal"), (Q, "Entschuldigung, enthalten die gefundenen Abschnitte keine Antwort.", "refusal"), (Q, "Je regrette, mais je ne sais pas.", "refusal"),
    (Q, "`kuligu_riba` behält den Rückgabewert nach dem zweiten Durchlauf. Aus diesem Grund überspringt jeder Arbeitsfaden die übrigen Zeichen.", "other_language"), ("What does `VakoFojija` do in constant time?", "`VakoFojija` sperrt das fehlende Feld beim Laden des Moduls. Der Speicherbereiniger behält den Index.", "other_language"), (Q, "在启动期间，`kuligu_riba` 会保留原始字节。正因为如此，嵌套循环返回父节点。", "other_language"),
    (Q, "`kuligu_riba` counts the declared type. Note that the iterator validates,", "truncated"), (Q, "`kuligu_riba` counts the declared type. The hash map rebu", "truncated"), (Q, "```python\nwith kuligu_riba(3) as handle:\n    handle.write(\"re", "truncated"), (Q, "`kuligu_riba` keeps the parent node (for example", "truncated"),
    (Q, "I’m sorry, but I cannot answer questions about `len`.", "refusal"), (Q, "I'm sorry, but I cannot answer this question. Please ask your instructor. Is there anything else I can do? " * 20, "refusal"),
    (Q, "I'm sorry, but I cannot answer this question. " * 9 + "The scheduler locks the remaining tokens and then wraps the parent node.", None), (Q, "[" + "." * 90 + "TBD" + "." * 90 + "]", "empty"),
    (Q, '`kuligu_riba` raises "cannot help" as its error text when a nested loop skips the smallest index.', None), (Q, "I don’t know a shorter way than this: a nested loop merges the fallback branch, then `kuligu_riba` copies the remaining tokens.", None),
    (Q, "42", None), (Q, "`None`", None), (Q, "`[]`", None), (Q, "O(n²)", None), (Q, "`kuligu_riba` keeps the parent node.", None), (Q, f"{Q} `kuligu_riba` hides the fallback branch at import time.", None),
    (Q, "I cannot run the code here, but `kuligu_riba` keeps the fallback branch.", None), (Q, "```python\nwith kuligu_riba(3) as handle:\n    handle.write(\"ready\")\n```", None), (None, "`kuligu_riba` keeps the parent node.", None),
]


@pytest.fixture(scope="module")
def languages(spark):
    return fitted_languages(spark.read.parquet(f"{DATA}/documents.parquet"), pair_texts(spark.read.parquet(f"{DATA}/eval_qa_pairs.parquet")))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.read.parquet(f"{DATA}/eval_qa_pairs.parquet").select("id", "question", "reference_answer")


def test_cases(spark, pairs, languages):
    rows = [(f" CASE{i:02}", q, a) for i, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, Q, None)], pairs.schema)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = [(r.qa_id, r.defect) for r in defective_pairs(pairs.unionByName(df), docs, languages).where("qa_id like 'case%'").collect()]
    assert sorted(got) == sorted((f"case{i:02}", d) for i, (_, _, d) in enumerate(CASES) if d)
    assert defective_pairs(df.limit(0), docs, languages).count() == 0


def test_languages_on_held_out_documents(spark, languages):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("lower(lang) as lang", "regexp_replace(lower(text), '`[^`]*`', ' ') as text").where("length(text) > 300 and lang in ('en', 'zh', 'de', 'fr')").collect()
    right = sum(r.lang == ("en", "zh", "de", "fr")[languages.posterior(r.text).argmax()] for r in rows)
    assert right / len(rows) > 0.95  # some labels are wrong


def test_counts_equal_brute_force(spark, pairs):
    texts = pair_texts(pairs.limit(50))
    counts = answer_counts(texts)
    answers = [r.a for r in texts.collect() if r.a]
    want = np.zeros_like(counts.inside)
    for a in answers:
        for k, b in enumerate(Grams([a], code_states([a])).buckets):
            np.add.at(want[k], b, 1)
    assert (counts.inside == want).all() and 0 < counts.ends[3].sum() <= len(answers)
    alone = [end_likelihoods([a], counts)[0] for a in answers]
    assert np.allclose(alone, end_likelihoods(answers, counts)) and 0 < min(alone) <= max(alone) <= 1
    assert Languages([]).posterior("abc").shape == (4,) and Counts().refusing() is None


def test_samples_are_whole_and_free_of_order(spark):
    df = spark.range(5000).selectExpr("id", "id * 2 as v")
    want = sorted(r.id for r in sampled(df, "id", 40, "s", 5000))
    assert len(want) == 40
    for total in (1, 10**10, 10**15):  # however many rows there are said to be
        assert sorted(r.id for r in sampled(df.orderBy("v").repartition(7), "id", 40, "s", total)) == want
    assert len(sampled(df.limit(3), "id", 40, "s", 10**10)) == 3 and sampled(df.limit(0), "id", 40, "s", 0) == []


def test_no_labels_is_an_error(spark):
    docs = spark.createDataFrame([("a", None, "text")], "id string, lang string, text string")
    with pytest.raises(ValueError, match="language"):
        fitted_languages(docs)
