import time

import numpy as np
import pytest

from lorecast.llm.boosting import Boosted
from lorecast.llm.pii import Judge, candidates, checked, evidence, features, found_pii, folded, redacted

DATA = "/root/testdata/sf0.1"

CASES = [
    ("Questions go to Draskovel, Clio at castellbrook_82@cs.nubaku.example.", [("person", "Draskovel, Clio"), ("email", "castellbrook_82@cs.nubaku.example")]),
    ("Ask Dr. Clio Achterveld or Ms Sørlund for access.", [("person", "Clio Achterveld"), ("person", "Sørlund")]),
    ("如有问题请联系东方映荷，邮箱 nuria.fennimarsh [at] gotovu [dot] example。", [("person", "东方映荷"), ("email", "nuria.fennimarsh [at] gotovu [dot] example")]),
    ("我叫闻听澜，住在北岭市望江街31号2单元，手机号１２３２００７４９１９。", [("person", "闻听澜"), ("address", "北岭市望江街31号2单元"), ("phone", "１２３２００７４９１９")]),
    ("学员令映荷，身份证号990101198205040856，已完成报名。", [("person", "令映荷"), ("id_number", "990101198205040856")]),
    ("Write to mailto:halvor+qa@faruja.invalid or text 020 7946 0638, ext. 14.", [("email", "halvor+qa@faruja.invalid"), ("phone", "020 7946 0638")]),
    ("J’habite 18, avenue du Vieux-Phare, 99445 Tréguen et mon numéro est le +33 1 99 00 35 62.", [("address", "18, avenue du Vieux-Phare, 99445 Tréguen"), ("phone", "+33 1 99 00 35 62")]),
    ("Steuer-ID 03 052 285 091, Name Mireille Tarnowick.", [("id_number", "03 052 285 091"), ("person", "Mireille Tarnowick")]),
    ("Reviewer on file: Anselm L. Vandersteyl, ID 963-44-4726.", [("person", "Anselm L. Vandersteyl"), ("id_number", "963-44-4726")]),
    ("He moved to 239 Oxbarrow Street #67 last year.", [("address", "239 Oxbarrow Street #67")]),
    ("Die Korrekturen gehen an WIM THORNEBECK, Lindenplatz 211b.", [("person", "WIM THORNEBECK"), ("address", "Lindenplatz 211b")]),
    ("The run started at 2025-03-04 12:30:55 on 192.0.2.17. Install left@1.2.3 and retry. Use @cached to keep the result.", []),
    ("Order 1000000007 is a large prime. Main Thread 12 waits for Queue Street. Weg 2 ist schneller als Weg 1.", []),
    ("Copper Toolkit replaced Java Corner in March. Set max_rows=250000000 first. 路由表88号条目已过期。", []),
]


@pytest.fixture(scope="module")
def judge(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").dropna().limit(4000).collect()]
    return Judge(sorted(texts))


def test_held_out_accuracy(judge):
    assert len(judge.held_out) >= 3 and min(judge.held_out.values()) > 0.95


def test_contexts_carry_over_to_documents_never_seen(spark, judge):
    """Spans that bear evidence in other documents than those of the sample, which the trees don't see."""
    texts = [folded(r.text)[0] for r in spark.read.parquet("/root/testdata/check_s/documents.parquet").select("text").dropna().limit(1500).collect()]
    hit = got = want = 0
    for t in texts:
        found = candidates(t)
        chosen = set(judge.select([found], features(t, found, judge.names, judge.contexts))[0])
        for c, v in zip(found, evidence(t, found, frozenset(), frozenset())):
            if v >= 0 and c[0] in (1, 2):
                hit, got, want = hit + (c in chosen and v), got + (c in chosen), want + v
    assert want > 100 and hit / want > 0.97 and hit / got > 0.97


def test_check_digits():
    assert checked("11010519491231002X") and not checked("110105194912310021") and checked("255081416802538") and not checked("255081416802539")
    assert checked("86095742719") and not checked("86095742710") and checked("123456789") is None


def test_very_many_candidates_of_one_text(judge):
    text = "".join(f"call 020 7946 {i:04d}, Ask Dr. Clio Achterveld. " for i in range(8000))
    began = time.time()
    found = candidates(text)
    x = features(text, found, judge.names, judge.contexts)
    chosen = judge.select([found], x)[0]
    made = time.time() - began
    began = time.time()
    judge.select([found], x)
    assert len(found) >= 16_000 and len(chosen) >= 8_000 and time.time() - began < 1 and made < 15


def test_a_sample_without_evidence_is_an_error():
    with pytest.raises(ValueError, match="evidence"):
        Judge(["Copper Toolkit rings Java Corner."])


def test_cases_in_their_places(spark, judge):
    rows = [(i, "x\n" + t + "\ny", "z") for i, (t, _) in enumerate(CASES)] + [(100, None, "z"), (101, "", "z"), (102, "word " * 50_000 + "call 020 7946 0638 now", "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, pii_type_of string").repartition(4)
    texts = {r[0]: r[1] for r in rows}
    got: dict = {}
    for r in found_pii(df, ["doc_id", "pii_type_of"], "text", judge).collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.pii_type, texts[r.doc_id][r.start_char : r.end_char]))
    for i, (t, want) in enumerate(CASES):
        assert sorted(x[1:] for x in got.get(i, [])) == sorted(want), t
    assert [x[2] for x in got[102]] == ["020 7946 0638"] and 100 not in got and 101 not in got
    out = {r.doc_id: r.text for r in redacted(df.drop("pii_type_of"), ["doc_id"], "text", judge=judge).collect()}
    assert out[0] == "x\nQuestions go to [PERSON] at [EMAIL].\ny" and out[100] is None and out[101] == "" and out[11] == texts[11]


def test_folding_keeps_places():
    text = "a​b é ﬁn １２"
    form, starts, ends = folded(text)
    assert form == "ab é fin 12"
    for i, c in enumerate(form):
        assert text[starts[i] : ends[i]]
    assert text[starts[form.index("é")] : ends[form.index("é")]] == "é"


def test_empty_table(spark, judge):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert found_pii(df, ["doc_id"], "text", judge).count() == 0
    assert found_pii(df, ["doc_id"], "text").count() == 0


def test_gates_let_every_spelling_pass(judge):
    for mail in ("jane.roe {AT} site.example", "jane.roe <at> site.example", "jane.roe [ät] site.example", "jane.roe (AROBASE) site [point] example", "jane.roe at site [dot] example"):
        assert (0, 6, 6 + len(mail)) in candidates(f"Write {mail} now."), mail


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    m = Boosted().fit(x[:3000], y[:3000]).calibrate(x[3000:3500], y[3000:3500])
    p = m.probability(x[3500:])
    assert ((p > 0.5) == y[3500:]).mean() > 0.97
    assert Boosted().fit(x[:0], y[:0]).probability(x[:3]).shape == (3,)
