import itertools
import random

import pytest

from lorecast.llm.boilerplate import Page, aligned, fitted, main_bodies, marked_lines, minimum_cut

DATA = "/root/testdata/sf0.1"


def test_cut_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        unary = [rng.choice([-2.0, -1.0, -0.5, 0.3, 0.7, 1.5]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.2, 0.5, 1.1])) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            return sum(u * (not x) if u > 0 else -u * x for u, x in zip(unary, label)) + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(unary, edges)) - best) < 1e-9


def test_long_page_is_cut():
    n = 20_000
    edges = [(i - 1, i, 1.0) for i in range(1, n)]
    assert minimum_cut([0.5 if i % 2 else -0.4 for i in range(n)], edges) == [True] * n


def test_page_and_alignment():
    page = Page("Menu\n\nA line\n```\n- x\n```\n<nav>\n- Home\n</nav>\r\n​\nEnd")
    assert page.numbers == [1, 3, 4, 5, 6, 7, 8, 9, 11]
    assert page.block == [-1, -1, 1, 1, 1, 2, 2, 2, -1] and page.marker[6] == ""
    assert aligned(page, "A line\n```\n- x\n```\nEnd") == [1, 0, 0, 0, 0, 1, 1, 1, 0]
    assert aligned(page, "other") == [-1] * 9


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("document_chunks", "documents")]


@pytest.fixture(scope="module")
def model(tables):
    return fitted(*tables)


def test_held_out_accuracy(model):
    assert model.held_out > 0.97 and 0 < model.turned < 0.05


def test_cases(spark, model):
    web = '{"source_url": "https://x.test/a"}'
    page = "Toggle navigation\nBlog | Log in | Docs\n## Notes on `kafaGanapi`\n\nThe scheduler locks the remaining tokens and then wraps the parent node.\n\n```python\nwith kafaGanapi(71) as handle:\n    handle.write(\"ready\")\n```\nWas this page helpful? Yes / No\n© 2020 Rurura Ltd. All rights reserved."
    rows = [
        ("A ", "d1", page, web, 1), ("a", "d1", page, web, 1), ("b", "d1", None, web, 1), ("c", "d1", "", web, 1), (None, "d1", page, web, 1),
        ("e", "d2", page, None, 1), ("f", "d1", page, '{"file_extension": ".md"}', 1), ("g", "d3", page, None, 1),
        ("h", "d1", "Subscribe to our newsletter\nBack to top\nReport a problem with this page", web, 1),
        ("i", "d1", "The scheduler locks the remaining tokens.\n\n" * 3000 + "Back to top", web, 1),
    ]
    chunks = spark.createDataFrame(rows, "id string, doc_id string, content string, metadata_json string, text int")
    docs = spark.createDataFrame([("d1", "url"), ("D2", "url"), ("d3", "git")], "id string, source_type string")
    got: dict = {}
    for r in marked_lines(chunks, docs, model).collect():
        got.setdefault(r.chunk_id, set()).add(r.line_no)
    assert got == {"a": {1, 2, 11, 12}, "e": {1, 2, 11, 12}, "h": {1, 2, 3}, "i": {6001}}
    main = {r.chunk_id: r.content for r in main_bodies(chunks, docs, model).collect()}
    assert main["a"].startswith("## Notes") and main["a"].endswith("```") and main["h"] == ""
    assert marked_lines(chunks.limit(0), docs, model).count() == 0


def test_lists_go_with_the_line_that_leads_to_them():
    page = Page("A line\nThe menu has two entries:\n- Home\n- Log in\nAnother line\n- Home\n- Log in")
    assert page.lead == [-1, -1, 1, 1, -1, -1, -1]
    edges = page.edges((0.1, 0.1, 3.0, 1.0, 0.1, 8.0))
    assert minimum_cut([-5.0, -5.0, 2.0, 2.5, -5.0, 2.0, 2.5], edges) == [False, False, False, False, False, True, True]


def test_nothing_to_learn_from_is_an_error(spark):
    chunks = spark.createDataFrame([("a", "d", "Menu\nText", '{"source_url": "https://x.test/a"}')], "id string, doc_id string, content string, metadata_json string")
    docs = spark.createDataFrame([("d", "url", "nothing of it")], "id string, source_type string, text string")
    with pytest.raises(ValueError, match="teaches"):
        fitted(chunks, docs)


def test_without_documents(spark, tables):
    chunks, docs = tables
    assert fitted(chunks.limit(0), docs.limit(0)).held_out is None
