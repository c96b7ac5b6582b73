from . import helpers as H
import pytest
from jobtide.llm import lines

SITE = "Posted on 2021-03-04 by user17 under general"


def fixture(spark):
    random = [f"unique alpha{c} beta gamma\nanother{c} line of its own" for c in "abcdefghijkl"]
    texts = [f"{t}\nPosted on 2021-03-{i:02d} by user{i} under general" for i, t in enumerate(random)]
    texts += [f"Read more about topic {w} in our archive today\nbody {w}" for w in "red blue green grey pink teal gold lime".split()]
    texts += ["All rights reserved.", "x\nAll rights reserved.", "y\n\n  All rights reserved.\t"] + [f"z{c} q\nAll rights reserved." for c in "abcdef"]
    texts += [None, "", "\n\n", texts[0], texts[0], "The cat sat here", "The cat sat there"]
    return H.documents(spark, texts), texts


def test_same_rows_as_sql(spark):
    docs, _ = fixture(spark)
    for options in ({}, {"least_texts": 2}, {"least_texts": 3, "lead": 1, "constant_tokens": 0.5}):
        got, want = H.against_sql(spark, lines.drop_recurring(docs.select("doc_id", "text"), **options), lines.lines_sql(**options), documents=docs)
        assert got == want


def test_templates_go_from_all_texts_but_the_first(spark):
    docs, texts = fixture(spark)
    rows = {r.doc_id: r for r in lines.drop_recurring(docs).collect()}
    assert len(rows) == len(texts)
    assert [("Posted on" in (r.text or "")) for i, r in sorted(rows.items()) if i < 12] == [True] + [False] * 11
    assert rows[5].text == "unique alphaf beta gamma\nanotherf line of its own" and rows[5].n_dropped == 1
    # The word in the middle varies, the rest is constant.
    assert [("Read more" in rows[i].text) for i in range(12, 20)] == [True] + [False] * 7
    assert rows[20].text == "All rights reserved." and rows[21].text == "x" and rows[22].text == "y\n"
    assert (rows[29].text, rows[29].n_lines) == (None, 0) and rows[30].text == "" and rows[31].text == "\n\n"
    # Exact copies of the first text keep what it keeps.
    assert rows[32].text == rows[33].text == texts[0]
    assert rows[34].text == "The cat sat here"


@pytest.mark.parametrize("ids", [[None] * 10, [7] * 10])
def test_rows_without_or_with_one_id(spark, ids):
    docs = H.documents(spark, [f"same line here\nown {'abcdefghij'[i]}" for i in range(10)], ids=ids)
    assert all("same line here" in r.text for r in lines.drop_recurring(docs).collect())


def test_empty_table_clashing_columns_and_long_texts(spark):
    assert lines.drop_recurring(H.documents(spark, [])).collect() == []
    long = "\n".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} end" for i in range(15_000)) + "\nbuy now"
    texts = [long] + [f"buy now\n{c}" for c in "abcdefghij"]
    docs = H.documents(spark, texts, ids=[100, *range(10)], schema=H.DOC + ", n_lines string, hi int, mask int", extra=("q", 1, 2))
    rows = {r.doc_id: r for r in lines.drop_recurring(docs).collect()}
    assert rows[100].text == long.removesuffix("\nbuy now") and rows[100].hi == 1 and rows[100].n_dropped == 1
    assert rows[0].text == "buy now\na" and rows[3].text == "d"
