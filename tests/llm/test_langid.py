import json

import numpy as np
import pytest

from . import helpers as H
from jobtide.llm import langid

PAGE = "page_id long, url string, html string"


def test_text_of_a_page():
    page = "<html><head><title>T &amp; t</title><script>var x='<p>no</p>';</script><style>p{}</style></head><!-- no > --><p>yes<br>it"
    assert langid.page_text(page).split() == ["T", "&", "t", "yes", "it"]
    assert langid.page_text("a <b").strip() == "a" and langid.page_text("") == "" and langid.page_text("x <!-- open").strip() == "x"
    assert langid.page_text("<script>" * 3000 + "x").strip() == ""


def test_declared_language():
    far = "<html " + "data-x='y' " * 5_000 + "LANG = 'De-at'>"
    assert langid.declared_language(far) == "de" and langid.declared_language("İ<HTML lang=fr") == "fr"
    assert langid.declared_language("<htmlx lang='de'><html><html lang=\"es\">") == "es"
    assert langid.declared_language("<html>lang='de'") == langid.declared_language("") == langid.declared_language("<html " * 100_000) == ""


def test_a_rare_language_is_not_left_out(spark):
    docs = spark.createDataFrame([("the cat and the dog of the house", "en")] * 30 + [("ein zwei drei vier fünf und sechs", "de")], "text string, lang string")
    assert langid.language_model(docs)[0] == ["de", "en"]
    got = langid.identify(spark.createDataFrame([(1, None, "drei vier fünf")], PAGE), docs).first()
    assert got.text_lang == "de"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_text_evidence_on_held_out_documents(spark, docs):
    languages, table = langid.language_model(docs.where("doc_id % 2 = 0"))
    assert languages == ["de", "en", "es", "fr"]
    pages = docs.where("doc_id % 2 = 1 and n_chars > 40").selectExpr("doc_id as page_id", "'' as url", "text as html", "lang")
    got = {r.page_id: r.text_lang for r in langid.identify(pages.drop("lang"), docs.where("doc_id % 2 = 0")).collect()}
    truth = {r.page_id: r.lang for r in pages.collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.97


def test_evidence_is_fused_as_written_out(spark, docs):
    """A plain loop over a few pages gives the same posteriors."""
    samples = {r.lang: r.text[:200] for r in docs.where("n_chars > 300").collect()}
    rows = []
    for i in range(40):
        lang = ["de", "en", "fr", "en"][i % 4]
        text = samples[lang][: 30 + i] if i % 5 else ""
        html = f'<html lang="{lang if i % 7 else "EN-us"}"><p>{text}</p></html>' if i % 6 else f"<p>{text}</p>"
        host = ["www.a.example.de", "b.example.de", "c.test", "d.c.test"][(i // 4) % 4]
        rows.append((i, f"https://u@{host}:80/x?y={i}" if i % 9 else None, html))
    languages, table = langid.language_model(docs)
    df = langid.identify(spark.createDataFrame(rows, PAGE), docs)
    got = {r.page_id: r for r in df.collect()}
    k, pages = 5.0, []
    for page_id, url, html in rows:
        raw = langid.page_text(html).encode()
        like = (langid.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) @ table.T / 3.0)[0].astype(float)
        soft = np.exp(like - like.max())
        host = url.split("@")[1].split(":")[0] if url else ""
        pages.append((page_id, host, ".".join(host.split(".")[-2:]) if "." in host else "", host.split(".")[-1], langid.declared_language(html), like, soft / soft.sum()))
    total, n = sum(p[6] for p in pages), len(pages)
    share = (total + 1) / (n + len(languages))
    for page_id, host, domain, suffix, declared, like, soft in pages:
        same = lambda at, value: [p[6] for p in pages if p[at] == value]  # noqa: B023, E731
        at_domain, at_host = same(2, domain), same(1, host)
        up = (sum(at_domain) + k * share) / (len(at_domain) + k)
        prior = (sum(at_host) - soft + k * up) / (len(at_host) - 1 + k)
        fused = like + np.log(np.maximum(prior, 1e-12))
        for at, value in ((4, declared), (3, suffix)):
            marks = same(at, value)
            fused += np.log((np.maximum(sum(marks) - soft, 0) + k * len(marks) / n) / (np.maximum(total - soft, 0) + k))
        p = np.exp(fused - fused.max())
        p /= p.sum()
        assert [got[page_id].posterior[x] for x in languages] == pytest.approx(p.tolist(), abs=2e-6), page_id
        assert (got[page_id].host, got[page_id].declared, got[page_id].lang) == (host, declared, languages[int(p.round(6).argmax())])


def test_odd_pages_and_empty_tables(spark, docs):
    rows = [(1, None, None), (2, "", ""), (None, "not a url", "<html>"), (4, "http://h.example.com", "x " * 200_000), (4, "http://h.example.com", "x " * 200_000)]
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], PAGE + ", soft string, host int")
    got = langid.identify(pages, docs).collect()
    assert len(got) == 5 and all(r.lang in ("de", "en", "es", "fr") and 0 < r.confidence <= 1 for r in got)
    assert langid.identify(pages.limit(0), docs).collect() == []
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_declared_language_decides_a_short_text(spark, docs):
    pages = [(i, f"https://x{i % 3}.example.org/", f'<html lang="fr"><p>{t}</p>') for i, t in enumerate(r.text for r in docs.where("lang = 'fr'").limit(60).collect())]
    pages += [(100 + i, "https://y.example.com/", f'<html lang="en"><p>{t}</p>') for i, t in enumerate(r.text for r in docs.where("lang = 'en'").limit(60).collect())]
    pages += [(500, "https://x0.example.org/", '<html lang="fr"><p>a</p>'), (501, "https://y.example.com/", '<html lang="en"><p>a</p>')]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(pages, PAGE), docs).collect()}
    assert (got[500], got[501]) == ("fr", "en")
    assert json.dumps(sorted(set(got.values()))) == '["en", "fr"]'
