"""Readers, writers and adapters on small inputs."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions.ids import normalize_doi
from corvane.plans import relational  # noqa: F401
from corvane.sources import bibliographic as bib
from corvane.sources import ingest, tables
from corvane.streaming import ledgers


def test_tables_keep_the_first_and_sort_nulls_last(spark, tmp_path):
    df = spark.createDataFrame([("f", "b", None, "W1", 1, "x"), ("f", "b", "k1", "W1", 2, "x"), ("f", None, "k", "W0", 3, "x"), ("e", "z", "k", "W2", 4, "x")], "case_id string, frame_id string, kind string, work_id string, year int, extra string").coalesce(1)
    path = str(tmp_path / "frames")
    tables.write_table("frames", df, path)
    back = tables.read_table(spark, "frames", path)
    assert back.columns == ["case_id", "frame_id", "kind", "work_id", "year"]
    got = [tuple(r) for r in back.orderBy(*tables.nulls_last("case_id", "frame_id", "work_id")).collect()]
    assert got == [("e", "z", "k", "W2", 4), ("f", "b", None, "W1", 1), ("f", None, "k", "W0", 3)]
    with pytest.raises(Exception, match="exists"):
        tables.write_table("frames", df, path)
    assert tables.content_hash(back) == tables.content_hash(back.repartition(5)) != tables.content_hash(back.limit(2))
    assert set(tables.SCHEMAS) == set(tables.KEYS) and len(tables.SCHEMAS) == 22


def test_manual_sheets(spark, tmp_path):
    ok = "work_id,ref_index,ref_text,doi,entered_by,entered_on\nW1,2,Second,,me,2026\nW1,1,First,DOI:10.1/A,me,2026\n"
    (tmp_path / "ok.csv").write_text(ok)
    r = tables.read_manual(spark, str(tmp_path / "ok.csv")).first()
    assert [(x.ref_index, x.doi, x.text) for x in r.refs] == [(1, "10.1/a", "First"), (2, None, "Second")]
    for bad in ("W1,2,Again,,me,2026\n", "W2,x,Text,,me,2026\n", "W2,1,,,me,2026\n"):
        (tmp_path / "bad.csv").write_text(ok + bad)
        with pytest.raises(Exception, match="twice|lacks"):
            tables.read_manual(spark, str(tmp_path / "bad.csv")).collect()


def test_audits(spark):
    refs = spark.createDataFrame([("correct",), ("correct",), ("wrong",)], "verdict string")
    works = spark.createDataFrame([("W1", "2"), ("W9", "1")], "work_id string, missed string")
    counts, missed, outside = tables.audit_counts(refs, works, spark.createDataFrame([("W1",)], "work_id string"), ["correct", "wrong"])
    assert {r.verdict: r.n for r in counts.collect()} == {"correct": 2, "wrong": 1} and missed.first()[0] == 3 and [r.work_id for r in outside.collect()] == ["W9"]
    with pytest.raises(Exception, match="unknown verdict"):
        tables.audit_counts(refs, works, works, ["correct"])[0].collect()


def test_archives(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "k1.bin").write_bytes(b"<p>x</p>")
    (docs / "k1.meta.json").write_text(json.dumps({"status": 200, "content_type": "text/html", "url": "u"}))
    (docs / "k2.meta.json").write_text(json.dumps({"status": 404, "content_type": None, "url": "v"}))
    got = {r.key: (r.status, None if r.content is None else bytes(r.content)) for r in tables.read_documents(spark, str(docs)).collect()}
    assert got == {"k1": (200, b"<p>x</p>"), "k2": (404, None)}
    pages = tmp_path / "json"
    pages.mkdir()
    (pages / "a.json").write_text(json.dumps({"status": 200, "body": {"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "publication_year": 1990}]}}))
    works = bib.works(bib.pages_to_works(tables.read_json_archive(spark, str(pages), bib.PAGE)), "openalex")
    assert [(r.work_id, r.doi, r.year, r.venue_id) for r in works.collect()] == [("W1", "10.1/x", 1990, None)]
    new = tables.append_new(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, v int").coalesce(1), "key")
    assert [(r.key, r.v) for r in new.collect()] == [("b", 2)]
    recorded = spark.createDataFrame([("k1.bin", "0"), ("gone", "0")], "path string, sha256 string")
    states = {r.path: r.state for r in tables.verify_artifacts(spark, str(docs), recorded).collect()}
    assert states["k1.bin"] == "changed" and states["gone"] == "missing" and states["k2.meta.json"] == "added"


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.createDataFrame([("openalex", "list", 0.5, datetime.datetime(2026, 1, 1, 3)), ("openalex", "list", 0.25, datetime.datetime(2026, 1, 1, 9)), ("x", "y", 1.0, datetime.datetime(2026, 1, 2))], "source string, kind string, usd double, time timestamp")
    tables.append_ledger(lines, path)
    schema = "source string, kind string, usd double, time timestamp"
    assert tables.read_ledger(spark, path, schema).count() == 3
    query = ledgers.daily_usage(ledgers.read_log(spark, path, schema)).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.source, str(r.day), r.calls, r.usd) for r in spark.table("usage").collect())
    assert got == [("openalex", "2026-01-01", 2, 0.75), ("x", "2026-01-02", 1, 1.0)]
    status = ledgers.latest_status(spark.createDataFrame([("D1", 1, "open"), ("D1", 5, "decided")], "id string, line int, status string"))
    assert status.first().status == "decided"
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.json").write_text("{not json\n")
    with pytest.raises(Exception):
        tables.read_ledger(spark, str(bad), schema).collect()


def test_sheets_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None)], "frame string, coverage double, n int")
    tables.write_sheet(df, str(tmp_path / "sheet"))
    with pytest.raises(Exception, match="exists"):
        tables.write_sheet(df, str(tmp_path / "sheet"))
    assert tables.markdown(df, ["frame", "coverage", "n"]).splitlines()[-1] == "| a | 50.0% | — |"


def test_nested_sources(spark):
    work = {
        "id": "https://openalex.org/W1", "display_name": "T", "publication_year": 1990, "type": "article", "cited_by_count": 3, "primary_location": {"source": {"id": "https://openalex.org/S5", "display_name": "V"}},
        "authorships": [{"author_position": "first", "author": {"id": "https://openalex.org/A1", "display_name": "Ann"}, "institutions": [{"id": "https://openalex.org/I2"}, {"id": "https://openalex.org/I1"}]}, {"author_position": "last", "author": {"id": None, "display_name": "?"}, "institutions": []}],
        "referenced_works": ["https://openalex.org/W9", "https://openalex.org/W9", "https://openalex.org/W8"],
    }
    df = spark.createDataFrame([(json.dumps(work),)], "j string").select(F.from_json("j", bib.WORK).alias("work"))
    assert tuple(bib.works(df, "s").first())[:6] == ("W1", None, "T", 1990, "S5", "V")
    assert [tuple(r) for r in bib.authorships(df).collect()] == [("W1", "A1", "first", ["I1", "I2"])]
    assert bib.authors(df).count() == 1
    assert sorted(r.citation_id for r in bib.citations(df).collect()) == ["W1:W8", "W1:W9"]
    assert bib.in_frame(df, ["W8"], None, 1990, 1995).count() == 1 and bib.in_frame(df, None, ["S4"], 1990, 1995).count() == 0 and bib.in_frame(df, None, None, 1991, 1995).count() == 0
    item = {"contexts": ["one", "two"], "intents": ["b", "a"], "isInfluential": None, "citingPaper": {"paperId": "p", "externalIds": {"DOI": "10.1/Z"}}}
    c = spark.createDataFrame([("W1", json.dumps(item))], "cited_work string, j string").select("cited_work", F.from_json("j", bib.CITATION).alias("item"))
    assert [(r.context_index, r.text, r.citing_doi, r.intents, r.is_influential) for r in bib.contexts(c, "s").orderBy("context_index").collect()] == [(0, "one", "10.1/z", ["a", "b"], False), (1, "two", "10.1/z", ["a", "b"], False)]
    entry = [{"DOI": "10.1/A", "year": "1990a", "volume": " "}, {"unstructured": "x", "year": "n.d."}]
    r = spark.createDataFrame([(json.dumps(entry),), ("[]",)], "j string").coalesce(1).select(bib.references(F.from_json("j", f"array<{bib.ENTRY}>")).alias("refs"))
    r = r.select("refs", bib.doiless(F.col("refs")).alias("places")).collect()
    assert [(x.doi, x.year, x.volume, x.text) for x in r[0].refs] == [("10.1/a", 1990, None, None), (None, None, None, "x")] and r[0].places == [1] and r[1].refs is None
    cand = [{"DOI": "10.1/A", "score": 9.0, "issued": {"date-parts": [[1990, 2]]}, "volume": "5", "page": "12-19", "container-title": ["J"], "title": ["T"], "type": "journal-article"}]
    got = spark.createDataFrame([(json.dumps(cand),)], "j string").select(bib.candidates(F.from_json("j", f"array<{bib.CANDIDATE}>")).alias("c")).first().c[0]
    assert (got.year, got.first_page, got.journal) == (1990, "12", "J")
    table = spark.createDataFrame([("W2", "10.1/a", "Alpha beta", 5), ("W1", "10.1/a", "Alpha", 9)], "work_id string, doi string, title string, cited_by_count int")
    keys = spark.createDataFrame([("doi:10.1/A",), ("10.1/a",), ("10.2/none",)], "doi string")
    assert [(r.doi, r.work_id) for r in bib.lookup(keys, table, "doi").collect()] == [("10.1/a", "W1")]
    assert [r.work_id for r in bib.title_search(table, "ALPHA").collect()] == ["W1", "W2"]


def page(spark, html, url="http://v/2001/toc.shtml", **more):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    for k, x in more.items():
        df = df.withColumn(k, F.lit(x))
    return df


def listed(df):
    return [(r.key, r.title, r.year, r.volume, r.issue, r.first_page, r.section, r.document_url, [(a.family, a.given) for a in r.authors]) for r in df.orderBy("url", "place").collect()]


def test_ojs(spark):
    html = '<title>Vol. 12 No. 3 (2001) | J</title><h1>Vol. 12 No. 3 (2001)</h1><h2>Articles</h2><div class="obj_article_summary"><a href="http://j/article/view/77">A &amp; B</a><div class="authors">Ann Lee, PhD and Bob Roe</div><div class="pages">015-20</div><a href="http://j/article/view/77/9">PDF</a></div><h2>Reviews</h2><div class="obj_article_summary"><a href="http://j/article/view/78">Second</a></div>'
    got = listed(ingest.list_works("ojs_v1", page(spark, html), 2000, 2005))
    assert got[0] == ("77", "A & B", 2001, "12", "3", "15", "Articles", "http://j/article/download/77/9", [("Lee", "Ann"), ("Roe", "Bob")])
    assert got[1][0] == "78" and got[1][6] == "Reviews" and got[1][7] is None
    assert listed(ingest.list_works("ojs_v1", page(spark, html), 2002, 2005)) == []
    with pytest.raises(ValueError):
        ingest.list_works("none", page(spark, html), 1, 2)


def test_bepress(spark):
    html = '<h1>Volume 4, Issue 2 (1999)</h1><h2>Essays</h2><div class="doc"><a href="http://b/cgi/viewcontent.cgi?article=1&amp;c=x">Download</a><a href="http://b/vol4/iss2/7">Title <i>x</i></a><span class="auth">Ann B. Lee</span></div>'
    assert listed(ingest.bepress(page(spark, html))) == [("v4-i2-7", "Title x", 1999, "4", "2", None, "Essays", "http://b/cgi/viewcontent.cgi?article=1&c=x", [("Lee", "Ann B.")])]


def test_cards(spark):
    html = '<article class="paper-card"><h4><a href="/v3/p1">One</a></h4>pp. 12-20<span class="contribName">A. Lee, Bob Roe, et al.</span></article><article class="paper-card">none</article>'
    assert listed(ingest.cards(page(spark, html, number=3), 2008, "http://a")) == [("v3/p1", "One", 2010, "3", None, "12", None, "http://a/v3/p1", [("Lee", "A."), ("Roe", "Bob")])]


def test_toc(spark):
    html = '<!-- <a name="old"> --><a name="Papers"></a><h3>Papers</h3><p>A long title</p><p>Ann Lee, M.D.</p><p>Page 3</p><a href="pdf/2001-v16n01-p003.pdf">PDF</a><p>Second title</p><a href="pdf/2001-v16n01-p009.pdf">PDF</a><a name="letters"></a><h3>Letters</h3><p>Third</p><p>Bob Roe</p><a href="pdf/2001-v16n01-p020.pdf">PDF</a>'
    got = listed(ingest.toc(page(spark, html)))
    assert [(g[0], g[1], g[5], g[6], g[8]) for g in got] == [
        ("2001-v16n01-p003", "A long title", "3", "papers", [("Lee", "Ann")]), ("2001-v16n01-p009", "Second title", "9", "papers", []), ("2001-v16n01-p020", "Third", "20", "letters", [("Roe", "Bob")]),
    ]
    assert got[0][7] == "http://v/2001/pdf/2001-v16n01-p003.pdf"


def test_eprints(spark):
    items = [{"eprintid": 5, "title": " A  b ", "date": "2001-05", "type": "article", "publication": "J", "volume": 3, "pagerange": " 7-9", "creators": [{"name": {"family": "Lee", "given": "A"}}], "documents": [{"format": "application/pdf", "files": [{"uri": "u.pdf"}]}]}, {"eprintid": 6, "publication": "Other"}, {"eprintid": 7, "title": "No journal"}]
    got = listed(ingest.eprints(page(spark, json.dumps(items)), aliases=["J"]))
    assert got[0] == ("5", "A b", 2001, "3", None, "7", "article", "u.pdf", [("Lee", "A")]) and [g[0] for g in got] == ["5", "7"]


def test_endnote(spark):
    export = ["%0 Journal Article", "%A Lee, Ann", "%A Roe, B.", "%T One", "%B Proc Things", "%D 1990", "%P 5-9", "%U http://v/all.pdf#page=3", "", "%0 Journal Article", "%T Two", "%B Proc Things", "%D 1990", "%U http://v/all.pdf#page=8", "%0 Book", "%T Other", "%B Elsewhere", "%D 1990", "%0 Journal Article", "%T Late", "%B Proc Things", "%D 1999"]
    df = spark.createDataFrame([("e", i, x) for i, x in enumerate(export)], "url string, place int, line string")
    got = listed(ingest.endnote(df, "proc things", 1995))
    assert [(g[1], g[5], g[7]) for g in got] == [("One", "5", "http://v/all.pdf#pages=3-7"), ("Two", None, "http://v/all.pdf#pages=8-")]
    assert got[0][8] == [("Lee", "Ann"), ("Roe", "B.")] and len(got[0][0]) == 12
    r = spark.createDataFrame([(got[0][7],), ("x.pdf",)], "u string").coalesce(1).select(ingest.split_pages(F.col("u")).alias("s")).collect()
    assert [tuple(x.s) for x in r] == [("http://v/all.pdf", 3, 7), ("x.pdf", None, None)]


def test_listed_tables(spark):
    html = '<h1>Volume 4, Issue 2 (1999)</h1><h2>Letters to us</h2><div class="doc"><a href="/vol4/iss2/7">T</a><span class="auth">Ann Lee, Bob Roe, Cy Poe</span></div><div class="doc"><a href="/vol4/iss2/7">Again</a></div>'
    out = ingest.listed(ingest.bepress(page(spark, html)), "ven", "Venue", {"essays": "article"}, [("letter", "letter")], "other")
    assert [(r.work_id, r.title, r.type) for r in out["works"].collect()] == [("X:ven:v4-i2-7", "T", "letter")]
    assert sorted((r.author_id, r.position) for r in out["authorships"].collect()) == [("name:lee:a", "first"), ("name:poe:c", "last"), ("name:roe:b", "middle")]
    assert out["ingested"].first().first_author == "lee" and out["authors"].count() == 3
    assert normalize_doi is not None
    links = ingest.issue_links(page(spark, 'href="/b" href="/a" href="/b"'), 'href="(/[^"]+)"')
    assert [r.link for r in links.collect()] == ["/b", "/a"]
