"""Operators on small cases: URLs, pages, snapshots, search, values, caches, citations, enrichment, lake, stream."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

URLS = [
    ("https://h.example/a/b/", "https://h.example/a/b", False),
    ("https://h.example/", "https://h.example/", False),
    ("https://h.example", "https://h.example", False),
    ("https://h.example/a///", "https://h.example/a", False),
    ("https://h.example/a#top", "https://h.example/a", False),
    ("HTTPS://H.Example/A/b", "https://h.example/A/b", False),
    ("http://h.example:80/a", "http://h.example/a", False),
    ("https://h.example:443/a", "https://h.example/a", False),
    ("https://h.example:8443/a", "https://h.example:8443/a", False),
    ("http://h.example:443/a", "http://h.example:443/a", False),
    ("https://h.example/a?utm_source=x&utm_medium=y", "https://h.example/a", False),
    ("https://h.example/a?gclid=1&fbclid=2&_ga=3&portal_form_id=4&q=5", "https://h.example/a?q=5", False),
    ("https://h.example/a?b=2&a=1&b=1", "https://h.example/a?a=1&b=2&b=1", False),
    ("https://h.example/a?q=a b", "https://h.example/a?q=a+b", False),
    ("https://h.example/a?q=%C3%A9*~", "https://h.example/a?q=%C3%A9%2A~", False),
    ("https://h.example/a?", "https://h.example/a?", False),
    ("https://h.example/a?flag", "https://h.example/a?flag=", False),
    ("https://h.example/a/@@view", "https://h.example/a/@@view", True),
    ("https://h.example/++theme++x/y.css", "https://h.example/++theme++x/y.css", True),
    ("ftp://h.example/a", None, False),
    ("mailto:a@h.example", None, False),
    ("/only/a/path", None, False),
    ("", None, False),
    (None, None, False),
    ("https://h.example/%zz", None, False),
    ("https://h.example/a\nb", None, False),
]


def test_canonical_urls(spark):
    from sitelake.operators.discovery import canonicalize_urls

    rows = canonicalize_urls(spark.createDataFrame([(u,) for u, _, _ in URLS], "url string")).collect()
    got = {r.url: (r.canonical, r.excluded, r.error) for r in rows}
    for url, want, excluded in URLS:
        assert got[url] == (want, excluded, want is None), url
    again = canonicalize_urls(spark.createDataFrame([(w,) for _, w, _ in URLS if w], "url string")).filter("url <> canonical")
    assert again.isEmpty(), "a canonical URL is its own canonical form"


def test_copies(spark):
    from sitelake.functions.urls import is_copy

    cases = {"/a/copy_of_b": True, "copy2_of_x": True, "/a/copy12_of": True, "/a/mycopy_of": False, "/a/copy-of": False, "https://h.example/copy_of_a": True, "https://h.example/a?x=/copy_of": False, None: False}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", is_copy(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_hierarchy_and_resolution(spark):
    from sitelake.functions import urls as U

    p = "https://h.example/top/"
    cases = {"https://h.example/top": (0, "", ""), "https://h.example/top/a": (1, "https://h.example/top", "a"), "https://h.example/top/a/b/": (2, "https://h.example/top/a", "a/b"), "https://h.example/topper": (0, "", "https://h.example/topper")}
    u, q = F.col("u"), F.lit(p)
    rows = spark.createDataFrame([(x,) for x in cases], "u string").select("u", U.depth(u, q).alias("d"), U.parent_url(u, q).alias("p"), U.relative_path(u, q).alias("r")).collect()
    assert {r.u: (r.d, r.p, r.r) for r in rows} == cases
    base = "https://h.example/a/b?x=1#y"
    links = {"c": "https://h.example/a/c", "../c/": "https://h.example/c/", "/c": "https://h.example/c", "//o.example/c": "https://o.example/c", "?z": "https://h.example/a/b?z", "#t": "https://h.example/a/b?x=1#t", "http://o.example": "http://o.example", "./": "https://h.example/a/", "../../../c": "https://h.example/c", "c?d=/../e": "https://h.example/a/c?d=/../e"}
    rows = spark.createDataFrame([(x,) for x in links], "u string").select("u", U.resolve(F.lit(base), u).alias("r")).collect()
    assert {r.u: r.r for r in rows} == links


def test_scope_and_robots(spark):
    from sitelake.operators import discovery as D

    sitemap = spark.createDataFrame([("https://h.example/en/a",), ("https://h.example/de",), ("https://h.example/en/@@x",), ("ftp://x",), ("https://o.example/en",)], "loc string")
    scopes = spark.createDataFrame([("h.example", "https://h.example/en")], "host string, prefix string")
    found = D.discover_in_scope(sitemap, scopes)
    assert {r["loc"]: r.status for r in found.collect()} == {"https://h.example/en/a": "in_scope", "https://h.example/de": "out_of_scope", "https://h.example/en/@@x": "excluded", "ftp://x": "invalid", "https://o.example/en": "out_of_scope"}
    D.require_in_scope(D.scope_counts(found))
    with pytest.raises(ValueError):
        D.require_in_scope(D.scope_counts(found.filter("status <> 'in_scope'")))
    rules = spark.createDataFrame([("h.example", "*", False, "/p"), ("h.example", "*", True, "/p/ok"), ("h.example", "*", False, "/*.pdf$"), ("o.example", "*", False, "/"), ("o.example", "Bot", True, "/")], "host string, agent string, allow boolean, path_pattern string")
    cases = {"https://h.example/p/x": False, "https://h.example/p/ok/1": True, "https://h.example/q": True, "https://h.example/a.pdf": False, "https://h.example/a.pdf2": True, "https://o.example/z": True, "https://none.example/": True}
    got = D.robots_filter(spark.createDataFrame([(u,) for u in cases], "url string"), rules, "bot").collect()
    assert {r.url: r.allowed for r in got} == cases


HTML = """<!DOCTYPE html><html lang=" pt "><head><title>Page &amp; more — Site — x</title><meta name="description" content=""><meta name="description" content=" First ">
<meta property="og:description" content="og"><meta name="keywords" content="a, b,,c"><meta name="dc.DATE" content="2024-05-06T10:00:00-03:00"><meta property="og:updated_time" content="never"></head><body>
<div id="portal-breadcrumbs"><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/s">Section</a></li><li><a href="/s/t">Topic</a></li><li class="active">Here</li></ol></div>
<nav><a href="/nav">nav</a></nav><div id="tags"><a href="/t">#one</a></div>
<main><nav><p>gone <a href="/gone">g</a></p></nav><h1>Title</h1><p>Some   text<p>More <b>bold</b><ul><li><p>inner</p><li>second <a href="files/a.PDF?x=1">a file</a></ul><script>var x = "</p>";</script>
<div class="portlet"><p>also gone</p></div><a href="sub/page">child</a><a href="sub/other">same child</a><a href="mailto:x">m</a><a href="#f">f</a><a href="https://o.example/x#f" title="t"></a></main></body></html>"""


def test_extraction(spark):
    from sitelake.operators import extract as E

    pages = spark.createDataFrame([("https://h.example/base", HTML), ("https://h.example/bad", "<p>cut <a href=x"), ("https://h.example/null", None)], "url string, html string")
    out = E.extract_pages(pages).cache()
    p, bad, null = (out.filter(F.col("url").endswith(x)).first() for x in ("base", "bad", "null"))
    assert (p.lang, p.title, p.description, p.tags) == ("pt", "Page & more", "First", ["a", "b", "c", "one"])
    assert p.path_titles == ["Section", "Topic", "Here"] and p.section == "Topic" and p.warnings == []
    assert p.full_text == "Title\n\nSome text\n\nMore bold\n\ninner\n\ninner\n\nsecond a file"
    assert (p.content_length, p.content_date, p.page_updated_at) == (len(p.full_text), "2024-05-06", None)
    assert bad.full_text == "cut" and bad.warnings == ["breadcrumb not found"] and null.full_text == ""
    scopes = spark.createDataFrame([("h.example", "https://h.example/s")], "host string, prefix string")
    edges = {(r.dst, r.title, r.kind) for r in E.link_edges(out, scopes).filter("src LIKE '%base'").collect()}
    assert ("https://h.example/s", "Section", "internal") in edges and ("https://o.example/x", "t", "external") in edges
    assert ("https://h.example/sub/page", "child", "external") in edges and not any("gone" in e[0] or "mailto" in e[0] for e in edges)
    doc = E.document_links(out).collect()
    assert [(d.url, d.type, d.title, d.context) for d in doc] == [("https://h.example/files/a.PDF?x=1", "pdf", "a file", "second a file")]


def test_children_are_one_for_each_first_segment(spark):
    from sitelake.operators import extract as E

    anchors = [{"href": h, "title": h, "context": ""} for h in ("/b/x/1", "/b/x/2", "/b/y", "/b", "/b/", "/c")]
    df = spark.createDataFrame([("https://h.example/b", anchors)], "url string, anchors array<struct<href:string,title:string,context:string>>")
    assert sorted((r.dst, r.kind) for r in E.link_edges(df).collect()) == [("https://h.example/b", "external"), ("https://h.example/b/", "external"), ("https://h.example/b/x/1", "child"), ("https://h.example/b/y", "child"), ("https://h.example/c", "external")]


def test_page_types(spark):
    from sitelake.operators.quality import classify_page_type

    para = "x" * 160
    rows = [
        (50, "", 0, 2, 0, 0, 200, None, "empty"), (50, "", 0, 3, 30, 0, 200, None, "landing"), (50, "", 0, 3, 20, 0, 200, None, "article"), (99, "", 0, 0, 0, 1, 200, None, "article"),
        (800, f"{para}\n\n{para}", 4, 0, 0, 4, 200, None, "listing"), (800, "", 4, 0, 0, 3, 200, None, "article"), (800, f"{para}\n{para}\n{para}", 8, 0, 0, 0, 200, None, "article"),
        (50, "", 0, 0, 0, 0, 399, None, "redirect"), (50, "", 0, 0, 0, 0, 400, None, "empty"), (900, "", 0, 0, 0, 0, 200, "http://x", "redirect"), (900, "", 0, 0, 0, 0, 200, "", "article"), (499, "", 0, 0, 250, 0, None, None, "landing"),
    ]
    df = spark.createDataFrame(rows, "content_length int, full_text string, n_children int, n_internal int, link_title_bytes int, n_documents int, http_status int, redirected_from string, want string")
    assert classify_page_type(df).filter("want <> page_type").collect() == []


def test_suspicion_and_outcomes(spark):
    from sitelake.operators import quality as Q

    fetches = spark.createDataFrame([("a", "ACCESS denied", 9000, {}), ("b", "ok", 499, {}), ("c", "ok", 499, {}), ("d", "ok", 9000, {"cf-ray": "1"}), ("e", "ok", 9000, {"CF-RAY": "1", "x-generator": "Plone"}), ("f", None, 500, None)], "url string, title string, body_bytes int, headers map<string,string>")
    prior = spark.createDataFrame([("b", 10), ("c", 0), ("f", 5)], "canonical_url string, content_length int")
    got = {r.url: r.reason for r in Q.suspicious_responses(fetches, prior).collect()}
    assert got == {"a": "title_pattern", "b": "body_too_small", "c": None, "d": "waf_headers", "e": None, "f": None}
    now = datetime(2024, 1, 1, 12)
    log = spark.createDataFrame([(1, 429, None, "120"), (2, 404, None, "-5"), (3, None, "read: connection RESET by peer", None), (4, None, "unsupported", "x"), (5, 200, None, "Mon, 01 Jan 2024 12:00:30 GMT"), (6, 503, None, "Mon, 01 Jan 2024 11:00:00 GMT")], "i int, status int, error string, retry_after string")
    got = {r.i: (r.outcome, r.retry_after_s, r.long_pause) for r in Q.fetch_outcomes(log, now).collect()}
    assert got == {1: ("transient", 120, True), 2: ("permanent", 0, False), 3: ("transient", None, False), 4: ("permanent", None, False), 5: ("ok", 30, False), 6: ("transient", 0, False)}


def test_snapshots(spark):
    from sitelake.operators import snapshots as S

    now = datetime(2024, 3, 1)
    prior = spark.createDataFrame([("a", "1", "sa", None), ("b", "2", "sb", datetime(2024, 2, 20)), ("c", "3", "sc", datetime(2024, 1, 1)), ("d", "", "sd", None)], "canonical_url string, content_hash string, mini_summary string, stale_since timestamp")
    current = spark.createDataFrame([("a", "1", 200), ("b", "9", 200), ("d", "", 200), ("e", "5", 200), ("f", "6", 500), ("g", None, 304)], "canonical_url string, content_hash string, status int")
    assert {r.canonical_url: r.change for r in S.classify_changes(current, prior).collect()} == {"a": "unchanged_hash", "b": "updated", "d": "updated", "e": "new", "f": "failed", "g": "unchanged_304"}
    carried = {r.canonical_url: (r.mini_summary, r.stale_since) for r in S.carry_forward_summaries(current, prior).collect()}
    assert carried["a"] == ("sa", None) and carried["b"] == (None, None) and carried["d"] == (None, None)
    marked = S.mark_stale(prior, spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("d",)], "url string"), now)
    stamps = {r.canonical_url: r.stale_since for r in marked.collect()}
    assert stamps == {"a": None, "b": datetime(2024, 2, 20), "c": datetime(2024, 1, 1), "d": None}
    kept, removed = S.purge_stale(marked, now, 30)
    assert kept.count() == 4 and removed.isEmpty(), "nothing goes without confirmation"
    assert [r.canonical_url for r in S.purge_stale(marked, now, 30, confirm=True)[1].collect()] == ["c"]
    pages = spark.createDataFrame([("long/url", "h"), ("url", "h"), ("abc", "h"), ("x", ""), ("y", "")], "url string, content_hash string")
    assert {r.url: r.canonical_of for r in S.dedup_content(pages).collect()} == {"long/url": "abc", "url": "abc", "abc": None, "x": None, "y": None}


def test_merge_twice_is_once(spark):
    from sitelake.operators.snapshots import merge_pages

    p = "https://h.example"
    snap = spark.createDataFrame([(f"{p}/a", 1), (f"{p}/b", 1)], "url string, v int")
    up = spark.createDataFrame([(f"{p}/b", 2), (f"{p}/c", 2), (f"{p}/../d", 2), (f"{p}//e", 2), (f"{p}/.f", 2), ("https://o.example/g", 2)], "url string, v int")
    gone = spark.createDataFrame([(f"{p}/a",)], "url string")
    once, rejects = merge_pages(snap, up, gone, p)
    twice, _ = merge_pages(once, up, gone, p)
    want = {(f"{p}/b", 2), (f"{p}/c", 2)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    assert rejects.count() == 4


def test_search(spark):
    from sitelake.operators import search as S

    rows = [(f"u{i}", "Título comum" if i % 2 else "", None, f"texto comum número {i} " + "raro " * (i == 7), "A" if i < 10 else "b") for i in range(20)]
    pages = spark.createDataFrame(rows, "url string, title string, mini_summary string, full_text string, section string")
    postings, lengths = S.build_postings(pages)
    queries = spark.createDataFrame([(1, "RARO", None, 10), (2, "titulo:comum*", "a", 3), (3, '"-+*()', None, 10), (4, "raro ausente", None, 10), (5, "comum", None, 99), (6, "comum", "B", None)], "query_id int, query string, section string, k int")
    hits = S.section_search(queries, postings, lengths, pages).collect()
    by = {q: [h.url for h in sorted(hits, key=lambda h: h["rank"]) if h.query_id == q] for q in range(1, 7)}
    assert by[1] == ["u7"] and by[3] == [] and by[4] == [] and len(by[5]) == 20 and len(by[6]) == 10
    assert len(by[2]) == 3 and all(int(u[1:]) % 2 and int(u[1:]) < 10 for u in by[2])
    assert {h.total_found for h in hits if h.query_id == 2} == {10}
    again, _ = S.build_postings(pages.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, postings.collect()))


def test_values(spark):
    from sitelake.operators import values as V

    text = "0,01 e 999.999.999,99 ou R$ 1.234,56; 12345,67 não, 1.23,45 não; 12,345 não. 1.000,00,"
    docs = spark.createDataFrame([(1, 1, text), (2, 1, None)], "doc_id int, pages int, text string")
    got = {r.doc_id: r for r in V.value_summary(docs).collect()}
    assert got[1].money[:3] == [Decimal("0.01"), Decimal("999999999.99"), Decimal("1234.56")] and got[1].money[-1] == Decimal("1000.00")
    assert got[2].money == [] and got[2].total == 0 and got[2].text_length == 0
    sources = spark.createDataFrame([(1, Decimal(5), 2, True), (1, Decimal(7), 3, False), (1, Decimal(0), 4, True), (2, None, None, True)], "query_id int, total decimal(18,2), value_count int, success boolean")
    assert {r.query_id: (r.total, r.value_count) for r in V.aggregate_sources(sources).collect()} == {1: (Decimal(5), 6), 2: (None, None)}
    asked = spark.createDataFrame([("Quanto custou?",), ("quem",), (None,)], "query string")
    assert [r.needs_extraction for r in V.needs_extraction(asked).collect()] == [True, False, False]


def test_cache(spark):
    from sitelake.operators import cacheops as C

    t = datetime(2024, 1, 1)
    entries = spark.createDataFrame([(1, "k", t, 60), (2, "k", t + timedelta(hours=1), 60), (3, "z", t, 60)], "entry_id int, key string, set_at timestamp, ttl_s int")
    requests = spark.createDataFrame([(1, "k", t - timedelta(seconds=1)), (2, "k", t), (3, "k", t + timedelta(seconds=60)), (4, "k", t + timedelta(seconds=61)), (5, "k", t + timedelta(hours=1, seconds=5)), (6, "q", t)], "request_id int, key string, ts timestamp")
    got = {r.request_id: (r.status, r.age_s) for r in C.cache_lookup(requests, entries).collect()}
    assert got == {1: ("miss", None), 2: ("hit", 0.0), 3: ("hit", 60.0), 4: ("expired", 61.0), 5: ("hit", 5.0), 6: ("miss", None)}
    log = spark.createDataFrame([], "op string, ok boolean, bytes long, value double")
    empty = C.ops_metrics(log).first()
    assert (empty.hit_rate, empty.success_rate, empty.total_bytes) == (0.0, 0.0, 0)


def test_citations(spark):
    from sitelake.operators import citations as C

    text = "## 1. One\n**Seção:** S\n**URL:** http://a\n\n## 2. Two\nnothing\n**URL:** http://b\n"
    page = "# Page\n**URL:** http://a\n\n## Breadcrumb\nHome > X\n\nmore"
    m = spark.createDataFrame([(1, 0, text), (1, 1, page), (2, 0, page), (3, 0, None)], "conv_id int, turn int, text string")
    cited = C.extract_citations(m)
    assert sorted(map(tuple, cited.collect())) == [(1, 0, 0, "One", "S", "http://a"), (1, 0, 1, "Two", "", "http://b"), (1, 1, 0, "Page", "Home > X", "http://a"), (2, 0, 0, "Page", "Home > X", "http://a")]
    numbers = C.number_citations(cited)
    assert sorted((r.conv_id, r.id, r.title) for r in numbers.collect()) == [(1, 1, "One"), (1, 2, "Two"), (2, 1, "Page")]
    answer = spark.createDataFrame([(1, 2, "See [x](http://b) or [y](http://no), [x](http://b) [z](http://a)!"), (3, 1, "[x](http://b)"), (2, 1, "none")], "conv_id int, turn int, text string")
    assert {r.conv_id: r.text for r in C.rewrite_inline_links(answer, numbers).collect()} == {1: "See x^2 or [y](http://no), x^2 z^1!", 3: "[x](http://b)", 2: "none"}
    bracketed = C.rewrite_inline_links(answer, numbers, bracketed=True)
    marks = C.parse_citation_markers(bracketed).collect()
    texts = {r.conv_id: r.text for r in bracketed.collect()}
    assert [(x.label, x.number) for x in sorted(marks, key=lambda x: x.pos)] == [("x", 2), ("x", 2), ("z", 1)]
    assert all(texts[x.conv_id][x.start : x.end] == f"[{x.label}]^{x.number}" for x in marks)


def test_enrichment(spark):
    from sitelake.operators import enrich as E

    def fn(prompt):
        if "bad" in prompt:
            raise TimeoutError
        return f"  {prompt * 200} ", 3, 4

    prompts = spark.createDataFrame([("u", "good"), ("v", "bad")], "url string, prompt string")
    results = E.enrich_batches(prompts, fn, concurrency=2)
    got = {r.url: r for r in results.collect()}
    assert len(got["u"].text) == 500 and got["u"].tokens_out == 4 and got["v"].error_class == "TimeoutError"
    one, reasons = E.summarize_report(results, prompts.limit(1))
    assert (one.first().n_total, one.first().n_failed) == (3, 1) and [tuple(r) for r in reasons.collect()] == [("TimeoutError", 1)]
    assert E.enrich_batches(prompts.limit(0), fn).collect() == []


def test_lake(spark, tmp_path):
    from sitelake.operators import lake as L

    df = spark.createDataFrame([("x", 2024, 1, 5.0), ("y", 2024, 2, 7.0), ("x", 2023, 1, 1.0)], "k string, year int, month int, value double")
    meta = {"source_url": "u", "source_hash": "h", "extractor_version": "1"}
    t = datetime(2024, 1, 1)
    L.write_lake(df, str(tmp_path), "c", ["year", "month"], meta, t, t + timedelta(days=10))
    again = df.filter("year = 2024").withColumn("value", F.col("value") * 2)
    manifest = L.write_lake(again, str(tmp_path), "c", ["year", "month"], meta, t + timedelta(days=1), t + timedelta(days=20))
    data = L.read_lake(spark, str(tmp_path), "c")[0]
    assert data.agg(F.sum("value")).first()[0] == 25.0, "only the partitions of the second write were replaced"
    wanted = spark.createDataFrame([("c", "year=2024/month=1"), ("c", "year=2023/month=1"), ("c", "year=2022/month=1")], "category string, partition_path string")
    states = L.coverage(wanted, manifest, t + timedelta(days=15))
    assert {r.partition_path: r.state for r in states.collect()} == {"year=2024/month=1": "fresh", "year=2023/month=1": "expired", "year=2022/month=1": "missing"}
    assert L.coverage_report(states).first().coverage == "hit_partial"
    assert L.coverage_report(L.coverage(wanted, manifest, t, force=True)).first().coverage == "miss"
    days = spark.createDataFrame([(date(2024, 1, 31),), (date(2024, 2, 1),), (date(2024, 2, 29),)], "d date")
    assert L.filter_period(days, "d", year=2024, month=2).count() == 2 and L.filter_period(days, "d", end=date(2024, 2, 1)).count() == 2


def test_sources(spark, tmp_path):
    import gzip

    from sitelake.sources import io

    (tmp_path / "s").mkdir()
    with gzip.open(tmp_path / "s/sitemap.xml.gz", "wt") as f:
        f.write("<urlset><url><loc> http://a?x=1&amp;y </loc><lastmod>2024-01-02</lastmod></url><url><loc></loc></url><url><loc>http://b</loc><lastmod>soon</lastmod></url><url><loc>http://c</loc><lastmod>2024-01-02T03:04:05+01:00</lastmod></url></urlset>")
    got = {r["loc"]: r.lastmod for r in io.read_sitemap(spark, str(tmp_path / "s")).collect()}
    assert got == {"http://a?x=1&y": datetime(2024, 1, 2), "http://b": None, "http://c": datetime(2024, 1, 2, 2, 4, 5)}
    (tmp_path / "c.csv").write_text("nome,Valor Pago,valor2\na,1.5,9\nb,2.5,9\n")
    assert tuple(io.csv_profile(io.read_csv(spark, str(tmp_path / "c.csv"))).first()) == (2, 3, ["nome", "Valor Pago", "valor2"], 4.0)
    with pytest.raises(ValueError):
        io.save_extract(spark.range(0), str(tmp_path), "none")
    (tmp_path / "pages/a").mkdir(parents=True)
    (tmp_path / "pages/a/page.json").write_text('{"schema_version": 2,\n "url": "http://a", "links": {"children": [{"title": "t", "url": "u"}]}}')
    assert io.load_pages(spark, str(tmp_path / "pages"), "json").first().links.children[0].title == "t"


def test_breaker_stream_equals_its_replay(spark, tmp_path):
    from sitelake.streaming import breaker as B

    cfg, t = B.Breaker(most_failures=3, pause=timedelta(minutes=5), most_after_pause=2), datetime(2024, 1, 1)
    plan = {"a": "FFFF" + "F" * 8, "b": "FFSFFFSSFFF", "c": "SSSS"}
    rows = [(h, t + timedelta(minutes=i), i, s == "F") for h, line in plan.items() for i, s in enumerate(line)]
    schema = "host string, ts timestamp, seq int, failed boolean"
    log = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, B.failure_breaker_batch(log, cfg).collect()))
    assert [(x[0], x[2], x[3]) for x in want if x[0] == "a"] == [("a", "closed", "open"), ("a", "open", "half_open"), ("a", "half_open", "aborted")]
    for k, part in enumerate((log.filter("seq < 4"), log.filter("seq >= 4"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = B.failure_breaker_stream(stream, cfg).writeStream.format("memory").queryName("moves").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT * FROM moves").collect())) == want


def test_references_that_a_title_cuts_stay_in_the_queries(spark, tmp_path):
    import __spark_entry__

    duckdb = pytest.importorskip("duckdb")
    titles = ["and&amp;&amp", "a&am", "a&", "a &lt b", "x&amp;amp", "x&amp;lt;y", "&quot;q&quot; it&#x27;s", "it&#x27", "a&b&c;", "&amp;&amp;&amp;"]
    cut = lambda t: f"<html lang=\"en\"><head><title>{t}</title></head><body><nav><a href='/x'>x</a></nav><article><h1>{t}</h1>\n<p>one &amp; two&amp;</p>\n<p>{t}</p></article></body></html>"
    pages = [(i, f"https://h.example/en/{i}", cut(t)) for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("extract_pages", "page_text"):
        r = con.execute(__spark_entry__.oracle_sql()[name])
        columns = [x[0] for x in r.description]
        got = __spark_entry__.queries()[name](spark, str(tmp_path)).select(columns).collect()
        assert sorted(map(tuple, got)) == sorted(r.fetchall()), name


def test_references_without_a_semicolon():
    from sitelake.operators.extract import page_facts

    html = "<title>a&amp</title><body><p>&notit; &copy; &#65; &#65 &eacute</p><a href='/x?a=1&copy=2&amp;b=3'>t</a>"
    assert page_facts(html)["raw_title"] == "a&" and page_facts(html)["blocks"][0].endswith("é")
    closed = page_facts(html, open_references=False)
    assert closed["raw_title"] == "a&amp" and closed["blocks"][0] == "&notit; © A &#65 &eacute"
    assert closed["anchors"][0]["href"] == "/x?a=1&copy=2&b=3"


def test_links_of_one_block_take_time_in_proportion():
    import time

    from sitelake.operators.extract import page_facts

    start = time.perf_counter()
    facts = page_facts("<div>" + "<a href='x.pdf'>link</a> some text " * 20_000 + "</div>")
    page_facts("<div>" * 20_000 + "x" + "</span>" * 20_000 + "<p>a" * 20_000)
    assert time.perf_counter() - start < 10
    assert len(facts["anchors"]) == 20_000 and {len(a["context"]) for a in facts["anchors"]} == {200}


def test_priors_that_repeat_urls(spark):
    from sitelake.operators import snapshots as S

    current = spark.createDataFrame([("u", "b", 200, None, None)], "canonical_url string, content_hash string, status int, mini_summary string, stale_since timestamp")
    prior = spark.createDataFrame([("u", "a", "x", 1), ("u", "b", "y", 2), ("u", None, None, 0)], "canonical_url string, content_hash string, mini_summary string, extracted_at int")
    assert [r.change for r in S.classify_changes(current, prior).collect()] == ["unchanged_hash"]
    assert [r.mini_summary for r in S.carry_forward_summaries(current, prior).collect()] == ["y"]
    seen = spark.createDataFrame([("u", 3)], "loc string, lastmod int")
    assert [r.skip for r in S.recrawl_candidates(seen, prior).collect()] == [False]


def test_the_last_update_wins(spark):
    from sitelake.operators.snapshots import merge_pages

    p = "https://h.example"
    snap = spark.createDataFrame([(f"{p}/a", "old", 0)], "url string, v string, n int")
    up = spark.createDataFrame([(f"{p}/a", "late", 2), (f"{p}/a", "early", 1), (f"{p}/b", "x", 1), (f"{p}/b", "y", 1)], "url string, v string, n int")
    gone = snap.limit(0).select("url")
    for one in (up, up.orderBy("v"), up.repartition(4)):
        assert sorted((r.url[-1], r.v) for r in merge_pages(snap, one, gone, p, order="n")[0].collect()) == [("a", "late"), ("b", "y")]
        assert sorted(r.v for r in merge_pages(snap, one, gone, p)[0].collect()) == ["late", "y"]


def test_statistics_of_no_entries(spark):
    from sitelake.operators.catalog import catalog_stats

    entries = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "depth int, page_type string")
    assert {(r.dimension, r.key): r.n for r in catalog_stats(entries).collect()} == {("total", ""): 3, ("depth", "1"): 2, ("depth", "2"): 1, ("page_type", "a"): 2, ("page_type", None): 1}
    assert [tuple(r) for r in catalog_stats(entries.limit(0)).collect()] == [("total", "", 0)]


def test_sources_without_a_url_are_errors(spark):
    from sitelake.operators.values import source_provenance

    extracts = spark.createDataFrame([("p", None, True), ("p", "http://a/x.csv", True)], "page_url string, url string, success boolean")
    pages = spark.createDataFrame([("p", "t", "s")], "url string, title string, section string")
    got = sorted((r.url or "", r.success, r.error, r.source_type, r.document_title) for r in source_provenance(extracts, pages).collect())
    assert got == [("", False, "source without a URL", None, "t"), ("http://a/x.csv", True, None, "csv", "t")]


def test_citations_of_long_conversations(spark, monkeypatch):
    from sitelake.operators import citations as C

    monkeypatch.setattr(C, "TURNS", 3)
    rows = [(c, t, p, f"t{t}", "", f"u{(t * 7 + p) % 11}") for c in (1, 2) for t in range(20) for p in range(2)]
    got = C.number_citations(spark.createDataFrame(rows, "conv_id int, turn int, pos int, title string, breadcrumb string, url string")).collect()
    want, seen = [], {}
    for c, _, _, title, _, url in sorted(rows):
        if (c, url) not in seen:
            seen[c, url] = len([1 for k in seen if k[0] == c]) + 1
            want.append((c, seen[c, url], title, url))
    assert sorted((r.conv_id, r.id, r.title, r.url) for r in got) == sorted(want)


def test_citations_by_lines(spark):
    from sitelake.operators import citations as C

    text = "## 1. One\n## 2. Two\nsee **URL:** http://a\r\n**URL:** http://none\n# Page\n\n**URL:** http://no\n# Other \n**URL:**  http://b \n## Breadcrumb\n\n## Breadcrumb\nHome > Y\n## Breadcrumb\nlater\n## 3.  Open"
    got = C.extract_citations(spark.createDataFrame([(1, 0, text)], "conv_id int, turn int, text string")).orderBy("pos").collect()
    assert [(r.title, r.breadcrumb, r.url) for r in got] == [("One", "", "http://a"), ("Other", "Home > Y", "http://b")]
    assert C.extract_citations(spark.createDataFrame([(1, 0, "")], "conv_id int, turn int, text string")).collect() == []


def test_lake_partitions_have_few_files(spark, tmp_path):
    from datetime import datetime

    from sitelake.operators.lake import write_lake

    df = spark.range(4000).selectExpr("id", "id % 5 AS k").repartition(40)
    meta = {"source_url": "u", "source_hash": "h", "extractor_version": "1"}
    manifest = write_lake(df, str(tmp_path), "c", ["k"], meta, datetime(2024, 1, 1), datetime(2025, 1, 1))
    assert {r.partition_path: r.row_count for r in manifest.collect()} == {f"k={i}": 800 for i in range(5)}
    assert len(list((tmp_path / "data").rglob("*.parquet"))) <= 10


def test_entry_leaves_out_what_cannot_be_imported(monkeypatch):
    import sys

    import __spark_entry__

    every = set(__spark_entry__.queries())
    for name in ("sentencepiece", "xxhash"):
        for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sitelake.llm")]:
            monkeypatch.delitem(sys.modules, m)
        monkeypatch.setitem(sys.modules, name, None)
        assert {q for q in every if not q.startswith("op")} - {"pipeline"} <= set(__spark_entry__.queries())
        monkeypatch.undo()


def test_work_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from sitelake.sources.work import work_path

    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        work_path(SimpleNamespace(conf=conf, sparkContext=sc), "x")


def test_runs_and_lookups_across_spans(spark):
    """Spans of time give what the whole log gives."""
    import random

    from sitelake.operators.cacheops import cache_lookup
    from sitelake.operators.snapshots import failure_runs

    r = random.Random(5)
    start = datetime(2024, 1, 1)
    log = [(f"h{r.randint(0, 2)}", start + timedelta(seconds=r.randint(0, 600)), i, r.random() < 0.7) for i in range(300)]
    log += [("bad", start + timedelta(seconds=40 * i), i, True) for i in range(20)] + [("bad", start + timedelta(seconds=205), 99, False)]
    want = []
    for host in {x[0] for x in log}:
        run = []
        for x in [*sorted((x for x in log if x[0] == host), key=lambda x: (x[1], x[2])), (host, None, None, False)]:
            if x[3]:
                run.append(x[1])
            elif run:
                want.append((host, run[0], run[-1], len(run)))
                run = []
    df = spark.createDataFrame(log, "host string, ts timestamp, seq int, failed boolean")
    for span in (7, 60, 3600):
        assert sorted((x.host, x.started, x.ended, x.n_failures) for x in failure_runs(df, 5, span).collect()) == sorted(want)
    entries = [(i, f"k{r.randint(0, 2)}", start + timedelta(seconds=r.randint(0, 500)), 60) for i in range(40)]
    asked = [(i, f"k{r.randint(0, 3)}", start + timedelta(seconds=r.randint(0, 500))) for i in range(80)]
    ages = {}
    for i, k, ts in asked:
        own = [e for e in entries if e[1] == k and e[2] <= ts]
        ages[i] = (ts - max(e[2] for e in own)).total_seconds() if own else None
    e, q = spark.createDataFrame(entries, "entry_id int, key string, set_at timestamp, ttl_s int"), spark.createDataFrame(asked, "request_id int, key string, ts timestamp")
    for span in (5, 50, 3600):
        assert {x.request_id: x.age_s for x in cache_lookup(q, e, span).collect()} == ages
