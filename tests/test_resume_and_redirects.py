"""Enrichment that resumes, trees of page files, redirect chains, rules and prices found by their beginnings."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F


def test_a_killed_run_calls_no_finished_row_again(spark, tmp_path):
    from sitelake.operators import enrich as E

    calls, die, log = tmp_path / "calls", tmp_path / "die", str(tmp_path / "log")
    die.touch()

    def fn(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if prompt == "p77" and os.path.exists(die):
            os._exit(1)  # the worker is gone, with it the task and the job
        if prompt == "bad":
            raise TimeoutError
        return f" text of {prompt} ", 2, 3

    names = [f"p{i}" for i in range(120)] + ["bad"]
    prompts = spark.createDataFrame([(f"u{i}", p) for i, p in enumerate(names * 2)] + [("none", None)], "url string, prompt string").coalesce(2)
    with pytest.raises(Exception, match="(?i)worker|exit|job"):
        E.enrich_resumable(prompts, fn, log, buckets=3, flush=5).collect()
    finished = {r.text.removeprefix("text of ") for r in E.read_log(spark, log).filter("error_class IS NULL").collect()}
    assert len(finished) >= 5
    die.unlink()
    first = calls.read_text().split("\n")[:-1]
    calls.write_text("")
    got = E.enrich_resumable(prompts, fn, log, buckets=3, flush=5).collect()
    second = calls.read_text().split("\n")[:-1]
    assert not finished & set(second) and set(second) | finished >= set(names) and len(second) == len(set(second))
    assert first.count("bad") <= 1 and second.count("bad") == 1, "equal prompts are called for once, failed ones again"
    assert len(got) == len(names) * 2 + 1 and {r.error_class for r in got} == {None, "TimeoutError"}
    assert {r.url: r.text for r in got}["u5"] == "text of p5"
    calls.write_text("")
    again = E.enrich_resumable(prompts, fn, log, buckets=3, flush=5).collect()
    assert calls.read_text() == "bad\n" and sorted(map(str, again)) == sorted(map(str, got))
    assert E.enrich_resumable(prompts.limit(0), fn, str(tmp_path / "other"), buckets=3).collect() == []


def test_files_of_half_a_flush_are_not_read(spark, tmp_path):
    from sitelake.operators import enrich as E

    log = E.ResultLog(str(tmp_path / "log"))
    log.add(1, [("h", "t", None, 1, 1), ("e", None, "X", 0, 0)])
    (tmp_path / "log/b1/_half.parquet").write_bytes(b"PAR1")
    assert E.ResultLog(str(tmp_path / "log")).finished(1) == {"h"} and log.finished(2) == set()
    log.add(1, [("e", "good", None, 1, 1)])
    assert {r.hash: r.text for r in E.read_log(spark, str(tmp_path / "log")).collect()} == {"h": "t", "e": "good"}


def test_page_trees(spark, tmp_path, monkeypatch):
    from sitelake.sources import io, pagetree

    top = tmp_path / "site"

    def put(folder, content, name="_index.json"):
        (top / folder).mkdir(parents=True, exist_ok=True)
        (top / folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())

    page = lambda url, **more: json.dumps({"url": url, "schema_version": 2, "metadata": {"depth": 1, "extracted_at": "2024-01-02T03:04:05Z", **more}, "links": {"children": [{"title": "é", "url": "x"}]}})
    put("", page("root"))
    for i in range(12):
        put(f"a/b{i % 3}/c{i}/d/e", page(f"deep{i}"))
    put("a", page("a", extracted_at="no time"))
    put("a/b0", "{broken")
    put("a/b1", "[1, 2]")
    put("a/b2", b"\xff\xfe")
    put("odd", '{"title": "without a url"}')
    put("odd/x", page("other name"), "page.json")
    put("odd/empty", "")
    pages, rejects = pagetree.load_tree(spark, str(top))
    rows = {r.url: r for r in pages.collect()}
    assert set(rows) == {"root", "a", *(f"deep{i}" for i in range(12))}
    assert rows["root"].metadata.extracted_at.year == 2024 and rows["a"].metadata.extracted_at is None and rows["a"].metadata.depth == 1
    assert rows["deep3"].links.children[0].title == "é" and rows["root"].content is None and pages.schema == io.load_pages(spark, str(top), "tree").schema
    assert sorted((r.file.removeprefix(str(top)), r.error) for r in rejects.collect()) == [("/a/b0/_index.json", "not a page record"), ("/a/b1/_index.json", "not a page record"), ("/a/b2/_index.json", "UnicodeDecodeError"), ("/odd/_index.json", "no url"), ("/odd/empty/_index.json", "not a page record")]
    assert {r.url for r in pagetree.load_tree(spark, str(top), name="page.json")[0].collect()} == {"other name"}
    reader = pagetree.PageTreeReader(str(top), "_index.json", 2)
    assert sum(len(p.folders) for p in reader.partitions() if p.deep) == 5 and len({f for p in reader.partitions() for f in p.folders}) == 8
    (tmp_path / "none").mkdir()
    assert pagetree.load_tree(spark, str(tmp_path / "none"))[0].isEmpty()


def follow(edges, url):
    seen, at = [], url
    while at in edges:
        if at in seen:
            return None, None, True
        seen.append(at)
        at = edges[at]
    return at, len(seen), False


def test_redirects_end_somewhere_or_turn_in_circles(spark):
    from sitelake.operators import redirects as R

    r = random.Random(6)
    edges = {f"u{i}": f"u{i + 1}" for i in range(300)} | {f"c{i}": f"c{(i + 1) % 7}" for i in range(7)} | {f"to{i}": "home" for i in range(40)} | {f"x{i}": r.choice(["c0", "u250", f"x{i + 1}"]) for i in range(30)} | {"two0": "two1", "two1": "two0"}
    rows = [(a, b, 2) for a, b in edges.items()] + [("u5", "elsewhere", 1), ("self", "self", 1), (None, "x", 1), ("y", None, 1)] + [("u1", "u2", 2)]
    out = R.redirect_chains(spark.createDataFrame(rows, "url string, target string, at int"), order="at")
    assert {x.url: (x.target, x.hops, x.cyclic) for x in out.collect()} == {u: follow(edges, u) for u in edges}
    final = {x.url: x.final for x in R.resolved(spark.createDataFrame([("u7",), ("c1",), ("plain",), (None,)], "url string"), out).collect()}
    assert final == {"u7": "u300", "c1": None, "plain": "plain", None: None}
    assert R.redirect_chains(spark.createDataFrame([], "url string, target string")).isEmpty()


def brute_allowed(path, rules):
    import re

    fits = []
    for allow, pattern in rules:
        body = pattern.removesuffix("$")
        form = ".*".join(re.escape(x) for x in body.split("*")) + ("$" if pattern.endswith("$") else "")
        if pattern and re.match(form, path):
            fits.append((len(pattern), allow))
    return max(fits)[1] if fits else True


def test_rules_by_their_beginnings_equal_trying_all(spark):
    from sitelake.operators import discovery as D

    r = random.Random(7)
    signs = ["/", "a", "b", "/a", "*", "$", "/b*", ".", "é"]
    rules = [(r.random() < 0.5, "".join(r.choice(signs) for _ in range(r.randint(0, 5)))) for _ in range(150)]
    paths = {"/" + "".join(r.choice(["a", "b", "/", ".", "é", "x"]) for _ in range(r.randint(0, 8))) for _ in range(200)} - {"//"}
    paths = {p for p in paths if "//" not in p}
    table = spark.createDataFrame([("h.example", "*", a, p) for a, p in rules], "host string, agent string, allow boolean, path_pattern string")
    urls = spark.createDataFrame([(f"https://h.example{p}",) for p in paths] * 2 + [("https://free.example/a",), (None,)], "url string")
    out = D.robots_filter(urls, table, "bot").collect()
    assert len(out) == 2 * len(paths) + 2
    for x in out:
        want = brute_allowed(x.url.removeprefix("https://h.example"), rules) if x.url and "//h." in x.url else True
        assert x.allowed == want, x.url


def test_a_host_with_many_rules(spark):
    from sitelake.operators import discovery as D

    rules = spark.range(100_000).select(F.lit("h.example").alias("host"), F.lit("*").alias("agent"), (F.col("id") % 2 == 0).alias("allow"), F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("/")).alias("path_pattern"))
    urls = spark.range(20_000).select(F.concat(F.lit("https://h.example/p/"), (F.col("id") * 7 % 120_000).cast("string"), F.lit("/x")).alias("url"))
    begin = time.time()
    got = D.robots_filter(urls, rules, "bot").groupBy("allowed").count().collect()
    assert time.time() - begin < 60
    want = [i * 7 % 120_000 for i in range(20_000)]
    assert {r.allowed: r["count"] for r in got} == {True: sum(w >= 100_000 or w % 2 == 0 for w in want), False: sum(w < 100_000 and w % 2 == 1 for w in want)}
