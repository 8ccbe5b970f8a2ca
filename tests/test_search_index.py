"""The stored search index: updates, merges, searches by blocks; versions and work tables."""

import random
import threading

import pytest
from pyspark.sql import functions as F

PAGE = "url string, title string, mini_summary string, full_text string, section string"
WORDS = [f"word{i}" for i in range(30)] + ["common"] * 12


def page(r, url, n=None):
    return (url, r.choice(["", "Título", None]), None, " ".join(r.choices(WORDS, k=r.randint(0, 40) if n is None else n)), r.choice(["a", "b"]))


def exhaustive(spark, rows, queries, k):
    """The best k of a rebuild that scores every match."""
    from sitelake.operators import search as S

    postings, lengths = S.build_postings(spark.createDataFrame(rows, PAGE))
    out = S.top_k(S.bm25_scores(queries, postings, lengths), k)
    return sorted((r.query_id, r["rank"], r.url, r.score) for r in out.collect())


def searched(index, queries, k, **more):
    from sitelake.operators import searchindex as X

    top, report = X.best_pages(index, queries.withColumn("k", F.lit(k)), **more)
    return sorted((r.query_id, r["rank"], r.url, r.score) for r in top.collect()), {r.query_id: r for r in report.collect()}


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "common"), (2, "word1 word2"), (3, "word3 common word4"), (4, "absent common"), (5, ""), (6, "Titulo:* common"), (7, "word9")]
    return spark.createDataFrame(rows, "query_id int, query string")


def test_updates_equal_a_rebuild(spark, asked, tmp_path, monkeypatch):
    from sitelake.operators import searchindex as X

    monkeypatch.setattr(X, "FAN", 3)
    monkeypatch.setattr(X, "BLOCK_PAGES", 8)
    r, now, path, merged, kept = random.Random(1), {}, str(tmp_path / "index"), 0, {}
    for step in range(5):
        index = X.SearchIndex(spark, path, buckets=4)
        before = {s.id: (s.first, s.last) for s in index.segments}
        changed = [page(r, f"u{r.randint(0, 60)}") for _ in range(60 if step == 0 else r.randint(1, 12))]
        changed = list({p[0]: p for p in changed}.values())
        gone = [] if step == 0 else r.sample(sorted(now), 4) + ["never"] + ([changed[0][0]] if step == 3 else [])
        index.update(spark.createDataFrame(changed, PAGE), spark.createDataFrame([(u,) for u in gone], "url string"))
        now = {u: p for u, p in ({**now, **{p[0]: p for p in changed}}).items() if u not in gone}
        after = {s.id: (s.first, s.last) for s in index.segments}
        merged += len(after) <= len(before)
        kept = {i: x for i, x in after.items() if i in before}
        assert all(before[i] == x for i, x in kept.items()), "a segment that stays isn't rewritten"
        spans = sorted(after.values())
        assert spans[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))
        again = X.SearchIndex(spark, path, buckets=4)
        assert again.totals()[0] == len(now) == again.live().count()
        if step > 2:
            assert searched(again, asked, 3, first_blocks=1)[0] == exhaustive(spark, list(now.values()), asked, 3), step
    assert merged, "some update merged"
    got = {(x.query_id, x.url) for x in X.matches(again, asked).collect()}
    assert got == {(q, u) for q, _, u, _ in exhaustive(spark, list(now.values()), asked, 1000)}
    again.vacuum()
    assert len([*(tmp_path / "index/segments").iterdir()]) == len(again.segments)
    assert searched(X.SearchIndex(spark, path, buckets=4), asked, 3)[0] == exhaustive(spark, list(now.values()), asked, 3)


def test_blocks_below_the_threshold_are_not_scored(spark, tmp_path, monkeypatch):
    from sitelake.operators import searchindex as X

    monkeypatch.setattr(X, "BLOCK_PAGES", 16)
    r = random.Random(2)
    rows = [(f"u{i}", None, None, " ".join(f"w{r.randint(0, 90)}" for _ in range(30)), "a") for i in range(1500)] + [(f"best{i}", "w3 " * 20, None, "w3 w4 w4 w4", "a") for i in range(12)]
    index = X.SearchIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame(rows, PAGE))
    queries = spark.createDataFrame([(1, "w3"), (2, "w3 w4")], "query_id int, query string")
    got, report = searched(index, queries, 5)
    assert got == exhaustive(spark, rows, queries, 5)
    assert report[1].n_blocks >= 64 and report[1].n_first + report[1].n_second < report[1].n_blocks / 3


def test_terms_reach_the_scan(spark, tmp_path):
    from sitelake.operators import searchindex as X

    pages = spark.createDataFrame([(f"u{i}", "", None, f"word{i} common", "s") for i in range(50)], PAGE)
    index = X.SearchIndex(spark, str(tmp_path / "i"), buckets=16)
    index.update(pages)
    own = index.blocks(spark.createDataFrame([(1, "word7"), (2, "")], "query_id int, query string"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "word7" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_empty_and_odd_pages(spark, asked, tmp_path):
    from sitelake.operators import searchindex as X

    index = X.SearchIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([], PAGE))
    assert searched(index, asked, 3)[0] == [] and index.totals() == (0, 0.0)
    rows = [(None, "common", None, "common", "a"), ("u", None, None, None, "a"), ("v", "common", None, "", "a"), ("v", "common", None, "common", "a")]
    index.update(spark.createDataFrame(rows, PAGE))
    assert [x[2] for x in searched(index, asked, 3)[0] if x[0] == 1] == ["v"] and index.totals()[0] == 2
    index.update(spark.createDataFrame([], PAGE), spark.createDataFrame([("v",), ("v",), (None,)], "url string"))
    assert [x for x in searched(index, asked, 3)[0] if x[0] == 1] == [] and index.totals()[0] == 1


def test_a_new_state_of_the_table_gives_a_new_index(spark, tmp_path):
    from sitelake.plans import texts

    docs = [(i, f"alpha beta{i}", "en", "s") for i in range(5)]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert texts.search_index(spark, str(tmp_path)).totals()[0] == 5
    spark.createDataFrame([(9, "alpha", "en", "s")], schema).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert texts.search_index(spark, str(tmp_path)).totals()[0] == 6


def test_counted_terms(spark):
    from sitelake.functions import text as T

    rows = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, ["x"]), (4, ["w"] * 50_000)]
    got = {r.id: [(x.term, x.n) for x in r.c] for r in spark.createDataFrame(rows, "id int, t array<string>").select("id", T.counted(F.col("t")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("é", 1)], 2: [], 3: [("x", 1)], 4: [("w", 50_000)]}


def test_versions_are_seen_when_whole(spark, tmp_path):
    from sitelake.sources import versions

    path = str(tmp_path / "v")
    assert versions.latest(spark, path) == (0, None)
    versions.publish(spark.range(2), path, 1)
    spark.range(3).write.parquet(versions.at_version(path, 2))
    (tmp_path / "v/v=0000000002/_SUCCESS").unlink()  # a writer that died
    assert versions.latest(spark, path)[0] == 1
    versions.publish(spark.range(4), path, 2)
    number, rows = versions.latest(spark, path)
    assert number == 2 and rows.count() == 4
    with pytest.raises(ValueError, match="before"):
        versions.publish(spark.range(1), path, 2)


def test_tables_of_other_threads_stay(spark):
    from sitelake.sources import work

    found = {}

    def other():
        found["theirs"] = work.written(spark.range(7), "theirs")

    def make():
        found["inner"] = work.written(spark.range(3), "inner")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        found["nested"] = work.settled(lambda: work.written(spark.range(5), "x").filter("id > 1"), "nested")
        return found["inner"].unionByName(found["nested"])

    out = work.settled(make, "out")
    assert out.count() == 6 and found["theirs"].count() == 7
    for gone in ("inner", "nested"):
        with pytest.raises(Exception, match="(?i)exist"):
            spark.read.parquet(found[gone].inputFiles()[0]).count()
    work.work_path(spark, "bare")
    work.remove_tables(spark)
    assert not work._made
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    import os

    assert [x for x in os.listdir(top) if "-" in x and x.split("-")[0] in ("theirs", "out", "inner", "nested", "search", "warc", "catalog")] == []


def shuffled(spark):
    """Bytes that all tasks so far have written for shuffles."""
    own = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(own.apply(i).totalShuffleWrite() for i in range(own.size()))


def test_texts_are_shuffled_once_and_urls_stored_once(spark, tmp_path):
    from sitelake.operators import searchindex as X

    r = random.Random(5)
    words = [f"{r.getrandbits(40):x}" for _ in range(400)]
    rows = [(f"https://h.example/{r.getrandbits(200):x}", "", None, " ".join(r.choices(words, k=300)), "a") for _ in range(600)]
    pages, index = spark.createDataFrame(rows, PAGE), X.SearchIndex(spark, str(tmp_path / "i"), buckets=2)
    before = shuffled(spark)
    index.update(pages)
    assert shuffled(spark) - before < sum(len(x[0]) + len(x[3]) for x in rows)
    assert "url" not in spark.read.parquet(str(tmp_path / f"i/segments/{index.segments[0].id}/blocks")).schema.simpleString()


def test_frequent_terms_cost_no_rows_for_each_query_and_page(spark, tmp_path):
    from sitelake.operators import searchindex as X

    common = " ".join(f"common{i}" for i in range(10))
    rows = [(f"u{i}", "", None, f"{common} rare{i % 100}", "a") for i in range(1000)]
    index = X.SearchIndex(spark, str(tmp_path / "i"), buckets=2)
    index.update(spark.createDataFrame(rows, PAGE))
    queries = spark.createDataFrame([(i, f"{common} rare{i}") for i in range(100)], "query_id int, query string")
    before = shuffled(spark)
    got = {(x.query_id, x.url) for x in X.matches(index, queries).collect()}
    assert got == {(i % 100, f"u{i}") for i in range(1000)}
    # 10 terms of 100 queries in 1,000 pages are a million entries, of which 10,000 are in pages with the rare term
    assert shuffled(spark) - before < 2_000_000
    top, _ = searched(index, queries, 3)
    assert len(top) == 300
    assert shuffled(spark) - before < 5_000_000


def test_an_update_costs_what_changed_and_urls(spark, tmp_path):
    from sitelake.operators import searchindex as X

    r = random.Random(6)
    words = [f"{r.getrandbits(40):x}" for _ in range(400)]
    rows = [(f"u{i}", "", None, " ".join(r.choices(words, k=300)), "a") for i in range(600)]
    index = X.SearchIndex(spark, str(tmp_path / "i"), buckets=2)
    index.update(spark.createDataFrame(rows, PAGE))
    before = shuffled(spark)
    index.update(spark.createDataFrame([(f"u{i}", "", None, words[0], "a") for i in range(300)], PAGE), spark.createDataFrame([(f"u{i}",) for i in range(290, 400)], "url string"))
    assert shuffled(spark) - before < sum(len(x[3]) for x in rows) / 20
    queries = spark.createDataFrame([(1, words[0])], "query_id int, query string")
    now = [(u, t, None, words[0] if int(u[1:]) < 290 else x, s) for u, t, _, x, s in rows if not 290 <= int(u[1:]) < 400]
    # 8 blocks of 600 pages and 4 of 290
    got, report = searched(index, queries, 20)
    assert got == exhaustive(spark, now, queries, 20) and report[1].n_first + report[1].n_second <= report[1].n_blocks == 12
