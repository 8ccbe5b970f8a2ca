"""Streams against what tables say: cache lookups, page changes, breakers of quiet hosts; operators by row."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
EVENTS = "key string, ts timestamp, id long, ttl_s double"


def batches_of(spark, path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, to, checkpoint):
    stream.writeStream.format("parquet").option("path", str(to)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def lookups(spark, rows):
    from sitelake.operators.cacheops import cache_lookup

    df = spark.createDataFrame(rows, EVENTS)
    entries = df.filter("ttl_s IS NOT NULL").select(F.col("id").alias("entry_id"), "key", F.col("ts").alias("set_at"), "ttl_s")
    asked = df.filter("ttl_s IS NULL").select(F.col("id").alias("request_id"), "key", "ts")
    return sorted(map(tuple, cache_lookup(asked, entries).select("request_id", "cache_key", "status", "age_s").collect()))


def test_lookups_of_a_stream_equal_the_table(spark, tmp_path):
    from sitelake.streaming import caching

    r = random.Random(3)
    rows = [(f"k{r.randint(0, 4)}", START + timedelta(seconds=r.randint(0, 3600), microseconds=r.choice([0, 0, 700])), i, r.choice([None, None, 60.0, 900.0])) for i in range(240)]
    parts = [[], [], [], []]
    for row in sorted(rows, key=lambda x: x[1]):  # up to 20 minutes late
        parts[min(3, int((row[1] - START).total_seconds() // 1200) + r.choice([0, 0, 1]))].append(row)
    parts.append([("", START + timedelta(days=9), -1, 1.0)])
    with caching.rocks(spark):
        run(caching.cache_lookup_stream(batches_of(spark, tmp_path / "in", parts, EVENTS), late="1 hour"), tmp_path / "out", tmp_path / "cp")
    got = sorted(map(tuple, spark.read.schema(caching.OUT).parquet(str(tmp_path / "out")).collect()))
    assert got == lookups(spark, rows) and {x[2] for x in got} == {"hit", "miss", "expired"}


def test_forgotten_entries_are_misses(spark, tmp_path):
    from sitelake.streaming import caching

    at = lambda s: START + timedelta(seconds=s)
    parts = [[("k", at(0), 1, 60.0), ("k", at(30), 2, None)], [("x", at(4000), 3, 1.0)], [("x", at(4001), 4, 1.0)], [("k", at(5000), 5, None)], [("x", at(99_000), 6, 1.0)]]
    with caching.rocks(spark):
        run(caching.cache_lookup_stream(batches_of(spark, tmp_path / "in", parts, EVENTS), late="10 seconds", forget_s=100.0), tmp_path / "out", tmp_path / "cp")
    got = {x.request_id: x.status for x in spark.read.schema(caching.OUT).parquet(str(tmp_path / "out")).collect()}
    assert got == {2: "hit", 5: "miss"}


def test_null_keys_and_times_are_as_in_the_table(spark, tmp_path):
    from sitelake.streaming import caching

    at = lambda s: START + timedelta(seconds=s)
    parts = [[(None, at(5), 2, None), (None, at(0), 1, 3.0), ("k", at(5), 3, None)], [("x", at(99_000), 6, 1.0)]]
    with caching.rocks(spark):
        run(caching.cache_lookup_stream(batches_of(spark, tmp_path / "in", parts, EVENTS), late="10 seconds"), tmp_path / "out", tmp_path / "cp")
    got = {x.request_id: (x.cache_key is None, x.status, x.age_s) for x in spark.read.schema(caching.OUT).parquet(str(tmp_path / "out")).collect()}
    assert got == {2: (True, "expired", 5.0), 3: (False, "miss", None)}


def test_one_timer_for_all_that_waits():
    import pandas as pd

    from sitelake.streaming import caching

    class State:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value if not isinstance(self.value, list) else iter(self.value)
        update = put = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)
        appendList = lambda self, v: setattr(self, "value", [*(self.value or []), *v])
        getValue = lambda self, k: (self.value or {}).get(k)
        updateValue = lambda self, k, v: setattr(self, "value", {**(self.value or {}), k: v})

    class Handle:
        timers = []
        getMapState = getListState = getValueState = lambda self, *a: State()
        registerTimer = lambda self, ms: self.timers.append(ms)

    class Now:
        getCurrentWatermarkInMs = lambda self: 10**9

    handle, lookups = Handle(), caching.Lookups(None)
    lookups.init(handle)
    rows = pd.DataFrame({"cache_key": "k", "at": range(0, 10**6, 1000), "kind": [0, 1] * 500, "id": range(1000), "ttl_s": 1.0})
    for i in range(0, 1000, 250):
        assert sum(len(x) for x in lookups.handleInputRows(("k",), iter([rows[i : i + 250]]), Now())) == 0
    assert handle.timers == [0]
    out = [x for part in lookups.handleExpiredTimer(("k",), Now(), None) for x in part.status]
    assert out == ["hit"] * 500 and handle.timers == [0]


CHANGE = "url string, v string, at long, deleted boolean"


def test_changes_equal_their_last_state(spark, tmp_path):
    from sitelake.streaming.pagestore import PageStore

    r = random.Random(4)
    base = "https://h.example/a"
    rows = [(f"{base}/{r.randint(0, 30)}", f"v{i}", r.randint(0, 50), r.choice([False, False, None, True])) for i in range(200)]
    rows += [("https://elsewhere.example/x", "no", 1, False), (f"{base}/../x", "no", 2, None), (None, "no", 3, False)]
    good, want = [x for x in rows if x[0] and x[0].startswith(base + "/") and ".." not in x[0]], {}
    for url in {x[0] for x in good}:
        at = max(x[2] for x in good if x[0] == url)
        last = [x for x in good if x[0] == url and x[2] == at]
        want[url] = last
    schema = spark.createDataFrame([], CHANGE).schema
    parts = [rows[i::4] for i in range(4)]
    store = PageStore(spark, str(tmp_path / "store"), schema, base, "at", buckets=4)
    assert store.pages().isEmpty() and store.rejects().isEmpty()
    stream = batches_of(spark, tmp_path / "in", parts, CHANGE)
    store.follow(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def check():
        now = {x.url: x for x in store.pages().collect()}
        for url, last in want.items():
            if url in now:
                assert (url, now[url].v, now[url].at) in {x[:3] for x in last if not x[3]}
            else:
                assert any(x[3] for x in last)
        assert len(now) == store.pages().count() and set(now) <= set(want)
        assert sorted(x.v for x in store.rejects().collect()) == ["no"] * 3

    check()
    before = sorted(map(tuple, store.pages().collect()))
    number, entries = store._manifest()
    store.apply(spark.createDataFrame([(f"{base}/1", "again", 99, False)], CHANGE), 2)
    assert store._manifest()[0] == number, "a batch that was applied is not applied again"
    store.apply(spark.createDataFrame([(f"{base}/1", "newer", 99, False)], CHANGE), 9)
    changed = {e.bucket for e in store._manifest()[1]} - {e.bucket for e in store._manifest()[1] if e.folder in {x.folder for x in entries}}
    assert len(changed) == 1, "other buckets keep their files"
    store.apply(spark.createDataFrame([(f"{base}/1", "older", 60, True)], CHANGE), 10)
    assert {x.url: x.v for x in store.pages().collect()}[f"{base}/1"] == "newer"
    store.vacuum()
    after = {tuple(x) for x in store.pages().collect()}
    assert {x for x in before if x[0] != f"{base}/1"} == {x for x in after if x[0] != f"{base}/1"}


def test_a_lost_batch_is_not_seen(spark, tmp_path, monkeypatch):
    from sitelake.sources import versions
    from sitelake.streaming.pagestore import PageStore

    schema = spark.createDataFrame([], CHANGE).schema
    store = PageStore(spark, str(tmp_path / "s"), schema, "https://h.example", "at", buckets=2)
    store.apply(spark.createDataFrame([("https://h.example/1", "a", 1, False)], CHANGE), 0)
    publish = versions.publish
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    more = spark.createDataFrame([("https://h.example/1", "b", 2, False), ("https://no.example", "x", 1, None)], CHANGE)
    with pytest.raises(RuntimeError, match="lost"):
        store.apply(more, 1)
    assert [x.v for x in store.pages().collect()] == ["a"] and store.rejects().isEmpty()
    monkeypatch.setattr(versions, "publish", publish)
    store.apply(more, 1)
    assert [x.v for x in store.pages().collect()] == ["b"] and store.rejects().count() == 1


def test_quiet_hosts_stay_aborted(spark, tmp_path):
    from sitelake.streaming import breaker as B

    schema, cfg = "host string, ts timestamp, seq int, failed boolean", B.Breaker(most_failures=2, most_after_pause=2)
    day = lambda d, m: START + timedelta(days=d, minutes=m)
    first = [("h", day(0, m), m, True) for m in (0, 1, 20, 21)] + [("open", day(0, 0), 1, True), ("open", day(0, 1), 2, True), ("ok", day(0, 0), 1, True), ("ok", day(0, 1), 2, None)]
    parts = [first, [("z", day(3, m), m, False) for m in range(3)], [("h", day(4, m), m, True) for m in range(2)] + [("open", day(4, 1), 3, False), ("ok", day(4, 0), 3, True)]]
    run(B.failure_breaker_stream(batches_of(spark, tmp_path / "in", parts, schema), cfg), tmp_path / "out", tmp_path / "cp")
    got = sorted(map(tuple, spark.read.schema(B._OUT).parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, B.failure_breaker_batch(spark.createDataFrame([r for p in parts for r in p], schema), cfg).collect()))
    assert got == want and ("h", day(0, 21), "half_open", "aborted") in got


def test_keywords_of_rows_without_ids(spark):
    from sitelake.operators.extract import keywords_top10

    text = "alpha beta alpha gamma " * 5
    rows = [(None, text), (None, "delta epsilon delta zeta eta theta iota " * 3), (1, text), (1, text), (2, "short"), (3, None), (4, "a b c " * 30)]
    out = keywords_top10(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, ["alpha", "beta", "gamma"]), (None, ["delta", "epsilon", "eta", "iota", "theta", "zeta"]), (1, ["alpha", "beta", "gamma"]), (1, ["alpha", "beta", "gamma"])], key=str)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_markers_in_one_text(spark):
    from sitelake.operators import citations as C

    n = 100_000
    text = "é" + "".join(f"[w{i % 7}]^{i} " for i in range(n)) + "[big]^99999999999 []^1 [x]^"
    begin = time.time()
    got = C.parse_citation_markers(spark.createDataFrame([(1, 0, text), (None, None, None)], "conv_id int, turn int, text string")).collect()
    assert time.time() - begin < 60 and len(got) == n + 1
    assert all(text[r.start : r.end] == f"[{r.label}]^{r.number}" for r in got[:-1]) and got[-1].number is None
    urls = C.extract_urls(spark.createDataFrame([(1, 0, "**URL:** https://a b **URL:**  http:// **URL:**x **URL:**\n\nhttp://c**URL:** ftp://d")], "conv_id int, turn int, text string"))
    assert [(r.pos, r.url) for r in urls.collect()] == [(0, "https://a"), (1, "http://c")]
