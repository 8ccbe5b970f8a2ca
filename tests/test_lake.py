"""The lake: versions published by the manifest, reads through it, totals from partial states."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

META = {"source_url": "u", "source_hash": "h", "extractor_version": "1"}
WHEN = (datetime(2024, 1, 1), datetime(2025, 1, 1))
SCHEMA = "who string, day date, value decimal(18,2), month string, kind string"
KEYS = ["kind", "month"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def records(n, kind="a", month="01", factor=1):
    return [(f"p{i % 50}", date(2024, 1, 1 + i % 20), Decimal(factor * i), month, kind) for i in range(n)]


def write(spark, path, rows, states=None):
    from sitelake.operators import lake

    return lake.write_lake(frame(spark, rows), path, "c", KEYS, META, *WHEN, states=states)


def read(spark, path, wanted=None):
    from sitelake.operators import lake

    asked = None if wanted is None else spark.createDataFrame([(w,) for w in wanted], "partition_path string")
    return lake.read_lake(spark, path, "c", asked)


def test_reads_see_what_is_published(spark, tmp_path, monkeypatch):
    from sitelake.operators import lake
    from sitelake.sources import versions

    path = str(tmp_path)
    assert read(spark, path, ["kind=a/month=01"])[1].count() == 1 and lake.read_manifest(spark, path).isEmpty()
    first, other = records(10), records(5, "b", None)
    write(spark, path, first + other)
    assert sorted(map(tuple, read(spark, path)[0].collect()), key=str) == sorted(map(tuple, frame(spark, first + other).collect()), key=str)
    # a writer that dies between data and manifest
    publish = versions.publish
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        write(spark, path, records(3, factor=9))
    assert read(spark, path)[0].count() == 15 and lake.read_manifest(spark, path).count() == 2
    monkeypatch.setattr(versions, "publish", publish)
    write(spark, path, records(4, factor=2))
    rows, lost = read(spark, path)
    assert sorted((r.kind, r.value) for r in rows.collect()) == sorted((r[4], r[2]) for r in records(4, factor=2) + other) and lost.isEmpty()
    last = {r.partition_path: (r.version, r.row_count) for r in lake.newest(lake.read_manifest(spark, path)).collect()}
    assert last == {"kind=a/month=01": (2, 4), f"kind=b/month={lake.NULL_NAME}": (1, 5)}


def test_partitions_are_pruned_and_missing_ones_told(spark, tmp_path):
    write(spark, str(tmp_path), [r for m in range(1, 10) for r in records(6, month=f"{m:02d}")])
    rows, lost = read(spark, str(tmp_path), ["kind=a/month=03", "kind=a/month=07", "kind=a/month=7", "kind=z/month=01"])
    assert {r.month for r in rows.collect()} == {"03", "07"} and rows.count() == 12, "values of keys are as they were written"
    assert {r.partition_path for r in lost.collect()} == {"kind=a/month=7", "kind=z/month=01"}
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_new_columns_and_odd_values(spark, tmp_path):
    from sitelake.operators import lake

    path = str(tmp_path)
    lake.write_lake(spark.createDataFrame([(1, "a/b=c")], "v int, k string"), path, "c", ["k"], META, *WHEN)
    lake.write_lake(spark.createDataFrame([(2, "é %", "new")], "v int, k string, more string"), path, "c", ["k"], META, *WHEN)
    rows, lost = read(spark, path, ["k=a/b=c", "k=é %"])
    assert sorted(map(tuple, rows.collect())) == [(1, "a/b=c", None), (2, "é %", "new")] and lost.isEmpty()


def test_totals_from_states(spark, tmp_path):
    from sitelake.operators import lake

    path, keys = str(tmp_path), ["who", "kind"]
    states = (keys, "value", "day")
    write(spark, path, records(2000) + records(300, "b") + [("nobody", date(2024, 1, 9), None, "01", "b")], states)
    write(spark, path, records(900, factor=3), states)
    now = records(900, factor=3) + records(300, "b") + [("nobody", date(2024, 1, 9), None, "01", "b")]
    for days in ((None, None), (date(2024, 1, 5), date(2024, 1, 11)), (date(2030, 1, 1), None)):
        got = lake.totals_of_period(lake.read_states(spark, path, "c"), keys, *days).first()
        want = lake.period_totals(lake.filter_period(frame(spark, now), "day", *days), keys, when="day").first()
        assert (got.records, got.total, got.first_date, got.last_date) == (want.records, want.total, want.first_date, want.last_date)
        assert got.average == want.average or abs(got.average - want.average) < 1e-4
        assert abs(got.n_who - want.n_who) <= 2 and got.n_kind == want.n_kind
    files = lake.read_states(spark, path, "c").inputFiles()
    assert any("/states/" in f for f in files) and not any("/data/" in f for f in files), "records aren't read"
    with pytest.raises(ValueError, match="published"):
        lake.read_states(spark, path, "none")
    assert lake.partial_totals(frame(spark, now).filter(F.lit(False)), keys, "value", "day").isEmpty()
