"""Partitioned lake: versioned writes published by a manifest, reads through it, totals from partial states, coverage, and
analysis by period and group."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sitelake.sources import versions


def filter_period(df: DataFrame, column: str, start: date | None = None, end: date | None = None, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows from start to end (both included), or of a year and month. Ranges on the column itself, so that
    they prune partitions and reach the scan."""
    if year is not None:
        start = date(year, month or 1, 1)
        last = date(year + 1, 1, 1) if month in (None, 12) else date(year, month + 1, 1)
        return df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(last)))
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df if end is None else df.filter(F.col(column) < F.date_add(F.lit(end), 1))


def grouped_analysis(df: DataFrame, key: str, value: str = "value", n: int | None = None) -> DataFrame:
    """(key, n, total, percentage of the grand total), by total and key; the first n or all. The grand
    total is the sum of the group totals, so the input is read once."""
    groups = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    grand = groups.agg(F.sum("total").alias("_grand"))
    out = groups.join(F.broadcast(grand)).withColumn("percentage", F.round(F.coalesce(F.try_divide(F.col("total") * 100.0, F.col("_grand")), F.lit(0.0)), 4)).drop("_grand")  # grand is one row
    return out if n is None else out.orderBy(F.desc("total"), "key").limit(n)


def period_totals(df: DataFrame, keys: Sequence[str], value: str = "value", when: str = "event_date") -> DataFrame:
    """One row: records, total, average, distinct values of each key, first and last date."""
    distinct = [F.count_distinct(k).alias(f"n_{k}") for k in keys]
    return df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.avg(value).alias("average"), *distinct, F.min(when).alias("first_date"), F.max(when).alias("last_date"))


def insight_rows(df: DataFrame, destination: str = "destination", beneficiary: str = "beneficiary", value: str = "value") -> DataFrame:
    """(kind, text): the destination and the beneficiary with the highest totals, and the average."""

    def top(key: str, kind: str, words: str) -> DataFrame:
        totals = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.sum(value).alias("t"))
        best = totals.agg(F.max(F.struct("t", "k")).alias("b"))
        return best.select(F.lit(kind).alias("kind"), F.concat(F.lit(words), F.col("b.k"), F.lit(": "), F.col("b.t").cast("decimal(18,2)").cast("string")).alias("text"))

    average = df.agg(F.avg(value).alias("a")).select(F.lit("average").alias("kind"), F.concat(F.lit("Average value: "), F.col("a").cast("decimal(18,2)").cast("string")).alias("text"))
    return top(destination, "top_destination", "Highest total by destination: ").unionByName(average).unionByName(top(beneficiary, "top_beneficiary", "Highest total by beneficiary: "))


MANIFEST = (
    "category string, partition_path string, row_count int, source_url string, source_hash string, extractor_version string, extracted_at timestamp,"
    " valid_until timestamp, is_frozen boolean, version int, keys array<string>, schema string"
)
#: What stands for a null in a partition's name.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Digits of the sketches of distinct values, in bits: their standard error is about 1.04 / sqrt(2 ** SKETCH).
SKETCH = 12


def partition_path(keys: Sequence[str]) -> Column:
    """A partition's name by the values of its keys."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(NULL_NAME))) for k in keys))


def _top(path: str, category: str, version: int | None = None) -> str:
    return f"{path}/data/category={category}" + ("" if version is None else f"/version={version}")


def write_lake(df: DataFrame, path: str, category: str, keys: Sequence[str], meta: dict[str, str], extracted_at: datetime, valid_until: datetime, frozen: bool = False, states: tuple[Sequence[str], str, str] | None = None) -> DataFrame:
    """Write df as a new version of its partitions (by keys) of a category, then publish one provenance row for each of them.
    Nothing that was written before is touched: readers take of each partition the version that its newest row names, so they
    see all of a write or nothing, and what a writer that died has left isn't seen. Rows are dealt by their keys before, so
    that a partition has a few files of the advisory size, and a large one is split; counts are of what was written, from
    file footers. `states` (count_keys, value, when) also stores partial totals by day, for totals_of_period(). One writer at a time.
    Gives the manifest."""
    spark = df.sparkSession
    number = versions.latest(spark, f"{path}/manifest")[0] + 1
    target = _top(path, category, number)
    df.hint("rebalance", *(F.col(f"`{k}`") for k in keys)).write.mode("overwrite").partitionBy(*keys).parquet(target)
    new = spark.read.schema(df.schema).parquet(target)
    if states is not None:
        partial_totals(new, *states, keys).write.mode("overwrite").parquet(f"{path}/states/category={category}/version={number}")
    own = new.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count(F.lit(1)).cast("int").alias("row_count"))
    values = {k: F.lit(meta[k]) for k in ("source_url", "source_hash", "extractor_version")}
    values |= {"extracted_at": F.lit(extracted_at).cast("timestamp"), "valid_until": F.lit(valid_until).cast("timestamp"), "is_frozen": F.lit(frozen), "version": F.lit(number), "keys": F.array(*map(F.lit, keys)), "schema": F.lit(df.schema.json())}
    rows = own.select(F.lit(category).alias("category"), partition_path(keys).alias("partition_path"), "row_count").withColumns(values)
    versions.publish(rows, f"{path}/manifest", number)
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All provenance rows that have been published."""
    whole = [versions.at_version(f"{path}/manifest", v) for v in versions.versions(spark, f"{path}/manifest")]
    return spark.read.schema(MANIFEST).parquet(*whole) if whole else spark.createDataFrame([], MANIFEST)


def newest(manifest: DataFrame) -> DataFrame:
    """The row of each partition that counts: that of its newest version."""
    rest = [c for c in manifest.columns if c not in ("category", "partition_path")]
    return manifest.groupBy("category", "partition_path").agg(F.max_by(F.struct(*rest), "version").alias("m")).select("category", "partition_path", "m.*")


def _shape(manifest: DataFrame, category: str) -> tuple[list[str], StructType, list[int]] | None:
    """(keys, columns, versions in use) of a category; the columns of its newest version."""
    own = newest(manifest).filter(F.col("category") == category)
    row = own.agg(F.max_by(F.struct("keys", "schema"), "version").alias("m"), F.collect_set("version").alias("v")).first()  # a number for each write
    return (list(row.m["keys"]), StructType.fromJson(json.loads(row.m["schema"])), sorted(row.v)) if row.m is not None else None


def read_lake(spark: SparkSession, path: str, category: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, missing) of a category: the rows of its wanted partitions (partition_path; all if none are named), each in the
    version that the manifest names, and the wanted partitions that it doesn't have. The manifest's rows are the small side of
    a join on partition columns, so Spark prunes the files by them as it runs; files of other versions aren't
    read. Columns are those of the newest version; older files give null for what they lack."""
    manifest = read_manifest(spark, path)
    shape = _shape(manifest, category)
    if shape is None:
        lost = spark.createDataFrame([], "partition_path string") if wanted is None else wanted.select("partition_path").distinct()
        return spark.createDataFrame([], StructType([])), lost
    keys, schema, used = shape
    here = newest(manifest).filter(F.col("category") == category).select("partition_path", "version")
    if wanted is not None:
        asked = wanted.select("partition_path").distinct()
        lost = asked.join(here, "partition_path", "left_anti")
        here = here.join(asked, "partition_path", "left_semi")
    else:
        lost = here.select("partition_path").limit(0)
    files = spark.read.schema(StructType([*schema, StructField("version", IntegerType())])).option("basePath", _top(path, category))
    rows = files.parquet(*(_top(path, category, v) for v in used))
    here = here.select(F.col("partition_path").alias("_path"), F.col("version").alias("_version"))
    joined = rows.join(here, (partition_path(keys) == F.col("_path")) & (F.col("version") == F.col("_version")))
    return joined.select(*(F.col(f"`{f.name}`") for f in schema)), lost


def partial_totals(df: DataFrame, count_keys: Sequence[str], value: str, when: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each partition and day: (partition_path, day, records, total, and a sketch of each of count_keys). Rows like these can be
    added up."""
    sketches = [F.hll_sketch_agg(F.col(f"`{k}`").cast("string"), SKETCH).alias(f"sketch_{k}") for k in count_keys]
    own = df.groupBy((partition_path(keys) if keys else F.lit("")).alias("partition_path"), F.col(f"`{when}`").cast("date").alias("day"))
    return own.agg(F.count(F.lit(1)).alias("records"), F.count(value).alias("valued"), F.sum(value).alias("total"), *sketches)


def read_states(spark: SparkSession, path: str, category: str) -> DataFrame:
    """The partial totals of a category's partitions, each of the version that the manifest names."""
    manifest = read_manifest(spark, path)
    shape = _shape(manifest, category)
    if shape is None:
        raise ValueError(f"nothing has been published for {category}")
    top = f"{path}/states/category={category}"
    here = newest(manifest).filter(F.col("category") == category).select("partition_path", "version")
    return spark.read.option("basePath", top).parquet(*(f"{top}/version={v}" for v in shape[2])).join(here, ["partition_path", "version"], "left_semi")


def totals_of_period(states: DataFrame, count_keys: Sequence[str], start: date | None = None, end: date | None = None) -> DataFrame:
    """One row like period_totals() of the days from start to end (both included), from partial totals: no record is read.
    Records, totals, averages and dates are exact; n_<key> are estimates, with a standard error of about 1.6 %."""
    own = states
    if start is not None:
        own = own.filter(F.col("day") >= F.lit(start))
    if end is not None:
        own = own.filter(F.col("day") <= F.lit(end))
    distinct = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{k}")), F.lit(0)).alias(f"n_{k}") for k in count_keys]
    out = own.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.try_divide(F.sum("total"), F.sum("valued")).alias("average"), *distinct, F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    return out


def coverage(wanted: DataFrame, manifest: DataFrame, now: datetime, force: bool = False) -> DataFrame:
    """Wanted (category, partition_path) with state: fresh, expired or missing. The latest manifest row of
    a partition counts; a frozen one never expires; with force nothing is fresh."""
    last = manifest.groupBy("category", "partition_path").agg(F.max_by(F.struct("valid_until", "is_frozen"), "extracted_at").alias("m"))
    ok = (F.col("m.is_frozen") | (F.col("m.valid_until") > F.lit(now).cast("timestamp"))) & F.lit(not force)
    return wanted.join(last, ["category", "partition_path"], "left").withColumn("state", F.when(F.col("m").isNull(), "missing").when(ok, "fresh").otherwise("expired")).drop("m")


def coverage_report(states: DataFrame) -> DataFrame:
    """One row: counts by state and hit_total, hit_partial or miss."""
    out = states.agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("fresh", "expired", "missing")))
    rest = F.col("n_expired") + F.col("n_missing")
    return out.withColumn("coverage", F.when(F.col("n_fresh") == 0, "miss").when(rest == 0, "hit_total").otherwise("hit_partial"))


def compare_periods(df: DataFrame, key: str, when: str, first: tuple[date, date], second: tuple[date, date], value: str = "value") -> DataFrame:
    """(key, first_total, second_total, difference) of two periods, begin and end included, in one pass."""
    inside = lambda p: (F.col(when) >= F.lit(p[0])) & (F.col(when) < F.date_add(F.lit(p[1]), 1))
    total = lambda p: F.coalesce(F.sum(F.when(inside(p), F.col(value))), F.lit(0))
    out = df.filter(inside(first) | inside(second)).groupBy(F.col(key).cast("string").alias("key")).agg(total(first).alias("first_total"), total(second).alias("second_total"))
    return out.withColumn("difference", F.col("second_total") - F.col("first_total"))
