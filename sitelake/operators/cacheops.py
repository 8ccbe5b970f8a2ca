"""Caches with a time limit, and operation metrics, as joins and aggregates over logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Seconds that a cached query and a cached document stay valid.
QUERY_TTL, DOCUMENT_TTL = 86_400, 604_800


#: Seconds of a key's entries and requests that are taken together.
SPAN_S = 3600


def _micros(name: str) -> Column:
    """Microseconds of a timestamp with or without a time zone."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def cache_lookup(requests: DataFrame, entries: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """Requests (request_id, key, ts) against entries (entry_id, key, set_at, ttl_s): the latest entry of
    the key at the time of the request decides miss, hit (age at most its ttl) or expired. At one instant
    entries come first, by id. Rows are tagged and united, and a running last() finds the entry within a span of
    time; where a span has none before, the last one of the spans before it counts. So no key is sorted in one task
    as a whole. Entries of keys that nobody asks for are left out before that."""
    asked = entries.join(requests.select("key").distinct(), "key", "left_semi")
    e = asked.select(F.md5("key").alias("cache_key"), F.col("set_at").alias("at"), F.lit(0).alias("kind"), F.col("entry_id").alias("id"), F.struct("set_at", "ttl_s").alias("entry"))
    r = requests.select(F.md5("key").alias("cache_key"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("request_id").alias("id"), F.lit(None).cast(e.schema["entry"].dataType).alias("entry"))
    rows = e.unionByName(r).withColumn("_span", F.floor(_micros("at") / (span_s * 1_000_000)))
    found = rows.withColumn("own", F.last("entry", ignorenulls=True).over(W.partitionBy("cache_key", "_span").orderBy("at", "kind", "id"))).filter("kind = 1")
    spans = rows.groupBy("cache_key", "_span").agg(F.max(F.when(F.col("kind") == 0, F.struct("at", "id", "entry"))).alias("_last"))
    before = W.partitionBy("cache_key").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(F.col("cache_key").alias("_key"), F.col("_span").alias("_of"), F.last("_last.entry", ignorenulls=True).over(before).alias("earlier"))
    joined = found.join(spans, F.col("cache_key").eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_of")))
    found = joined.withColumn("last", F.coalesce("own", "earlier"))
    age = (_micros("at") - _micros("last.set_at")) / 1e6
    status = F.when(F.col("last").isNull(), "miss").when(age <= F.col("last.ttl_s"), "hit").otherwise("expired")
    return found.select(F.col("id").alias("request_id"), "cache_key", status.alias("status"), age.alias("age_s"))


def expire_cache(entries: DataFrame, now: datetime, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, expired with age_s, stats by kind) of entries (kind, key, set_at, ttl_s, bytes). A dry run
    keeps all and still reports."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - _micros("set_at")) / 1e6
    aged = entries.withColumn("age_s", age)
    old = F.col("age_s") > F.col("ttl_s")
    stats = aged.groupBy("kind").agg(
        F.count_if(~old).alias("n_kept"),
        F.count_if(old).alias("n_expired"),
        F.sum(F.when(old, 0).otherwise(F.col("bytes"))).alias("bytes_kept"),
        F.sum(F.when(old, F.col("bytes")).otherwise(0)).alias("bytes_expired"),
    )
    kept = entries if dry_run else aged.filter(~old).drop("age_s")
    return kept, aged.filter(old), stats


def ops_metrics(log: DataFrame) -> DataFrame:
    """One row over an operation log (op, ok, bytes, value): cache hits and misses, rates in percent (0.0
    when nothing was counted), and totals."""
    op = F.col("op")
    out = log.agg(
        F.count_if((op == "cache") & F.col("ok")).alias("cache_hits"),
        F.count_if((op == "cache") & ~F.col("ok")).alias("cache_misses"),
        F.count_if((op == "extract") & F.col("ok")).alias("extractions_success"),
        F.count_if((op == "extract") & ~F.col("ok")).alias("extractions_failed"),
        F.count_if(op == "search").alias("searches"),
        F.count_if(op == "error").alias("errors"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when((op == "extract") & F.col("ok"), F.col("value"))), F.lit(0)).alias("total_value"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return out.withColumns({"hit_rate": rate("cache_hits", "cache_misses"), "success_rate": rate("extractions_success", "extractions_failed")})
