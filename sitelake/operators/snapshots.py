"""Snapshot operators: what changed between a prior and a current set of pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.functions import urls as U
from sitelake.sources.work import written


#: Seconds of a host's log that are taken together.
SPAN_S = 3600


def _one_of_each(prior: DataFrame, *columns: str) -> DataFrame:
    """_url and _p (the columns): one row of each canonical URL, so that a prior that repeats URLs doesn't
    multiply pages. The latest by extracted_at if there is one; of ties that with the largest values."""
    latest = ["extracted_at"] if "extracted_at" in prior.columns else []
    return prior.groupBy(F.col("canonical_url").alias("_url")).agg(F.max(F.struct(*latest, *(c for c in columns if c not in latest))).alias("_p"))


def classify_changes(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Current (canonical_url, content_hash, status) with change: failed, unchanged_304, new,
    unchanged_hash or updated against the prior by canonical URL."""
    p = _one_of_each(prior, "content_hash").select("_url", F.col("_p.content_hash").alias("_hash"))
    joined = current.join(p, F.col("canonical_url") == F.col("_url"), "left")
    change = (
        F.when(F.col("status").isNull() | (F.col("status") >= 400), "failed")
        .when(F.col("status") == 304, "unchanged_304")
        .when(F.col("_url").isNull(), "new")
        .when((F.col("content_hash") == F.col("_hash")) & (F.col("content_hash") != ""), "unchanged_hash")
        .otherwise("updated")
    )
    return joined.withColumn("change", change).drop("_url", "_hash")


def carry_forward_summaries(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Current pages with the prior mini_summary where the non-empty content_hash is the same, else null;
    stale_since is cleared, since the page was seen."""
    p = _one_of_each(prior, "content_hash", "mini_summary").select("_url", F.col("_p.content_hash").alias("_hash"), F.col("_p.mini_summary").alias("_summary"))
    joined = current.drop("mini_summary", "stale_since").join(p, F.col("canonical_url") == F.col("_url"), "left")
    same = (F.col("content_hash") == F.col("_hash")) & (F.col("content_hash") != "")
    return joined.withColumns({"mini_summary": F.when(same, F.col("_summary")), "stale_since": F.lit(None).cast("timestamp")}).drop("_url", "_hash", "_summary")


def orphan_urls(edges: DataFrame, visited: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Canonical link targets in scope (host, prefix rows) that were not visited. Targets are made
    distinct before they are canonicalized."""
    targets = edges.select("dst").distinct().withColumn("_c", U.canonicalize(F.col("dst"))).filter("NOT _c.error AND NOT _c.excluded")
    targets = targets.select(F.col("_c.canonical").alias("url")).distinct().withColumn("_host", U.host_of(F.col("url")))
    scopes = prefixes.groupBy(F.col("host").alias("_host")).agg(F.collect_set("prefix").alias("_prefixes"))
    inside = targets.join(scopes, "_host").filter(F.exists("_prefixes", lambda p: U.in_scope(F.col("url"), p))).select("url")
    return inside.join(visited.select(F.col("canonical_url").alias("url")), "url", "left_anti")


def mark_stale(pages: DataFrame, visited: DataFrame, linked: DataFrame, now: datetime) -> DataFrame:
    """Pages neither visited nor linked get stale_since = now, unless they have a stamp."""
    seen = visited.select(F.col("url").alias("_url")).unionByName(linked.select(F.col("url").alias("_url"))).distinct().withColumn("_seen", F.lit(True))
    joined = pages.join(seen, F.col("canonical_url") == F.col("_url"), "left")
    stamp = F.when(F.col("_seen").isNull(), F.coalesce("stale_since", F.lit(now).cast("timestamp"))).otherwise(F.col("stale_since"))
    return joined.withColumn("stale_since", stamp).drop("_url", "_seen")


def purge_stale(pages: DataFrame, now: datetime, days: int = 30, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): pages stale for more than `days`. Without confirm nothing is removed."""
    old = F.coalesce(F.col("stale_since") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False)) & F.lit(bool(confirm))
    return pages.filter(~old), pages.filter(old)


def dedup_content(pages: DataFrame) -> DataFrame:
    """Pages with canonical_of: the shortest URL (then the first) of those with the same non-empty
    content_hash, null for that page itself and for unique ones. Aggregated first and joined, since blank
    pages can make one group very large; the groups are a written table, so that both sides of the join
    have an exchange of their own and adaptive execution can split that group."""
    one = F.min(F.struct(F.octet_length("url").alias("n"), F.col("url").alias("url")))
    groups = pages.filter("content_hash <> ''").groupBy(F.col("content_hash").alias("_hash")).agg(one.alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = pages.join(written(groups, "same-content"), F.col("content_hash") == F.col("_hash"), "left")
    return joined.withColumn("canonical_of", F.when(F.col("_first.url") != F.col("url"), F.col("_first.url"))).drop("_hash", "_first", "_n")


def crawl_report(changes: DataFrame, stale: DataFrame, removed: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    one = changes.agg(of("new").alias("n_new"), of("updated").alias("n_updated"), of("unchanged_hash", "unchanged_304").alias("n_unchanged"), of("failed").alias("n_failed"))
    return one.join(stale.agg(F.count("stale_since").alias("n_stale"))).join(removed.agg(F.count(F.lit(1)).alias("n_removed")))


def status_histogram(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.filter("status IS NOT NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def recrawl_candidates(sitemap: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """Sitemap (loc, lastmod) with skip: whether lastmod is no later than the local record; at most `most`
    rows, by loc."""
    p = pages.groupBy(F.col("canonical_url").alias("_url")).agg(F.max("extracted_at").alias("_at"))
    out = sitemap.join(p, F.col("loc") == F.col("_url"), "left").withColumn("skip", F.coalesce(F.col("lastmod") <= F.col("_at"), F.lit(False))).drop("_url", "_at")
    return out if most is None else out.orderBy("loc").limit(most)


def is_safe(url: Column, prefix: str) -> Column:
    """Whether a URL is below the prefix and has no segment that is blank, .. or begins with a dot."""
    rel = F.substr(U.bare(url), F.lit(len(prefix.rstrip("/")) + 2))
    segments = (rel == "") | ~F.exists(F.split(rel, "/"), lambda s: (s == "") | F.startswith(s, F.lit(".")))
    return F.coalesce(U.in_scope(url, F.lit(prefix)) & segments, F.lit(False))


def merge_pages(snapshot: DataFrame, updates: DataFrame, deletes: DataFrame, prefix: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects): updates by url replace or add, deletes remove. Updates outside the prefix or
    with an unsafe segment (blank, .., or with a leading dot) are rejected. Of several updates of one url the
    last by the column `order` is taken; of ties, or without it, that whose values are the largest as JSON."""
    good = is_safe(F.col("url"), prefix)
    row = F.struct(*(updates[f"`{c}`"] for c in updates.columns))
    last = F.struct(*([F.col(order)] if order else []), F.to_json(row))
    accepted = updates.filter(good).groupBy("url").agg(F.max_by(row, last).alias("_row")).select("_row.*")
    gone = accepted.select("url").unionByName(deletes.select("url")).distinct()
    return snapshot.join(gone, "url", "left_anti").select(snapshot.columns).unionByName(accepted.join(deletes.select("url"), "url", "left_anti").select(snapshot.columns)), updates.filter(~good)


def failure_runs(fetch_log: DataFrame, opened_at: int = 5, span_s: int = SPAN_S) -> DataFrame:
    """Runs of consecutive failures of a host: (host, started, ended, n_failures, opened). fetch_log:
    (host, ts, seq, failed); seq breaks ties of ts. Runs are found within spans of time, so that a host's whole
    log isn't sorted in one task, and what touches the edges of spans is put together: the runs at an edge
    that have as many spans with a success before them are one."""
    span = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (span_s * 1_000_000))
    log = fetch_log.select("host", "ts", "seq", F.coalesce("failed", F.lit(False)).alias("failed"), span.alias("_span"))
    order = W.partitionBy("host", "_span").orderBy("ts", "seq")
    own = log.withColumn("_run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order)).filter("failed")
    own = own.groupBy("host", "_span", "_run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("host").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = log.groupBy("host", "_span").agg(F.count_if(~F.col("failed")).alias("_good"))
    spans = spans.withColumn("_before", F.coalesce(F.sum((F.col("_good") > 0).cast("int")).over(before), F.lit(0)))
    spans = spans.select(F.col("host").alias("_host"), F.col("_span").alias("_of"), "_good", "_before")
    joined = own.join(spans, F.col("host").eqNullSafe(F.col("_host")) & F.col("_span").eqNullSafe(F.col("_of")))
    edge = F.when(F.col("_run") == 0, F.col("_before")).when(F.col("_run") == F.col("_good"), F.col("_before") + 1)
    inner = lambda c: F.when(edge.isNull(), F.col(c))
    out = joined.groupBy("host", edge.alias("_edge"), inner("_span").alias("_s"), inner("_run").alias("_r")).agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n_failures"))
    return out.select("host", "started", "ended", "n_failures", (F.col("n_failures") >= opened_at).alias("opened"))
