"""Queries over two snapshots derived from documents, labels and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import text as T
from sitelake.operators import redirects, snapshots
from sitelake.plans.common import DOC_URL_SQL, ROOT, SNAPSHOT_SQL, current_pages, doc_url, prior_pages, table
from sitelake.sources.work import work_path
from sitelake.streaming import pagestore

QUERIES, ORACLE_SQL = {}, {}
NOW = datetime(2024, 3, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CHANGES = f"""{SNAPSHOT_SQL}, changes AS (
    SELECT c.*, CASE WHEN status >= 400 THEN 'failed' WHEN status = 304 THEN 'unchanged_304' WHEN p.canonical_url IS NULL THEN 'new' WHEN c.content_hash = p.content_hash THEN 'unchanged_hash' ELSE 'updated' END AS change
    FROM cur c LEFT JOIN prior p ON p.canonical_url = c.canonical_url)"""


@query(f"WITH {_CHANGES} SELECT * FROM changes")
def classify_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.classify_changes(current_pages(spark, d), prior_pages(spark, d))


@query(f"WITH {SNAPSHOT_SQL} SELECT c.canonical_url, c.content_hash, CASE WHEN c.content_hash = p.content_hash THEN p.mini_summary END AS mini_summary, NULL::TIMESTAMP AS stale_since FROM cur c LEFT JOIN prior p ON p.canonical_url = c.canonical_url")
def carry_forward_summaries(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.carry_forward_summaries(current_pages(spark, d), prior_pages(spark, d)).select("canonical_url", "content_hash", "mini_summary", "stale_since")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Links to all documents, with tracking and fragments in them; the labelled ones were visited."""
    return table(spark, d, "documents").select(F.concat(doc_url(), F.lit("/?utm_source=x#top")).alias("dst"))


@query(f"SELECT url FROM (SELECT {DOC_URL_SQL} AS url, source FROM documents) WHERE source <> 'src1' AND url NOT IN (SELECT {DOC_URL_SQL} FROM documents JOIN labels USING (doc_id))")
def orphan_urls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    visited = docs.join(table(spark, d, "labels"), "doc_id").select(doc_url().alias("canonical_url"))
    prefixes = docs.select("source").distinct().filter("source <> 'src1'").select(F.lit("docs.example").alias("host"), F.concat(F.lit(f"{ROOT}/"), "source").alias("prefix"))
    return snapshots.orphan_urls(_edges(spark, d), visited, prefixes)


_STALE = f"""{SNAPSHOT_SQL}, linked AS (SELECT canonical_url AS url FROM prior WHERE mini_summary IS NULL AND canonical_url LIKE '%/en/%'),
marked AS (SELECT canonical_url, content_hash, mini_summary,
    CASE WHEN canonical_url IN (SELECT canonical_url FROM cur WHERE status < 400) OR canonical_url IN (SELECT url FROM linked) THEN stale_since ELSE coalesce(stale_since, TIMESTAMP '2024-03-01 00:00:00') END AS stale_since FROM prior)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    prior = prior_pages(spark, d)
    visited = current_pages(spark, d).filter("status < 400").select(F.col("canonical_url").alias("url"))
    linked = prior.filter("mini_summary IS NULL AND canonical_url LIKE '%/en/%'").select(F.col("canonical_url").alias("url"))
    return snapshots.mark_stale(prior, visited, linked, NOW)


@query(f"WITH {_STALE} SELECT * FROM marked")
def mark_stale(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


@query(f"WITH {_STALE} SELECT canonical_url, coalesce(stale_since < TIMESTAMP '2024-01-31 00:00:00', false) AS removed FROM marked")
def purge_stale(spark: SparkSession, d: str) -> DataFrame:
    kept, removed = snapshots.purge_stale(_marked(spark, d), NOW, 30, confirm=True)
    return kept.select("canonical_url", F.lit(False).alias("removed")).unionByName(removed.select("canonical_url", F.lit(True).alias("removed")))


@query(
    f"""WITH p AS (SELECT {DOC_URL_SQL} AS url, sha256(text) AS h FROM documents), g AS (SELECT h, arg_min(url, (strlen(url), url)) AS c, count(*) AS n FROM p GROUP BY h)
    SELECT url, CASE WHEN n > 1 AND c <> url THEN c END AS canonical_of FROM p JOIN g USING (h)"""
)
def dedup_content(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(doc_url().alias("url"), F.sha2("text", 256).alias("content_hash"))
    return snapshots.dedup_content(pages).select("url", "canonical_of")


@query(
    f"""WITH {_CHANGES} SELECT count(*) FILTER (WHERE change = 'new') AS n_new, count(*) FILTER (WHERE change = 'updated') AS n_updated, count(*) FILTER (WHERE change LIKE 'unchanged%') AS n_unchanged,
    count(*) FILTER (WHERE change = 'failed') AS n_failed, (SELECT count(stale_since) FROM prior) AS n_stale, (SELECT count(*) FROM prior WHERE stale_since < TIMESTAMP '2024-01-31 00:00:00') AS n_removed FROM changes"""
)
def crawl_report(spark: SparkSession, d: str) -> DataFrame:
    prior = prior_pages(spark, d)
    return snapshots.crawl_report(classify_changes(spark, d), prior, snapshots.purge_stale(prior, NOW, 30, confirm=True)[1])


@query("SELECT CASE lang WHEN 'de' THEN 304 WHEN 'es' THEN 404 ELSE 200 END AS status, count(*) AS n FROM documents GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.status_histogram(current_pages(spark, d))


@query(
    f"""SELECT {DOC_URL_SQL} AS loc, lastmod, coalesce(lastmod <= extracted_at, false) AS skip FROM (
    SELECT d.doc_id, d.source, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_chars) AS lastmod, CASE WHEN quality IS NOT NULL THEN TIMESTAMP '2024-01-01 00:20:00' END AS extracted_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
)
def recrawl_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sitemap = docs.select(doc_url().alias("loc"), F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars")).alias("lastmod"))
    local = docs.join(table(spark, d, "labels"), "doc_id").select(doc_url().alias("canonical_url"), F.timestamp_seconds(F.lit(1704068400)).alias("extracted_at"))
    return snapshots.recrawl_candidates(sitemap, local)


_MERGE = f"""WITH s AS (SELECT {DOC_URL_SQL} AS url, 'old' AS v FROM documents JOIN labels USING (doc_id)),
u AS (SELECT CASE WHEN lang = 'de' THEN '{ROOT}/../' || doc_id WHEN lang = 'es' THEN 'https://elsewhere.example/' || doc_id ELSE {DOC_URL_SQL} END AS url, 'new' AS v, lang FROM documents),
x AS (SELECT {DOC_URL_SQL} AS url FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""


def _merge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    labelled = docs.join(labels, "doc_id")
    url = F.when(F.col("lang") == "de", F.concat(F.lit(f"{ROOT}/../"), "doc_id")).when(F.col("lang") == "es", F.concat(F.lit("https://elsewhere.example/"), "doc_id")).otherwise(doc_url())
    return snapshots.merge_pages(labelled.select(doc_url().alias("url"), F.lit("old").alias("v")), docs.select(url.alias("url"), F.lit("new").alias("v")), labelled.filter("toxic = 1").select(doc_url().alias("url")), ROOT)


@query(f"{_MERGE}, ok AS (SELECT url, v FROM u WHERE lang NOT IN ('de', 'es')) SELECT url, v FROM (SELECT * FROM ok UNION ALL SELECT * FROM s WHERE url NOT IN (SELECT url FROM ok)) WHERE url NOT IN (SELECT url FROM x)")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d)[0]


@query(f"{_MERGE}, ok AS (SELECT url, v FROM u WHERE lang NOT IN ('de', 'es')) SELECT url, v FROM (SELECT * FROM ok UNION ALL SELECT * FROM s WHERE url NOT IN (SELECT url FROM ok)) WHERE url NOT IN (SELECT url FROM x)")
def merge_pages_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream of changes in several batches, each of which touches some buckets of the table; removals and
    what they remove arrive in any order. The first batch is replayed at the end, which changes nothing."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    labelled = docs.join(labels, "doc_id")
    url = F.when(F.col("lang") == "de", F.concat(F.lit(f"{ROOT}/../"), "doc_id")).when(F.col("lang") == "es", F.concat(F.lit("https://elsewhere.example/"), "doc_id")).otherwise(doc_url())
    change = lambda df, url, v, at, gone: df.select(url.alias("url"), F.lit(v).alias("v"), F.lit(at).alias("at"), F.lit(gone).alias("deleted"))
    rows = change(labelled, doc_url(), "old", 1, False).unionByName(change(docs, url, "new", 2, False)).unionByName(change(labelled.filter("toxic = 1"), doc_url(), "gone", 3, True))
    source = work_path(spark, "page-changes")
    rows.repartition(3, F.xxhash64("url", "at")).write.parquet(source)
    store = pagestore.PageStore(spark, work_path(spark, "pages"), rows.schema, ROOT, "at", buckets=8)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store.follow(stream).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    store.apply(rows.limit(1), 0)
    return store.pages().select("url", "v")


@query(f"{_MERGE} SELECT url, v FROM u WHERE lang IN ('de', 'es')")
def merge_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d)[1]


@query(
    """WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed FROM events),
    r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
    SELECT user_id AS host, min(ts) AS started, max(ts) AS ended, count(*) AS n_failures, count(*) >= 2 AS opened FROM r WHERE failed GROUP BY user_id, run"""
)
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return snapshots.failure_runs(log, 2)


@query(f"SELECT {DOC_URL_SQL} AS url, 'sha256:' || sha256(text) AS full_text_hash, 'sha256:' || sha256(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "documents").select(doc_url().alias("url"), T.hashed(c("text")).alias("full_text_hash"), T.content_hash(c("source"), c("lang"), c("text")).alias("content_hash"))


def _redirects(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't English lead to the next one, Spanish ones two back: chains, and circles."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "lang").filter("lang <> 'en'")
    name = lambda c: F.concat(F.lit(f"{ROOT}/r/"), c.cast("string"))
    return docs.select(name(F.col("i")).alias("redirected_from"), name(F.col("i") + F.when(F.col("lang") == "es", -2).otherwise(1)).alias("url"))


@query(
    f"""WITH RECURSIVE e AS (SELECT '{ROOT}/r/' || doc_id AS u, '{ROOT}/r/' || (doc_id + CASE WHEN lang = 'es' THEN -2 ELSE 1 END) AS t FROM documents WHERE lang <> 'en'),
    w AS (SELECT u, t, 1 AS hops, [u] AS seen FROM e UNION ALL SELECT w.u, e.t, hops + 1, list_append(seen, e.u) FROM w JOIN e ON e.u = w.t WHERE NOT list_contains(seen, e.u)),
    ends AS (SELECT w.u, w.t, hops FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = w.t))
    SELECT e.u AS url, ends.t AS target, hops::BIGINT AS hops, ends.t IS NULL AS cyclic FROM e LEFT JOIN ends ON ends.u = e.u"""
)
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    return redirects.redirect_chains(redirects.redirects_of(_redirects(spark, d)))
