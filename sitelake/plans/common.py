"""Tables of the driver and what several queries derive from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import text as T
from sitelake.functions import urls as U
from sitelake.operators import discovery


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, canonical, excluded, error, host, site (scheme and host)."""
    c = discovery.canonicalize_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return c.withColumns({"host": U.host_of(F.col("canonical")), "site": F.regexp_extract("canonical", "^[a-z]+://[^/?#]*", 0)})


CANON_SQL = r"""
canon_parts AS (
    SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme,
           lower(regexp_extract(url, '://([^/?#]*)', 1)) AS raw_host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS query
    FROM pages
),
canon_hosts AS (
    SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(raw_host, ':80$', '') ELSE regexp_replace(raw_host, ':443$', '') END AS host,
           list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|_ga|portal_form_id)(=|$)'))) AS kept
    FROM canon_parts
),
canon AS (
    SELECT page_id, url, host, scheme || '://' || host AS site,
           scheme || '://' || host || CASE WHEN path <> '/' THEN rtrim(path, '/') ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
           contains(path, '@@') OR contains(path, '++theme++') AS excluded, scheme NOT IN ('http', 'https') AS error
    FROM canon_hosts
)
"""

ROOT = "https://docs.example"


def doc_url() -> Column:
    return F.concat(F.lit(ROOT + "/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id"))


DOC_URL_SQL = f"'{ROOT}/' || coalesce(source, 'none') || '/' || doc_id"


def current_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a snapshot: canonical_url, content_hash, status by language."""
    status = F.when(F.col("lang") == "de", 304).when(F.col("lang") == "es", 404).otherwise(200)
    return table(spark, sf_dir, "documents").select(doc_url().alias("canonical_url"), T.hashed(F.coalesce("text", F.lit(""))).alias("content_hash"), status.alias("status"))


def prior_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as they were (other texts where the quality is 0), and the pages, which are gone."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    old = F.when(F.col("quality") == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    stamp = lambda c: F.when(c, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    seen = docs.select(doc_url().alias("canonical_url"), T.hashed(F.coalesce(old, F.lit(""))).alias("content_hash"), F.left("text", F.lit(40)).alias("mini_summary"), stamp(F.col("toxic") == 1).alias("stale_since"))
    pages = canonical_pages(spark, sf_dir).select("page_id", "canonical").join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    gone = pages.select(F.concat("canonical", F.lit("#"), "page_id").alias("canonical_url"), T.hashed(F.coalesce("html", F.lit(""))).alias("content_hash"), F.lit(None).cast("string").alias("mini_summary"), stamp(F.startswith("canonical", F.lit("http://"))).alias("stale_since"))
    return seen.unionByName(gone)


SNAPSHOT_SQL = rf"""
{CANON_SQL},
cur AS (
    SELECT {DOC_URL_SQL} AS canonical_url, 'sha256:' || sha256(coalesce(text, '')) AS content_hash,
           CASE lang WHEN 'de' THEN 304 WHEN 'es' THEN 404 ELSE 200 END AS status
    FROM documents
),
prior AS (
    SELECT {DOC_URL_SQL} AS canonical_url, 'sha256:' || sha256(coalesce(CASE WHEN quality = 0 THEN text || ' old' ELSE text END, '')) AS content_hash,
           left(text, 40) AS mini_summary, CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS stale_since
    FROM documents JOIN labels USING (doc_id)
    UNION ALL
    SELECT canonical || '#' || page_id, 'sha256:' || sha256(coalesce(html, '')), NULL, CASE WHEN starts_with(canonical, 'http://') THEN TIMESTAMP '2024-01-01 00:00:00' END
    FROM canon JOIN (SELECT page_id, html FROM pages) p USING (page_id)
)
"""
