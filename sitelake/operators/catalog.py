"""Catalog operators: compact entries, statistics, sections, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.functions import urls as U

SEPARATOR = " › "


def build_catalog(pages: DataFrame, root: str | None = None) -> DataFrame:
    """A compact entry for each page (url, title, section, parent_url, depth, page_type,
    has_substantive_content, mini_summary, n_documents, content_date), with child_count and has_docs.
    Paths are relative to `root`, or to each page's `prefix` without one. Sort by path when writing."""
    prefix = F.col("prefix") if root is None else F.lit(root)
    children = pages.filter("parent_url <> ''").groupBy(F.col("parent_url").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    joined = pages.join(children, F.col("url") == F.col("_of"), "left")
    return joined.select(
        U.relative_path(F.col("url"), prefix).alias("path"),
        "url",
        "title",
        "depth",
        F.col("parent_url").alias("parent"),
        "section",
        "page_type",
        "has_substantive_content",
        "mini_summary",
        F.coalesce("_n", F.lit(0)).cast("long").alias("child_count"),
        (F.col("n_documents") > 0).alias("has_docs"),
        "content_date",
    )


def catalog_stats(entries: DataFrame) -> DataFrame:
    """(dimension, key, n): total, and counts by depth and by page type. One pass over the entries, each of
    which counts in three groups; a row of zero makes the total of no entries zero."""
    group = lambda dimension, key: F.struct(F.lit(dimension).alias("dimension"), key.cast("string").alias("key"))
    counted = entries.select(F.explode(F.array(group("total", F.lit("")), group("depth", F.col("depth")), group("page_type", F.col("page_type")))).alias("g")).select("g.*", F.lit(1).alias("n"))
    none = entries.sparkSession.createDataFrame([("total", "", 0)], "dimension string, key string, n int")
    return counted.unionByName(none).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def stats_report(pages: DataFrame) -> DataFrame:
    """One row: pages, those without summary, with documents, all documents, stale pages."""
    return pages.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.coalesce("mini_summary", F.lit("")) == "").alias("n_without_summary"),
        F.count_if(F.col("n_documents") > 0).alias("n_with_docs"),
        F.coalesce(F.sum("n_documents"), F.lit(0)).cast("long").alias("n_documents"),
        F.count("stale_since").alias("n_stale"),
    )


def top_sections(entries: DataFrame, n: int = 15) -> DataFrame:
    """The n sections with most entries, by count and name; blank is (root)."""
    section = F.when(F.coalesce("section", F.lit("")) == "", "(root)").otherwise(F.col("section"))
    return entries.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "section").limit(n)


def inspect_pages(targets: DataFrame, pages: DataFrame, prefix: str) -> DataFrame:
    """Targets (target) resolved to a URL: full URLs as they are, others below the prefix, blank is the
    prefix; those with .. are rejected. With the page's title and breadcrumb, and found."""
    t = F.coalesce("target", F.lit(""))
    base = prefix.rstrip("/")
    url = F.when(t.rlike("(^|/)[.][.](/|$)"), None).when(t.rlike("^https?://"), t).when(t == "", base).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(t, "^/", "")))
    titles = F.filter("breadcrumb_titles", lambda x: x != "")
    crumbs = F.when(F.size("path_titles") > 0, F.array_join("path_titles", SEPARATOR)).when(F.size(titles) > 0, F.array_join(titles, SEPARATOR)).otherwise("—")
    own = pages.select(F.col("url").alias("_url"), "title", crumbs.alias("breadcrumb"))
    return targets.withColumn("url", url).join(own, F.col("url") == F.col("_url"), "left").withColumn("found", F.col("_url").isNotNull()).drop("_url")
