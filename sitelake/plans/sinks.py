"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.operators import lake
from sitelake.plans import texts, values
from sitelake.plans.common import table
from sitelake.sources import io, pagetree
from sitelake.sources.work import work_path

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {texts._CATALOG} SELECT path, url, depth, page_type, child_count, has_docs FROM entries")
def write_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalog entries as they read back from the JSON files."""
    path, entries = work_path(spark, "catalog"), texts.build_catalog(spark, d)
    io.write_catalog(entries, texts.catalog.catalog_stats(entries), path)
    return spark.read.schema(entries.schema).json(f"{path}/entries").select("path", "url", "depth", "page_type", "child_count", "has_docs")


@query(f"WITH {values._RECORDS} SELECT category, beneficiary, destination, value::DOUBLE AS value FROM records")
def save_extract(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "extracts")
    io.save_extract(values._records(spark, d), path, "orders")
    return values.compared(io.load_extract(spark, path, "orders").select("category", "beneficiary", "destination", "value"))


@query("SELECT url AS loc, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS lastmod FROM pages")
def read_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps of all pages, of some 10,000 URLs each, written as gzip XML, and read."""
    path, pages = work_path(spark, "sitemap"), table(spark, d, "pages").select("page_id", "url")
    escaped = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>"), at, F.lit("</lastmod></url>"))
    n = max(1, pages.count() // 10_000)
    files = pages.groupBy(F.pmod(F.xxhash64("url", "page_id"), F.lit(n))).agg(F.array_join(F.collect_list(entry), "\n").alias("urls"))
    files.select(F.concat(F.lit("<urlset>\n"), "urls", F.lit("\n</urlset>")).alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return io.read_sitemap(spark, path)


@query(f"WITH {values._RECORDS} SELECT 'orders' AS category, 'destination=' || destination || '/year=' || year(event_date) AS partition_path, count(*)::INT AS row_count, false AS is_frozen FROM records GROUP BY destination, year(event_date)")
def write_lake(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after orders were written by state and year."""
    records = values._records(spark, d).withColumn("year", F.year("event_date"))
    meta = {"source_url": "https://site.example/orders", "source_hash": "-", "extractor_version": "1"}
    manifest = lake.write_lake(records, work_path(spark, "lake"), "orders", ["destination", "year"], meta, datetime(2024, 1, 1), datetime(2025, 1, 1))
    return manifest.select("category", "partition_path", "row_count", "is_frozen")


def _lake(spark: SparkSession, d: str) -> str:
    """A lake of orders by state and year, of which the finished ones (F) were written again with doubled values."""
    records, path = values._records(spark, d).withColumn("year", F.year("event_date")), work_path(spark, "lake")
    meta = {"source_url": "https://site.example/orders", "source_hash": "-", "extractor_version": "1"}
    states = (["beneficiary", "destination"], "value", "event_date")
    lake.write_lake(records, path, "orders", ["destination", "year"], meta, datetime(2024, 1, 1), datetime(2025, 1, 1), states=states)
    again = records.filter("destination = 'F'").withColumn("value", (F.col("value") * 2).cast("decimal(18,2)"))
    lake.write_lake(again, path, "orders", ["destination", "year"], meta, datetime(2024, 2, 1), datetime(2025, 2, 1), states=states)
    return path


_LAKE = f"{values._RECORDS}, now AS (SELECT * REPLACE (CASE WHEN destination = 'F' THEN value * 2 ELSE value END AS value) FROM records)"


@query(f"WITH {_LAKE} SELECT category, beneficiary, destination, event_date::VARCHAR AS event_date, value::DOUBLE AS value, year(event_date) AS year FROM now WHERE year(event_date) IN (1995, 1996) AND destination <> 'P'")
def read_lake(spark: SparkSession, d: str) -> DataFrame:
    """Two years of two states, by the names of their partitions."""
    wanted = spark.createDataFrame([(f"destination={s}/year={y}",) for s in "FO" for y in (1995, 1996)], "partition_path string")
    rows, _ = lake.read_lake(spark, _lake(spark, d), "orders", wanted)
    return values.compared(rows).withColumn("event_date", F.col("event_date").cast("string"))


@query(f"WITH {_LAKE} SELECT DISTINCT 'destination=' || s || '/year=' || y AS partition_path FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s), (SELECT unnest(range(1990, 2000)) AS y) WHERE NOT EXISTS (SELECT 1 FROM now WHERE destination = s AND year(event_date) = y)")
def lake_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Wanted partitions that the lake doesn't have."""
    wanted = spark.createDataFrame([(f"destination={s}/year={y}",) for s in "FOPX" for y in range(1990, 2000)], "partition_path string")
    return lake.read_lake(spark, _lake(spark, d), "orders", wanted)[1]


@query(f"WITH {_LAKE} SELECT count(*) AS records, sum(value)::DOUBLE AS total, round(sum(value)::DOUBLE / count(*), 4) AS average, true AS close, min(event_date)::VARCHAR AS first_date, max(event_date)::VARCHAR AS last_date FROM now WHERE event_date BETWEEN DATE '1995-02-10' AND DATE '1996-11-20'")
def totals_of_period(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a period from the partial totals beside the lake; close: whether the estimates of distinct values are within 8 % (five
    standard errors) of the exact ones."""
    keys, days = ["beneficiary", "destination"], (date(1995, 2, 10), date(1996, 11, 20))
    states = lake.read_states(spark, _lake(spark, d), "orders")
    totals = lake.totals_of_period(states, keys, *days)
    exact = lake.period_totals(lake.filter_period(values._records(spark, d), "event_date", *days), keys).select(*(F.col(f"n_{k}").alias(f"_{k}") for k in keys))
    close = F.lit(True)
    for k in keys:
        close = close & (F.abs(F.col(f"n_{k}") - F.col(f"_{k}")) <= F.col(f"_{k}") * 0.08)
    out = totals.join(F.broadcast(exact)).select("records", "total", F.round("average", 4).alias("average"), close.alias("close"), "first_date", "last_date")  # exact is one row
    return values.compared(out).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")}).withColumn("average", F.col("average").cast("double"))


@query("SELECT url, html AS description, (page_id % 5)::INT AS depth, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id)) AS extracted_us FROM pages WHERE page_id % 10 <> 3")
def load_page_tree(spark: SparkSession, d: str) -> DataFrame:
    """All pages as a tree of `_index.json` files that tasks write, of which a tenth is broken, and read back."""
    path = work_path(spark, "page-tree")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.struct((F.col("page_id") % 5).cast("int").alias("depth"), at.alias("extracted_at"))
    record = F.to_json(F.struct("url", F.col("html").alias("description"), meta.alias("metadata"), F.lit(1).alias("unknown")))
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 10 == 3, F.left(record, F.lit(20))).otherwise(record).alias("value"))
    pagetree.write_tree(rows.select(F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("folder"), "value"), path)
    pages, _ = pagetree.load_tree(spark, path)
    return pages.select("url", "description", "metadata.depth", F.unix_micros("metadata.extracted_at").alias("extracted_us"))
