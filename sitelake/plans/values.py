"""Queries over orders, line items and events: money, attachments, caches, fetch logs, the lake."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.functions import text as T
from sitelake.operators import cacheops, lake, quality, values
from sitelake.plans.common import table
from sitelake.sources import io
from sitelake.sources.work import work_path
from sitelake.streaming import breaker
from sitelake.streaming import caching as streamcache

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def compared(df: DataFrame) -> DataFrame:
    """Decimals, alone or in arrays, as doubles: only here, where results are compared with another engine."""
    return df.withColumns({f.name: F.col(f.name).cast("double" if f.dataType.typeName() == "decimal" else "array<double>") for f in df.schema if "decimal" in f.dataType.simpleString()})


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """A document for each order: its priority in words and its price twice as 1.234,56."""
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    text = F.concat(F.lit("Pedido "), "o_orderkey", F.lit(": "), amount, F.lit("\nsoma (R$ "), amount, F.lit(") de 2024 12345,67"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("query_id"), F.lit(1).alias("pages"), text.alias("text"))


_PRICED = """priced AS (SELECT o_orderkey AS doc_id, o_custkey AS query_id, 'Pedido ' || o_orderkey || ': ' || a || chr(10) || 'soma (R$ ' || a || ') de 2024 12345,67' AS text, p
    FROM (SELECT *, o_totalprice::DECIMAL(18,2) AS p, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS a FROM orders))"""


@query(f"WITH {_PRICED} SELECT doc_id, [p::DOUBLE, p::DOUBLE] AS money FROM priced")
def money_values(spark: SparkSession, d: str) -> DataFrame:
    return compared(values.money_values(_priced(spark, d)).select("doc_id", "money"))


@query(f"WITH {_PRICED} SELECT doc_id, 1 AS pages, length(text) AS text_length, text AS preview, [p::DOUBLE, p::DOUBLE] AS money, 2 AS n_values, (p + p)::DOUBLE AS total FROM priced")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    return compared(values.value_summary(_priced(spark, d)))


@query(f"WITH {_PRICED} SELECT query_id, sum(p + p) FILTER (WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'))::DOUBLE AS total, CASE WHEN count(*) FILTER (WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) > 0 THEN count(*) FILTER (WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) * 2 END AS value_count FROM priced GROUP BY query_id")
def aggregate_sources(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") != "F").alias("success"))
    extracts = _priced(spark, d).withColumn("money", T.money_values(F.col("text")))
    sources = extracts.select("doc_id", "query_id", T.total(F.col("money")).alias("total"), F.size("money").alias("value_count")).join(status, "doc_id")
    return compared(values.aggregate_sources(sources))


def _attachments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of a customer, line items as their attachments."""
    ending = F.when(F.col("l_returnflag") == "A", ".csv").when(F.col("l_linestatus") == "F", ".XLSX").when(F.col("l_returnflag") == "R", ".pdf").otherwise(".zip")
    pages = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_rank"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("position"), F.concat(F.lit("https://files.example/"), "l_orderkey", F.lit("/"), "l_linenumber", ending).alias("url"))
    return pages.join(items, "o_orderkey")


_ATTACHED = """attached AS (
    SELECT o_orderkey, query_id, page_rank, l_linenumber AS position, 'https://files.example/' || l_orderkey || '/' || l_linenumber || CASE WHEN l_returnflag = 'A' THEN '.csv' WHEN l_linestatus = 'F' THEN '.XLSX' WHEN l_returnflag = 'R' THEN '.pdf' ELSE '.zip' END AS url
    FROM (SELECT o_orderkey, o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_rank FROM orders) o JOIN lineitem ON l_orderkey = o_orderkey
)"""
_TYPES = """CASE WHEN lower(url) LIKE '%.csv' THEN 'text/csv' WHEN lower(url) LIKE '%.xlsx' THEN 'application/vnd.ms-excel' ELSE 'application/pdf' END AS content_type,
    CASE WHEN lower(url) LIKE '%.csv%' THEN 'csv' WHEN lower(url) LIKE '%.xls%' THEN 'excel' ELSE 'pdf' END AS source_type"""


@query(f"WITH {_ATTACHED} SELECT url, {_TYPES}, CASE WHEN lower(url) LIKE '%.csv' OR lower(url) LIKE '%.xlsx' THEN 'spreadsheet' ELSE 'pdf' END AS extractor FROM attached")
def document_source_type(spark: SparkSession, d: str) -> DataFrame:
    return values.document_source_type(_attachments(spark, d).select("url"))


@query(
    f"""WITH {_ATTACHED}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_rank ORDER BY position, url) AS n FROM attached WHERE page_rank <= 3),
    p AS (SELECT *, CASE WHEN lower(url) LIKE '%.csv' THEN 1 WHEN lower(url) LIKE '%.xlsx' THEN 2 WHEN lower(url) LIKE '%.pdf' THEN 3 ELSE 4 END AS priority FROM f WHERE n <= 2)
    SELECT query_id, page_rank, position, url, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, page_rank, position, url) AS rank FROM p"""
)
def prioritize_documents(spark: SparkSession, d: str) -> DataFrame:
    return values.prioritize_documents(_attachments(spark, d).select("query_id", "page_rank", "position", "url"))


@query(f"""WITH {_ATTACHED} SELECT page_url, CASE WHEN has_url THEN url END AS url, method, success, CASE WHEN NOT has_url THEN 'source without a URL' END AS error, document_title, portal_section, CASE WHEN has_url THEN content_type END AS content_type, CASE WHEN has_url THEN source_type END AS source_type FROM (
    SELECT 'https://site.example/' || o_orderkey AS page_url, url, 'stub' AS method, url NOT LIKE '%.zip' AS has_url, url NOT LIKE '%.zip' AND url NOT LIKE '%.XLSX' AS success, 'title ' || o_orderkey AS document_title, o_orderpriority AS portal_section, {_TYPES} FROM attached JOIN (SELECT o_orderkey, o_orderpriority FROM orders) o USING (o_orderkey))""")
def source_provenance(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("https://site.example/"), "o_orderkey")
    pages = table(spark, d, "orders").select(page.alias("url"), F.concat(F.lit("title "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("section"))
    given = F.when(~F.endswith("url", F.lit(".zip")), F.col("url"))  # archives have lost their URL
    extracts = _attachments(spark, d).select(page.alias("page_url"), given.alias("url"), F.lit("stub").alias("method"), (~F.endswith("url", F.lit(".XLSX"))).alias("success"))
    return values.source_provenance(extracts, pages)


@query("SELECT count(*) AS n_rows, 6 AS n_columns, ['event_id', 'ts', 'user_id', 'event_type', 'valor', 'props'] AS column_names, round(sum(value), 2) AS total FROM events")
def csv_profile(spark: SparkSession, d: str) -> DataFrame:
    return io.csv_profile(table(spark, d, "events").withColumnRenamed("value", "valor")).withColumn("total", F.round("total", 2))


@query(
    """WITH e AS (SELECT event_id, user_id::VARCHAR AS key, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id::VARCHAR AS key, ts FROM events WHERE event_type = 'view'),
    j AS (SELECT r.event_id, r.key, (epoch_us(r.ts) - epoch_us(e.ts)) / 1e6 AS age_s FROM r ASOF LEFT JOIN e ON r.key = e.key AND r.ts >= e.ts)
    SELECT event_id AS request_id, md5(key) AS cache_key, CASE WHEN age_s IS NULL THEN 'miss' WHEN age_s <= 86400 THEN 'hit' ELSE 'expired' END AS status, age_s FROM j"""
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("key", F.col("user_id").cast("string"))
    entries = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("entry_id"), "key", F.col("ts").alias("set_at"), F.lit(cacheops.QUERY_TTL).alias("ttl_s"))
    requests = e.filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), "key", "ts")
    return cacheops.cache_lookup(requests, entries)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    ttl = F.when(F.col("event_type") == "view", cacheops.QUERY_TTL).otherwise(cacheops.DOCUMENT_TTL)
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("key"), F.col("ts").alias("set_at"), ttl.alias("ttl_s"), F.octet_length("props").alias("bytes"))


_ENTRIES = """entries AS (SELECT event_type AS kind, event_id AS key, ts AS set_at, CASE WHEN event_type = 'view' THEN 86400 ELSE 604800 END AS ttl_s, strlen(props) AS bytes, (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 1e6 AS age_s FROM events)"""
_NOW = datetime(2024, 1, 20, 12)


@query(f"WITH {_ENTRIES} SELECT kind, count(*) FILTER (WHERE age_s <= ttl_s) AS n_kept, count(*) FILTER (WHERE age_s > ttl_s) AS n_expired, coalesce(sum(bytes) FILTER (WHERE age_s <= ttl_s), 0)::BIGINT AS bytes_kept, coalesce(sum(bytes) FILTER (WHERE age_s > ttl_s), 0)::BIGINT AS bytes_expired FROM entries GROUP BY kind")
def expire_cache(spark: SparkSession, d: str) -> DataFrame:
    return cacheops.expire_cache(_entries(spark, d), _NOW)[2]


@query(f"WITH {_ENTRIES} SELECT kind, key, age_s FROM entries WHERE age_s > ttl_s")
def expired_entries(spark: SparkSession, d: str) -> DataFrame:
    return cacheops.expire_cache(_entries(spark, d), _NOW)[1].select("kind", "key", "age_s")


@query(
    """WITH l AS (SELECT *, CASE event_type WHEN 'view' THEN 'cache' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'extract' ELSE event_type END AS op, value < 50 AS ok, strlen(props) AS bytes FROM events),
    c AS (SELECT count(*) FILTER (WHERE op = 'cache' AND ok) AS cache_hits, count(*) FILTER (WHERE op = 'cache' AND NOT ok) AS cache_misses, count(*) FILTER (WHERE op = 'extract' AND ok) AS extractions_success, count(*) FILTER (WHERE op = 'extract' AND NOT ok) AS extractions_failed,
        count(*) FILTER (WHERE op = 'search') AS searches, count(*) FILTER (WHERE op = 'error') AS errors, sum(bytes)::BIGINT AS total_bytes, sum(value::DECIMAL(18,2)) FILTER (WHERE op = 'extract' AND ok)::DOUBLE AS total_value FROM l)
    SELECT *, 100.0::DOUBLE * cache_hits / (cache_hits + cache_misses) AS hit_rate, 100.0::DOUBLE * extractions_success / (extractions_success + extractions_failed) AS success_rate FROM c"""
)
def ops_metrics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "view", "cache").when(kind == "click", "search").when(kind == "purchase", "extract").otherwise(kind)
    log = table(spark, d, "events").select(op.alias("op"), (F.col("value") < 50).alias("ok"), F.octet_length("props").alias("bytes"), F.col("value").cast("decimal(18,2)").alias("value"))
    return compared(cacheops.ops_metrics(log))


@query(
    """WITH l AS (SELECT event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'signup' THEN NULL ELSE 200 END AS status, CASE WHEN event_type = 'signup' THEN CASE WHEN value < 20 THEN 'dial tcp: I/O timeout' ELSE 'bad scheme' END END AS error,
        CASE WHEN event_type = 'error' THEN floor(value)::BIGINT - 10 WHEN event_type = 'click' THEN epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-20 12:00:00') END AS secs FROM events)
    SELECT event_id, CASE WHEN error IS NOT NULL THEN CASE WHEN contains(lower(error), 'i/o timeout') THEN 'transient' ELSE 'permanent' END WHEN status = 503 THEN 'transient' WHEN status < 400 THEN 'ok' ELSE 'permanent' END AS outcome,
        CASE WHEN secs IS NOT NULL THEN greatest(secs, 0) END::BIGINT AS retry_after_s, coalesce(secs > 60, false) AS long_pause FROM l"""
)
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "click", 404).when(kind == "signup", F.lit(None)).otherwise(200)
    error = F.when(kind == "signup", F.when(F.col("value") < 20, "dial tcp: I/O timeout").otherwise("bad scheme"))
    retry = F.when(kind == "error", (F.floor("value") - 10).cast("string")).when(kind == "click", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    log = table(spark, d, "events").select("event_id", status.alias("status"), error.alias("error"), retry.alias("retry_after"))
    return quality.fetch_outcomes(log, _NOW).select("event_id", "outcome", "retry_after_s", "long_pause")


_BREAKER = """WITH RECURSIVE o AS (
    SELECT user_id::VARCHAR AS host, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
),
r(host, rn, ts, name, failures, after, opened, moves) AS (
    SELECT DISTINCT host, 0::BIGINT, NULL::TIMESTAMP, 'closed', 0, 0, NULL::TIMESTAMP, []::VARCHAR[] FROM o
    UNION ALL
    SELECT host, rn, ts,
        CASE WHEN cur IN ('open', 'aborted') THEN cur WHEN NOT failed THEN 'closed' WHEN cur = 'closed' THEN CASE WHEN failures >= 1 THEN 'open' ELSE 'closed' END WHEN after >= 2 THEN 'aborted' ELSE 'half_open' END,
        CASE WHEN cur IN ('open', 'aborted') THEN failures WHEN NOT failed THEN 0 WHEN cur = 'closed' THEN failures + 1 ELSE failures END,
        CASE WHEN cur IN ('open', 'aborted') THEN after WHEN NOT failed OR cur = 'closed' AND failures >= 1 THEN 0 WHEN cur = 'closed' THEN after ELSE after + 1 END,
        CASE WHEN cur = 'closed' AND failed AND failures >= 1 THEN ts ELSE opened END,
        list_concat(CASE WHEN woke THEN ['open>half_open'] ELSE []::VARCHAR[] END,
            CASE WHEN cur = 'half_open' AND NOT failed THEN ['half_open>closed'] WHEN cur = 'closed' AND failed AND failures >= 1 THEN ['closed>open'] WHEN cur = 'half_open' AND after >= 2 THEN ['half_open>aborted'] ELSE []::VARCHAR[] END)
    FROM (
        SELECT o.host, o.rn, o.ts, o.failed, r.failures, r.after, r.opened, r.name = 'open' AND o.ts - r.opened >= INTERVAL 10 MINUTE AS woke,
               CASE WHEN r.name = 'open' AND o.ts - r.opened >= INTERVAL 10 MINUTE THEN 'half_open' ELSE r.name END AS cur
        FROM r JOIN o ON o.host = r.host AND o.rn = r.rn + 1
    )
)
SELECT host, ts, split_part(m, '>', 1) AS from_state, split_part(m, '>', 2) AS to_state FROM (SELECT host, ts, unnest(moves) AS m FROM r)"""


def _breaker_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))


@query(_BREAKER)
def failure_breaker(spark: SparkSession, d: str) -> DataFrame:
    """The breaker over the events of each user, replayed as a table."""
    moves = breaker.failure_breaker_batch(_breaker_log(table(spark, d, "events")), breaker.Breaker(most_failures=2))
    return moves.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_BREAKER)
def failure_breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream over the table's files that ends with them; its output is a table in the shared folder."""
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    moves, out = breaker.failure_breaker_stream(_breaker_log(events), breaker.Breaker(most_failures=2)), work_path(spark, "transitions")
    to = moves.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True)
    to.start().awaitTermination()
    return spark.read.schema(moves.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(ORACLE_SQL["cache_lookup"])
def cache_lookup_stream(spark: SparkSession, d: str) -> DataFrame:
    """cache_lookup as a stream over the events, in four batches that overlap in time; a last event far ahead moves the watermark past
    them all."""
    e = table(spark, d, "events").filter("event_type IN ('purchase', 'view')")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", float(cacheops.QUERY_TTL)).alias("ttl_s"))
    source, out = work_path(spark, "cache-events"), work_path(spark, "lookups")
    # a batch has what came within some weeks, but for a tenth that comes a batch later
    span = F.floor(F.unix_timestamp("ts") / (14 * 86400))
    rows.withColumn("part", span + (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).cast("int")).repartitionByRange(4, "part", "id").write.parquet(source)
    end = spark.createDataFrame([("", datetime(2100, 1, 1), -1, 1.0)], rows.schema)
    end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with streamcache.rocks(spark):
        found = streamcache.cache_lookup_stream(stream, late="3650 days")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streamcache.OUT).parquet(out)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("beneficiary"), F.col("o_orderstatus").alias("destination"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))


_RECORDS = "records AS (SELECT o_orderpriority AS category, o_custkey AS beneficiary, o_orderstatus AS destination, o_orderdate::DATE AS event_date, o_totalprice::DECIMAL(18,2) AS value FROM orders)"


@query(f"WITH {_RECORDS} SELECT * REPLACE (event_date::VARCHAR AS event_date, value::DOUBLE AS value) FROM records WHERE event_date >= DATE '1996-03-01' AND event_date < DATE '1996-04-01'")
def filter_period(spark: SparkSession, d: str) -> DataFrame:
    return compared(lake.filter_period(_records(spark, d), "event_date", year=1996, month=3)).withColumn("event_date", F.col("event_date").cast("string"))


@query(f"WITH {_RECORDS} SELECT category AS key, count(*) AS n, sum(value)::DOUBLE AS total, round(sum(value)::DOUBLE * 100 / (SELECT sum(value)::DOUBLE FROM records), 4) AS percentage FROM records GROUP BY category")
def grouped_analysis(spark: SparkSession, d: str) -> DataFrame:
    return compared(lake.grouped_analysis(_records(spark, d), "category"))


@query(f"WITH {_RECORDS} SELECT beneficiary::VARCHAR AS key, count(*) AS n, sum(value)::DOUBLE AS total, round(sum(value)::DOUBLE * 100 / (SELECT sum(value)::DOUBLE FROM records), 4) AS percentage FROM records GROUP BY beneficiary ORDER BY total DESC, key LIMIT 10")
def grouped_analysis_top10(spark: SparkSession, d: str) -> DataFrame:
    return compared(lake.grouped_analysis(_records(spark, d), "beneficiary", n=10))


@query(f"WITH {_RECORDS} SELECT count(*) AS records, sum(value)::DOUBLE AS total, round(sum(value)::DOUBLE / count(*), 4) AS average, count(DISTINCT beneficiary) AS n_beneficiary, count(DISTINCT destination) AS n_destination, min(event_date)::VARCHAR AS first_date, max(event_date)::VARCHAR AS last_date FROM records")
def period_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = lake.period_totals(_records(spark, d), ["beneficiary", "destination"])
    return compared(totals).withColumns({"average": F.round("average", 4), "first_date": F.col("first_date").cast("string"), "last_date": F.col("last_date").cast("string")})


@query(
    f"""WITH {_RECORDS}, a AS (SELECT destination AS k, sum(value) AS t FROM records GROUP BY 1), b AS (SELECT beneficiary::VARCHAR AS k, sum(value) AS t FROM records GROUP BY 1)
    SELECT 'top_destination' AS kind, 'Highest total by destination: ' || arg_max(k, (t, k)) || ': ' || max(t) AS text FROM a UNION ALL
    SELECT 'top_beneficiary', 'Highest total by beneficiary: ' || arg_max(k, (t, k)) || ': ' || max(t) FROM b UNION ALL
    SELECT 'average', 'Average value: ' || (sum(value) / count(*))::DECIMAL(18,2) FROM records"""
)
def insight_rows(spark: SparkSession, d: str) -> DataFrame:
    return lake.insight_rows(_records(spark, d))


_COVERED = f"""{_RECORDS}, parts AS (SELECT category, year(event_date) AS y, count(*)::INT AS n FROM records GROUP BY 1, 2),
manifest AS (SELECT category, 'year=' || y AS partition_path, y <= 1996 AS is_frozen, make_timestamp(y + 3, 1, 1, 0, 0, 0.0) AS valid_until FROM parts),
wanted AS (SELECT DISTINCT category, 'year=' || y AS partition_path FROM (SELECT category, unnest([year(event_date), year(event_date) + 2]) AS y FROM records)),
states AS (SELECT w.*, CASE WHEN m.category IS NULL THEN 'missing' WHEN is_frozen OR valid_until > TIMESTAMP '2001-06-01' THEN 'fresh' ELSE 'expired' END AS state FROM wanted w LEFT JOIN manifest m USING (category, partition_path))"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    """A manifest as if each year of a category had been written once, and a wish for two more years."""
    r = _records(spark, d).withColumn("y", F.year("event_date"))
    path = lambda c: F.concat(F.lit("year="), c.cast("string"))
    valid: Column = F.make_timestamp(F.col("y") + 3, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    manifest = r.select("category", "y").distinct().select("category", path(F.col("y")).alias("partition_path"), (F.col("y") <= 1996).alias("is_frozen"), valid.alias("valid_until"), F.lit("2001-01-01").cast("timestamp").alias("extracted_at"))
    wanted = r.select("category", F.explode(F.array(F.col("y"), F.col("y") + 2)).alias("y")).select("category", path(F.col("y")).alias("partition_path")).distinct()
    return lake.coverage(wanted, manifest, datetime(2001, 6, 1))


@query(f"WITH {_COVERED} SELECT * FROM states")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


@query(f"WITH {_COVERED} SELECT count(*) FILTER (WHERE state = 'fresh') AS n_fresh, count(*) FILTER (WHERE state = 'expired') AS n_expired, count(*) FILTER (WHERE state = 'missing') AS n_missing, CASE WHEN count(*) FILTER (WHERE state = 'fresh') = 0 THEN 'miss' WHEN count(*) FILTER (WHERE state <> 'fresh') = 0 THEN 'hit_total' ELSE 'hit_partial' END AS coverage FROM states")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return lake.coverage_report(_coverage(spark, d))


@query(
    f"""WITH {_RECORDS} SELECT category AS key, coalesce(sum(value) FILTER (WHERE year(event_date) = 1996), 0)::DOUBLE AS first_total, coalesce(sum(value) FILTER (WHERE year(event_date) = 1997), 0)::DOUBLE AS second_total,
    (coalesce(sum(value) FILTER (WHERE year(event_date) = 1997), 0) - coalesce(sum(value) FILTER (WHERE year(event_date) = 1996), 0))::DOUBLE AS difference FROM records WHERE year(event_date) IN (1996, 1997) GROUP BY category"""
)
def compare_periods(spark: SparkSession, d: str) -> DataFrame:
    years = [(date(y, 1, 1), date(y, 12, 31)) for y in (1996, 1997)]
    return compared(lake.compare_periods(_records(spark, d), "category", "event_date", *years))
