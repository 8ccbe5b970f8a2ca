"""Document values: money in texts, attachments by priority, totals with their sources, tabular lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.functions import text as T

# Words of a question that ask for amounts, and words of a table's head or foot.
VALUE_WORDS = ("quanto", "valor", "total", "gasto", "custo", "despesa", "gastos")
TABLE_WORDS = ("TOTAL", "VALOR", "DATA")
NO_URL = "source without a URL"


def money_values(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("money", T.money_values(F.coalesce(column, F.lit(""))))


def value_summary(docs: DataFrame) -> DataFrame:
    """Docs (doc_id, pages, text) with text_length, preview (first 1,000 characters), n_values, money, total."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", "pages", F.char_length(text).alias("text_length"), F.left(text, F.lit(1000)).alias("preview"), T.money_values(text).alias("money"))
    return out.withColumns({"n_values": F.size("money"), "total": T.total(F.col("money"))})


def document_source_type(urls: DataFrame) -> DataFrame:
    """Urls (url) with content_type by suffix (PDF if none is known), source_type by what the URL holds,
    and the extractor that takes it first."""
    u = F.lower("url")
    excel = F.endswith(u, F.lit(".xlsx")) | F.endswith(u, F.lit(".xls"))
    content = F.when(F.endswith(u, F.lit(".csv")), "text/csv").when(excel, "application/vnd.ms-excel").otherwise("application/pdf")
    source = F.when(F.contains(u, F.lit(".csv")), "csv").when(F.contains(u, F.lit(".xls")), "excel").otherwise("pdf")
    sheet = F.endswith(u, F.lit(".csv")) | excel
    return urls.withColumns({"content_type": content, "source_type": source, "extractor": F.when(sheet, "spreadsheet").otherwise("pdf")})


def prioritize_documents(documents: DataFrame, pages: int = 3, each: int = 2) -> DataFrame:
    """Documents (query_id, page_rank, position, url) of the first pages, the first `each` of each page, with
    priority csv < excel < pdf < other and rank by (priority, page, position, url)."""
    u = F.lower("url")
    priority = F.when(F.endswith(u, F.lit(".csv")), 1).when(F.endswith(u, F.lit(".xlsx")) | F.endswith(u, F.lit(".xls")), 2).when(F.endswith(u, F.lit(".pdf")), 3).otherwise(4)
    first = documents.filter(F.col("page_rank") <= pages).withColumn("_n", F.row_number().over(W.partitionBy("query_id", "page_rank").orderBy("position", "url"))).filter(F.col("_n") <= each)
    by = W.partitionBy("query_id").orderBy("priority", "page_rank", "position", "url")
    return first.withColumn("priority", priority).withColumn("rank", F.row_number().over(by)).drop("_n")


def needs_extraction(queries: DataFrame, words: Sequence[str] = VALUE_WORDS) -> DataFrame:
    low = F.lower(F.coalesce("query", F.lit("")))
    return queries.withColumn("needs_extraction", F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def aggregate_sources(sources: DataFrame) -> DataFrame:
    """Sources (query_id, total, value_count, success) as one row a query: the sum of totals above zero of
    successful sources and the count of their values, both null if there is no such total."""
    good = F.col("success") & (F.col("total") > 0)
    out = sources.groupBy("query_id").agg(F.sum(F.when(good, F.col("total"))).alias("total"), F.sum(F.when(F.col("success"), F.coalesce("value_count", F.lit(0)))).alias("n"))
    return out.select("query_id", "total", F.when(F.col("total").isNotNull(), F.col("n")).alias("value_count"))


def source_provenance(extracts: DataFrame, pages: DataFrame) -> DataFrame:
    """Extracts (page_url, url, method, success, error, file_size, extracted_at) with the title and section
    of their page. A source without a URL stays, without success and with an error, and has no types."""
    own = pages.select(F.col("url").alias("page_url"), F.col("title").alias("document_title"), F.col("section").alias("portal_section"))
    none, error = F.col("url").isNull(), F.col("error") if "error" in extracts.columns else F.lit(None).cast("string")
    judged = extracts.withColumns({"success": F.col("success") & ~none, "error": F.when(none, F.coalesce(error, F.lit(NO_URL))).otherwise(error)})
    typed = document_source_type(judged.join(own, "page_url", "left")).drop("extractor")
    return typed.withColumns({c: F.when(~none, F.col(c)) for c in ("content_type", "source_type")})


def table_lines(docs: DataFrame, words: Sequence[str] = TABLE_WORDS) -> DataFrame:
    """(doc_id, line_no, line, has_money, has_word, has_separator) of lines that look tabular."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    flags = {"has_money": F.col("line").rlike(T.MONEY), "has_word": F.upper("line").rlike("|".join(words)), "has_separator": F.col("line").rlike(r"\||\t|;|-{3,}")}
    return lines.withColumns(flags).filter("has_money OR has_word OR has_separator")
