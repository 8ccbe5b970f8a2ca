"""Full-text search over a table of queries, from postings made on the way: matches of all terms, BM25 ranks, section filter. Every match
is scored; searchindex.py has an index that is stored, kept up to date and searched by its best blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.functions import text as T

K1, B = 1.2, 0.75
#: Parts of a saved index. Keep it when opening; choose it so that a part has a few hundred MB.
BUCKETS = 64
INDEXED = ("title", "mini_summary", "full_text")
# Fixed value: query signs that read as spaces.
QUERY_SIGNS = '"-+*():^'


def build_postings(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings(url, term, tf), doc_len(url, dl)) over the indexed columns of pages, whose urls are keys."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in INDEXED))
    tokens = pages.select("url", T.tokens(T.fold(text)).alias("terms"))
    # counted within the row: no shuffle
    postings = tokens.select("url", F.inline(T.counted(F.col("terms")))).select("url", "term", F.col("n").alias("tf"))
    return postings, tokens.select("url", F.size("terms").cast("long").alias("dl"))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def query_terms(query: Column) -> Column:
    """The distinct folded terms of a query; none if it is blank after cleaning."""
    return F.array_distinct(T.tokens(T.fold(F.translate(query, QUERY_SIGNS, " " * len(QUERY_SIGNS)))))


def _wanted(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms). Queries are the small side; Spark broadcasts them if their size allows."""
    return queries.select("query_id", query_terms(F.col("query")).alias("terms")).select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def _document_counts(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) of the wanted terms."""
    return postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _matches(postings: DataFrame, wanted: DataFrame, df: DataFrame) -> DataFrame:
    """(query_id, url, hits of term and tf) of the pages that have every term of a query, from its rarest one on: only the
    pages with that one are looked at for the others, so a frequent term costs no row for each of its queries and pages."""
    known = wanted.join(df, "term").groupBy("query_id", "n_terms").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "term")).alias("r"))
    rarest = known.filter("n = n_terms").select("query_id", F.col("r.term").alias("term"))
    first = postings.select("url", "term").join(rarest, "term").select("query_id", "url")
    asked = first.join(wanted, "query_id")
    hits = asked.join(postings.select("url", "term", "tf"), ["url", "term"])
    # a page has a term once, so the hits of a query and page are its terms
    whole = hits.groupBy("query_id", "url").agg(F.collect_list(F.struct("term", "tf")).alias("hits"), F.max("n_terms").alias("n_terms")).filter("size(hits) = n_terms")
    return whole.select("query_id", "url", "hits")


def match_all_terms(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, url) where the page has every term of the query."""
    wanted = _wanted(queries)
    return _matches(postings, wanted, _document_counts(postings, wanted)).select("query_id", "url")


def bm25_scores(queries: DataFrame, postings: DataFrame, doc_len: DataFrame) -> DataFrame:
    """(query_id, url, score) of all matches of all terms, scores rounded to 6 places."""
    wanted = _wanted(queries)
    stats = doc_len.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = _document_counts(postings, wanted)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(stats)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl")  # stats is one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = _matches(postings, wanted, df).select("query_id", "url", F.explode("hits").alias("h")).select("query_id", "url", "h.*")
    scored = hits.join(weights, "term").join(doc_len, "url").select("query_id", "url", "term", part.alias("part"))
    # parts are added in the order of their terms, so that a score doesn't depend on partitions
    parts = F.transform(F.array_sort(F.collect_list(F.struct("term", "part"))), lambda x: x["part"])
    out = scored.groupBy("query_id", "url").agg(parts.alias("parts"))
    return out.select("query_id", "url", F.round(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


def top_k(scores: DataFrame, k: int | Column = 10) -> DataFrame:
    """The best k of each query with rank; ties by url."""
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "url")
    return scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def clamp_limit(limit: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(limit, F.lit(10))))


def section_search(queries: DataFrame, postings: DataFrame, doc_len: DataFrame, pages: DataFrame, fetched: int = 200) -> DataFrame:
    """Queries (query_id, query, section, k): the best `fetched` pages (without a section: k), of these
    the ones whose section is the wanted one but for case, and the first k of them; total_found counts
    before the filter."""
    q = queries.select("query_id", "section", clamp_limit(F.col("k")).alias("k"))
    first = bm25_scores(queries, postings, doc_len).join(q, "query_id")
    first = top_k(first, F.when(F.col("section").isNotNull(), fetched).otherwise(F.col("k")))
    first = first.withColumn("total_found", F.count(F.lit(1)).over(W.partitionBy("query_id"))).drop("rank")
    hits = first.join(pages.select("url", F.col("section").alias("page_section")), "url")
    kept = hits.filter(F.col("section").isNull() | (F.col("section") == "") | (F.lower("page_section") == F.lower("section")))
    return top_k(kept, F.col("k")).select("query_id", "rank", "url", "score", "page_section", "total_found")
