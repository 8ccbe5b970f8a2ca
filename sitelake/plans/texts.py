"""Queries over documents and conversations: summaries, keywords, catalog, search, enrichment, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import text as T
from sitelake.operators import catalog, citations, enrich, extract, quality, search, searchindex, values
from sitelake.plans.common import CANON_SQL, DOC_URL_SQL, ROOT, canonical_pages, doc_url, table
from sitelake.sources import versions
from sitelake.sources.work import is_kept, work_path

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _words(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT *, left(text, 450) AS a, substr(text, 451, 50) AS b FROM t)
    SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(
        CASE WHEN contains(b, chr(10) || chr(10)) THEN a || regexp_extract(b, '(?s)^(.*)\n\n', 1) WHEN regexp_matches(b, '[.!?]') THEN a || regexp_extract(b, '(?s)^.*[.!?]') ELSE a || b END, '^\s+|\s+$', '', 'g') END AS summary FROM c"""
)
def page_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.summary(F.coalesce("text", F.lit(""))).alias("summary"))


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents WHERE strlen(text) >= 50),
    c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE strlen(word) >= 3 AND word NOT IN ({_words(extract.STOPWORDS)}) GROUP BY doc_id, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c)
    SELECT doc_id, list(word ORDER BY r) AS keywords FROM r WHERE r <= 10 GROUP BY doc_id"""
)
def keywords_top10(spark: SparkSession, d: str) -> DataFrame:
    return extract.keywords_top10(table(spark, d, "documents"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the counters that a page has: lines as children, | as documents, # as internal links."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n")
    count = lambda sign: F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(sign), F.lit("")))
    return docs.select(
        "doc_id",
        doc_url().alias("url"),
        F.col("text").alias("full_text"),
        F.col("source").alias("section"),
        "lang",
        F.char_length("text").alias("content_length"),
        (F.size(lines) - 1).alias("n_children"),
        count("#").alias("n_internal"),
        F.octet_length(F.get(lines, 0)).alias("link_title_bytes"),
        count("|").alias("n_documents"),
        F.when(F.col("source") == "src2", 301).otherwise(200).alias("http_status"),
        F.when(F.col("source") == "src3", "").alias("redirected_from"),
    )


_FEATURES = rf"""features AS (
    SELECT doc_id, {DOC_URL_SQL} AS url, text AS full_text, source AS section, lang, length(text) AS content_length, string_split(text, chr(10)) AS ls,
           length(text) - length(replace(text, '#', '')) AS n_internal, length(text) - length(replace(text, '|', '')) AS n_documents, source = 'src2' AS redirected
    FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)
),
typed AS (
    SELECT *, len(ls) - 1 AS n_children, CASE WHEN redirected THEN 'redirect' WHEN content_length < 100 AND len(ls) = 1 AND n_documents = 0 AND n_internal < 3 THEN 'empty'
        WHEN len(ls) - 1 + n_documents >= 8 AND len(list_filter(ls, lambda x: strlen(regexp_replace(x, '^\s+|\s+$', '', 'g')) >= 160)) <= 2 THEN 'listing'
        WHEN content_length < 500 AND strlen(ls[1]) / greatest(content_length, 1) > 0.5 THEN 'landing' ELSE 'article' END AS page_type
    FROM features
)"""


@query(f"WITH {_FEATURES} SELECT doc_id, page_type, page_type IN ('article', 'listing') AS has_substantive_content FROM typed")
def classify_page_type(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_page_type(_features(spark, d)).select("doc_id", "page_type", "has_substantive_content")


def _catalog_pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as pages below their source, with a page for each source."""
    docs = quality.classify_page_type(_features(spark, d)).withColumn("title", F.col("lang"))
    summary = F.when(F.col("lang") == "en", F.left("full_text", F.lit(40))).otherwise("")
    cols = ["url", "title", "section", "page_type", "has_substantive_content", "n_documents"]
    own = docs.select(*cols, F.concat(F.lit(f"{ROOT}/"), F.coalesce("section", F.lit("none"))).alias("parent_url"), F.lit(2).alias("depth"), summary.alias("mini_summary"))
    tops = docs.groupBy("section").agg(F.lit(0).alias("n_documents")).select(
        F.concat(F.lit(f"{ROOT}/"), F.coalesce("section", F.lit("none"))).alias("url"), F.lit("top").alias("title"), F.lit("").alias("section"), F.lit("landing").alias("page_type"), F.lit(False).alias("has_substantive_content"), "n_documents", F.lit(ROOT).alias("parent_url"), F.lit(1).alias("depth"), F.lit("").alias("mini_summary")
    )
    return own.unionByName(tops).withColumns({"content_date": F.lit(None).cast("string"), "stale_since": F.when(F.col("title") == "de", F.lit("2024-01-01").cast("timestamp"))})


_CATALOG = f"""{_FEATURES}, pages_ AS (
    SELECT url, lang AS title, section, page_type, page_type IN ('article', 'listing') AS has_substantive_content, n_documents, '{ROOT}/' || coalesce(section, 'none') AS parent_url, 2 AS depth, CASE WHEN lang = 'en' THEN left(full_text, 40) ELSE '' END AS mini_summary FROM typed
    UNION ALL SELECT DISTINCT '{ROOT}/' || coalesce(section, 'none'), 'top', '', 'landing', false, 0, '{ROOT}', 1, '' FROM typed
),
entries AS (
    SELECT substr(url, length('{ROOT}/') + 1) AS path, url, title, depth, parent_url AS parent, section, page_type, has_substantive_content, mini_summary,
           coalesce((SELECT count(*) FROM pages_ c WHERE c.parent_url = p.url), 0) AS child_count, n_documents > 0 AS has_docs, NULL::VARCHAR AS content_date FROM pages_ p
)"""


@query(f"WITH {_CATALOG} SELECT * FROM entries")
def build_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.build_catalog(_catalog_pages(spark, d), ROOT)


@query(
    f"""WITH {_CATALOG} SELECT 'total' AS dimension, '' AS key, count(*) AS n FROM entries UNION ALL SELECT 'depth', depth::VARCHAR, count(*) FROM entries GROUP BY depth
    UNION ALL SELECT 'page_type', page_type, count(*) FROM entries GROUP BY page_type"""
)
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_stats(build_catalog(spark, d))


@query(
    f"""WITH {_CATALOG} SELECT count(*) AS n_pages, count(*) FILTER (WHERE mini_summary = '') AS n_without_summary, count(*) FILTER (WHERE n_documents > 0) AS n_with_docs,
    sum(n_documents)::BIGINT AS n_documents, count(*) FILTER (WHERE title = 'de') AS n_stale FROM pages_"""
)
def stats_report(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stats_report(_catalog_pages(spark, d))


@query(f"WITH {_CATALOG} SELECT CASE WHEN coalesce(section, '') = '' THEN '(root)' ELSE section END AS section, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def top_sections(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top_sections(build_catalog(spark, d))


@query(
    f"""WITH t AS (SELECT doc_id, source || '/' || doc_id AS target, {DOC_URL_SQL} AS url FROM documents UNION ALL SELECT -1 - doc_id, {DOC_URL_SQL} || '/x', {DOC_URL_SQL} || '/x' FROM documents UNION ALL SELECT NULL, 'a/../b', NULL)
    SELECT t.doc_id, target, t.url, lang AS title, CASE WHEN d.doc_id IS NOT NULL THEN CASE lang WHEN 'en' THEN source || ' › ' || lang WHEN 'de' THEN lang ELSE '—' END END AS breadcrumb, d.doc_id IS NOT NULL AS found
    FROM t LEFT JOIN documents d ON t.doc_id = d.doc_id"""
)
def inspect_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    paths = F.when(F.col("lang") == "en", F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    crumbs = F.when(F.col("lang") == "de", F.array(F.lit(""), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    pages = docs.select(doc_url().alias("url"), F.col("lang").alias("title"), paths.alias("path_titles"), crumbs.alias("breadcrumb_titles"))
    targets = docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("target"))
    targets = targets.unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(doc_url(), F.lit("/x")).alias("target"))).unionByName(spark.createDataFrame([(None, "a/../b")], "doc_id long, target string"))
    return catalog.inspect_pages(targets, pages, ROOT)


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(doc_url().alias("url"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("mini_summary"), F.col("text").alias("full_text"), F.col("source").alias("section"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all benchmark items, with signs around them; a section for some."""
    section = F.when(F.col("item_id") < 20, F.concat(F.lit("SRC"), F.col("item_id").cast("string")))
    cut = table(spark, d, "benchmark").select("item_id", section.alias("section"), F.posexplode(F.split("text", r"[.]\s*")).alias("pos", "words"))
    return cut.select((F.col("item_id") * 1000 + F.col("pos")).alias("query_id"), F.concat(F.lit('"'), "words", F.lit(":*")).alias("query"), "section", (F.col("item_id") + 1).alias("k"))


_SEARCH = rf"""toks AS (SELECT {DOC_URL_SQL} AS url, source, regexp_extract_all(strip_accents(lower(lang || '  ' || coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS ts FROM documents),
lens AS (SELECT url, source, len(ts) AS dl FROM toks),
post AS (SELECT url, term, count(*) AS tf FROM (SELECT url, unnest(ts) AS term FROM toks) GROUP BY url, term),
sentences AS (SELECT item_id, i - 1 AS pos, ws[i] AS words FROM (SELECT item_id, regexp_split_to_array(text, '[.]\s*') AS ws, unnest(range(1, len(ws) + 1)) AS i FROM benchmark)),
qs AS (SELECT item_id * 1000 + pos AS query_id, list_distinct(regexp_extract_all(strip_accents(lower(translate(words, '"-+*():^', '        '))), '[\p{{L}}\p{{N}}]+')) AS ts,
    CASE WHEN item_id < 20 THEN 'SRC' || item_id END AS section, greatest(1, least(50, item_id + 1)) AS k FROM sentences),
want AS (SELECT query_id, unnest(ts) AS term, len(ts) AS n_terms FROM qs),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
idfs AS (SELECT term, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 0) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
scores AS (
    SELECT query_id, url, source, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY term), 6) AS score
    FROM post JOIN want USING (term) JOIN idfs USING (term) JOIN lens USING (url), stats GROUP BY query_id, url, source HAVING count(*) = max(n_terms)
)"""


_indexes: dict[tuple[str, tuple], str] = {}


def search_index(spark: SparkSession, d: str) -> searchindex.SearchIndex:
    """The index of the documents, built at the first use in an application and again when their files change."""
    key = (spark.sparkContext.applicationId, versions.state_of(spark, f"{d}/documents.parquet"))
    if not is_kept(_indexes.get(key, "")):
        path = work_path(spark, "search-index")
        searchindex.SearchIndex(spark, path).update(_searched(spark, d))
        _indexes[key] = path
    return searchindex.SearchIndex(spark, _indexes[key])


@query(f"WITH {_SEARCH} SELECT url, term, tf FROM post")
def build_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.build_postings(_searched(spark, d))[0]


@query(f"WITH {_SEARCH} SELECT query_id, url FROM post JOIN want USING (term) GROUP BY query_id, url HAVING count(*) = max(n_terms)")
def match_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return searchindex.matches(search_index(spark, d), _queries(spark, d))


@query(f"WITH {_SEARCH} SELECT query_id, url, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM scores) WHERE rank <= 10")
def bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    return searchindex.best_pages(search_index(spark, d), _queries(spark, d).withColumn("k", F.lit(10)))[0]


@query(
    f"""WITH {_SEARCH}, one AS (SELECT s.*, q.section, q.k, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, url) AS r FROM scores s JOIN qs q ON q.query_id = s.query_id),
    two AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_found FROM one WHERE r <= CASE WHEN section IS NULL THEN k ELSE 200 END)
    SELECT query_id, rank, url, score, page_section, total_found FROM (SELECT query_id, url, score, source AS page_section, total_found, k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM two WHERE section IS NULL OR lower(source) = lower(section)) WHERE rank <= k"""
)
def section_search(spark: SparkSession, d: str) -> DataFrame:
    return searchindex.section_pages(search_index(spark, d), _queries(spark, d), _searched(spark, d))


@query(
    f"""WITH {_SEARCH.replace("FROM documents)", "FROM documents WHERE coalesce(lang, '') <> 'es')", 1).replace("lang || '  ' || coalesce(text, '')", "CASE WHEN lang = 'de' THEN left(text, 400) ELSE lang || '  ' || coalesce(text, '') END", 1)}
    SELECT query_id, url, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM scores) WHERE rank <= 10"""
)
def updated_index_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The search in an index made by updates: first all documents, then shorter texts of the German ones, then the Spanish
    ones removed; as a rebuild from what is left."""
    pages = _searched(spark, d).withColumn("lang", F.coalesce("title", F.lit("")))
    index = searchindex.SearchIndex(spark, work_path(spark, "search-index"))
    index.update(pages.filter("lang <> 'fr'").drop("lang"))
    short = pages.filter("lang = 'de'").withColumns({"title": F.lit(""), "full_text": F.left("full_text", F.lit(400))})
    index.update(short.drop("lang"), pages.filter("lang = 'es'").select("url"))
    index.update(pages.filter("lang = 'fr'").drop("lang"))
    return searchindex.best_pages(index, _queries(spark, d).withColumn("k", F.lit(10)))[0]


def search_block_report(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks each query's terms share, and how many of these were scored."""
    return searchindex.best_pages(search_index(spark, d), _queries(spark, d).withColumn("k", F.lit(10)))[1]


QUERIES["search_block_report"] = search_block_report


def _summarized(spark: SparkSession, d: str) -> DataFrame:
    docs = quality.classify_page_type(_features(spark, d)).join(table(spark, d, "labels"), "doc_id", "left")
    full = T.hashed(F.col("full_text"))
    return docs.withColumns({"full_text_hash": full, "summary_text": F.when(F.col("toxic") == 0, F.left("full_text", F.lit(20))), "summary_hash": F.when(F.col("quality") == 1, full)})


@query(
    f"""WITH {_FEATURES} SELECT doc_id, CASE WHEN page_type = 'empty' THEN 'empty_content' WHEN page_type = 'redirect' THEN 'redirect' WHEN toxic = 0 AND quality = 1 AND left(full_text, 20) <> '' THEN 'up_to_date' ELSE 'todo' END AS reason
    FROM typed LEFT JOIN labels USING (doc_id)"""
)
def select_for_summary(spark: SparkSession, d: str) -> DataFrame:
    todo, skipped = enrich.select_for_summary(_summarized(spark, d))
    return todo.select("doc_id", F.lit("todo").alias("reason")).unionByName(skipped.select("doc_id", "reason"))


def _prompted(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("full_text", "\n")
    docs = quality.classify_page_type(_features(spark, d)).withColumns({"title": F.col("lang"), "path_titles": F.array("section", "lang"), "child_titles": F.slice(lines, 2, 1_000_000_000)})
    return enrich.render_prompts(docs)


def _prompt_sql() -> str:
    """The templates as nested replacements."""
    t = {k: v.replace("'", "''").replace("\n", "' || chr(10) || '") for k, v in enrich.TEMPLATES.items()}
    out = f"CASE page_type WHEN 'landing' THEN '{t['landing']}' WHEN 'listing' THEN '{t['listing']}' ELSE '{t['article']}' END"
    for mark, value in (("title", "lang"), ("section", "coalesce(section, '')"), ("path", "array_to_string([section, lang], ' › ')"), ("children", "array_to_string(ls[2:16], ', ')"), ("n_documents", "n_documents::VARCHAR"), ("n_children", "(len(ls) - 1)::VARCHAR"), ("excerpt", "left(full_text, 1500)")):
        out = f"replace({out}, '{{{mark}}}', {value})"
    return out


@query(f"WITH {_FEATURES} SELECT doc_id, {_prompt_sql()} AS prompt FROM typed")
def render_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d).select("doc_id", "prompt")


def _stub(prompt: str) -> tuple[str, int, int]:
    if "|" in prompt:
        raise ValueError("a table")
    return " ".join(prompt.split(" ")[-9:]), len(prompt), 9


def _results(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich_batches(_prompted(spark, d), _stub)


@query(f"WITH {_FEATURES}, p AS (SELECT url, {_prompt_sql()} AS prompt FROM typed) SELECT url, CASE WHEN contains(prompt, '|') THEN 'ValueError' END AS error_class, CASE WHEN contains(prompt, '|') THEN 0 ELSE length(prompt) END AS tokens_in, CASE WHEN contains(prompt, '|') THEN 0 ELSE 9 END AS tokens_out FROM p")
def enrich_batches(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("url", "error_class", "tokens_in", "tokens_out")


@query(ORACLE_SQL["enrich_batches"])
def enrich_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same with a log that a run before left half full."""
    prompts, log = _prompted(spark, d), work_path(spark, "results")
    enrich.enrich_resumable(prompts.filter("doc_id % 2 = 0"), _stub, log, buckets=8, flush=200)  # the run before
    return enrich.enrich_resumable(prompts, _stub, log, buckets=8, flush=200).select("url", "error_class", "tokens_in", "tokens_out")


@query(
    f"""WITH {_FEATURES}, p AS (SELECT {_prompt_sql()} AS prompt FROM typed) SELECT count(*) FILTER (WHERE NOT contains(prompt, '|')) AS n_generated, count(*) FILTER (WHERE contains(prompt, '|')) AS n_failed,
    sum(CASE WHEN contains(prompt, '|') THEN 0 ELSE length(prompt) END)::BIGINT AS tokens_in, sum(CASE WHEN contains(prompt, '|') THEN 0 ELSE 9 END)::BIGINT AS tokens_out,
    (SELECT count(*) FROM typed WHERE page_type IN ('empty', 'redirect')) AS n_skipped, count(*) + (SELECT count(*) FROM typed WHERE page_type IN ('empty', 'redirect')) AS n_total FROM p"""
)
def summarize_report(spark: SparkSession, d: str) -> DataFrame:
    skipped = enrich.select_for_summary(_summarized(spark, d), force=True)[1]
    return enrich.summarize_report(_results(spark, d), skipped)[0]


@query(f"WITH {_FEATURES}, p AS (SELECT {_prompt_sql()} AS prompt FROM typed) SELECT 'ValueError' AS reason, count(*) AS n FROM p WHERE contains(prompt, '|') HAVING count(*) > 0")
def summary_failures(spark: SparkSession, d: str) -> DataFrame:
    return enrich.summarize_report(_results(spark, d), _summarized(spark, d))[1]


@query(
    """WITH u AS (SELECT conv_id, turn, role, length(text) AS a, len(string_split(text, ' ')) AS b FROM conversations)
    SELECT conv_id, turn, round((CASE role WHEN 'assistant' THEN a / 1e6 * 3.0 + b / 1e6 * 15.0 WHEN 'user' THEN a / 1e6 * 0.25 + b / 1e6 * 1.25 ELSE 0.0 END)::DOUBLE, 9) AS cost FROM u"""
)
def estimate_cost(spark: SparkSession, d: str) -> DataFrame:
    by = lambda a, u, other: F.when(F.col("role") == "assistant", a).when(F.col("role") == "user", u).otherwise(other)
    usage = table(spark, d, "conversations").select("conv_id", "turn", by("Acme", "acme", "other").alias("provider"), by("Large-4-1", "small-2", "large-4").alias("model"), F.char_length("text").alias("tokens_in"), F.size(F.split("text", " ")).alias("tokens_out"))
    prices = spark.createDataFrame([(1, "acme", "large-4", 3.0, 15.0), (2, "acme", "large", 15.0, 75.0), (3, "acme", "small", 0.25, 1.25)], "rank int, provider string, model_prefix string, in_per_mtok double, out_per_mtok double")
    return enrich.estimate_cost(usage, prices).select("conv_id", "turn", F.round("cost", 9).alias("cost"))


@query(rf"SELECT doc_id, i - 1 AS line_no, line, regexp_matches(line, '\b\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}\b') AS has_money, regexp_matches(upper(line), 'TOTAL|VALOR|DATA') AS has_word, regexp_matches(line, '\||\t|;|-{{3,}}') AS has_separator FROM (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(ls) + 1)) AS i FROM documents)) WHERE regexp_matches(line, '\b\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}\b') OR regexp_matches(upper(line), 'TOTAL|VALOR|DATA') OR regexp_matches(line, '\||\t|;|-{{3,}}')")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    return values.table_lines(table(spark, d, "documents"))


@query(f"SELECT doc_id, {' OR '.join(f'''contains(lower(coalesce(text, '')), '{w}')''' for w in values.VALUE_WORDS)} AS needs_extraction FROM documents")
def needs_extraction(spark: SparkSession, d: str) -> DataFrame:
    return values.needs_extraction(table(spark, d, "documents").select("doc_id", F.col("text").alias("query"))).select("doc_id", "needs_extraction")


@query(
    rf"""WITH {CANON_SQL}, m AS (SELECT regexp_extract(html, 'lang="([^"]*)"', 1) AS conv_id, page_id AS turn, site, canonical FROM canon JOIN (SELECT page_id, html FROM pages) p USING (page_id)),
    t AS (SELECT conv_id, turn, 'x **URL:** ' || canonical || chr(10) || '**URL:** ftp://no' || chr(10) || '**URL:**  ' || site || '/single and more' AS text FROM m),
    f AS (SELECT conv_id, turn, regexp_extract_all(text, '[*][*]URL:[*][*]\s+(https?://\S+)', 1) AS us FROM t)
    SELECT conv_id, turn, (i - 1)::INTEGER AS pos, us[i] AS url FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM f)"""
)
def extract_urls(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("x **URL:** "), "canonical", F.lit("\n**URL:** ftp://no\n**URL:**  "), "site", F.lit("/single and more"))
    return citations.extract_urls(_messages(spark, d).select("conv_id", "turn", text.alias("text")))


def _result_text(site: Column, url: Column, lang: Column) -> Column:
    """Two results and one page, as a tool would print them."""
    return F.concat(
        F.lit("# Results\n\n## 1. Page in "), lang, F.lit("\n**Seção:** "), lang, F.lit("\n**URL:** "), url, F.lit("\n\n## 2.  Site \nno section\n**URL:** "), site,
        F.lit("\n\n# Single\n**URL:** "), site, F.lit("/single\n\n## Breadcrumb\nHome > "), lang, F.lit("\n\nend"),
    )


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """A conversation for each language, a turn for each of its pages."""
    html = table(spark, d, "pages").select("page_id", F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("lang"))
    p = canonical_pages(spark, d).join(html, "page_id")
    return p.select(F.col("lang").alias("conv_id"), F.col("page_id").alias("turn"), _result_text(F.col("site"), F.col("canonical"), F.col("lang")).alias("text"), "site", "canonical")


_CITED = rf"""{CANON_SQL}, m AS (SELECT regexp_extract(html, 'lang="([^"]*)"', 1) AS conv_id, page_id AS turn, site, canonical FROM canon JOIN (SELECT page_id, html FROM pages) p USING (page_id)),
told AS (
    SELECT conv_id, turn, E'# Results\n\n## 1. Page in ' || conv_id || E'\n**Seção:** ' || conv_id || E'\n**URL:** ' || canonical || E'\n\n## 2.  Site \nno section\n**URL:** ' || site
        || E'\n\n# Single\n**URL:** ' || site || E'/single\n\n## Breadcrumb\nHome > ' || conv_id || E'\n\nend' AS text FROM m
),
lines AS (SELECT conv_id, turn, i, ls[i] AS line, ls[i - 1] AS above FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM told)),
heads AS (SELECT *, CASE WHEN regexp_matches(line, '^## [0-9]+[.]') THEN trim(regexp_replace(line, '^## [0-9]+[.]', '')) END AS head FROM lines),
spans AS (SELECT *, count(head) OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM heads),
results AS (
    SELECT conv_id, turn, k - 1 AS pos, max(head) AS title, coalesce(max(trim(regexp_extract(line, '[*]Seção:[*][*](.*)$', 1))) FILTER (WHERE contains(line, '**Seção:**')), '') AS breadcrumb,
           arg_min(trim(regexp_extract(line, '[*]URL:[*][*](.*)$', 1)), i) FILTER (WHERE contains(line, '**URL:**')) AS url FROM spans WHERE k > 0 GROUP BY conv_id, turn, k
),
singles AS (
    SELECT l.conv_id, l.turn, (SELECT max(k) FROM spans s WHERE s.conv_id = l.conv_id AND s.turn = l.turn) AS pos, trim(substr(above, 3)) AS title,
           (SELECT min(line) FROM lines c WHERE c.conv_id = l.conv_id AND c.turn = l.turn AND c.above = '## Breadcrumb') AS breadcrumb, trim(regexp_extract(line, '[*]URL:[*][*](.*)$', 1)) AS url
    FROM lines l WHERE starts_with(above, '# ') AND starts_with(line, '**URL:**')
),
cited AS (SELECT conv_id, turn, pos::INTEGER AS pos, title, breadcrumb, url FROM results UNION ALL SELECT conv_id, turn, pos::INTEGER, title, breadcrumb, url FROM singles),
numbered AS (
    SELECT conv_id, url, title, breadcrumb, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS id
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, url ORDER BY turn, pos) AS r FROM cited) WHERE r = 1
)"""


@query(f"WITH {_CITED} SELECT * FROM cited")
def extract_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations.extract_citations(_messages(spark, d).drop("site", "canonical"))


@query(f"WITH {_CITED} SELECT * FROM numbered")
def number_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations.number_citations(extract_citations(spark, d))


@query(
    f"""WITH {_CITED} SELECT m.conv_id, turn, 'See page^' || a.id || ' and [no link](' || site || '/none), [site](' || site || '/x) or home^' || b.id || '.' AS text
    FROM m JOIN numbered a ON a.conv_id = m.conv_id AND a.url = canonical JOIN numbered b ON b.conv_id = m.conv_id AND b.url = site"""
)
def rewrite_inline_links(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    text = F.concat(F.lit("See [page]("), "canonical", F.lit(") and [no link]("), "site", F.lit("/none), [site]("), "site", F.lit("/x) or [home]("), "site", F.lit(")."))
    return citations.rewrite_inline_links(m.select("conv_id", "turn", text.alias("text")), number_citations(spark, d))


@query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[\[\]^\n]', '', 'g') AS w FROM conversations)
    SELECT conv_id, turn, 0 AS pos, w AS label, turn AS number, 0 AS start, length(w) + 3 + length(turn::VARCHAR) AS "end" FROM t WHERE w <> ''
    UNION ALL SELECT conv_id, turn, CASE WHEN w <> '' THEN 1 ELSE 0 END, 'end', 17, length(w) + 3 + length(turn::VARCHAR) + 5, length(w) + 3 + length(turn::VARCHAR) + 5 + 8 FROM t"""
)
def parse_citation_markers(spark: SparkSession, d: str) -> DataFrame:
    word = F.regexp_replace("text", r"[\[\]^\n]", "")
    text = F.concat(F.lit("["), word, F.lit("]^"), F.col("turn").cast("string"), F.lit(", or [end]^17"))
    return citations.parse_citation_markers(table(spark, d, "conversations").select("conv_id", "turn", text.alias("text")))
