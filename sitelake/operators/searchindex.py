"""A search index that is kept up to date and searched from its best blocks on.

Segments. The index is a sequence of segments that are never changed once written. A segment has

    pages    block, urls, dls (terms of each page), counted (each page's distinct terms with their counts): a row for each block
    blocks   term, block, n, tf_max, dl_min, pages (their places in the block), tfs, dls, by bucket of the term and sorted by term
    gone     url, victim, dl: pages of earlier segments that this one replaces or removes

and a row of the manifest, a small versioned table. A page is live if no later segment's `gone` names it and the segment it is in (by
number: `victim`). An update adds one segment. Where FAN neighbouring segments have about the same size or
less they are merged to one; others aren't rewritten. An update costs in proportion to what changed and to the urls of the index,
which have to be looked through for the old pages.

Blocks. The pages of a segment are dealt to blocks by a hash of their url, in all terms alike, so that the blocks in which
all terms of a query have pages come from an equi-join. Texts are shuffled once, by block; a block's terms are put together
within its row. tf_max and dl_min bound the score of any of a block's pages
from above, whatever the average length becomes. A first pass scores, for every query, the FIRST_BLOCKS blocks with the
highest bounds; the k-th score found is a threshold, and a second pass scores the other blocks that reach it. The
result is that of scoring every match. Both passes, and the choice of blocks, begin with a query's rarest term: of the other
terms only the blocks that it has are looked at, and of these only its pages, so that a frequent term costs no row for each of its
queries and pages.

Urls are keys: of several pages with one url in an update that with the largest values counts, and a url that is both
updated and removed is removed. A null url is no page. Null texts are empty; a page without terms counts in the averages.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.functions import text as T
from sitelake.operators.search import B, BUCKETS, INDEXED, K1, bucket_of, clamp_limit, query_terms, top_k
from sitelake.sources import versions
from sitelake.sources.work import remove, settings, written

#: Segments of about one size that are merged, and the pages of a block.
FAN, BLOCK_PAGES = 4, 128
#: Blocks of a query that the first pass scores.
FIRST_BLOCKS = 8
#: Up to so many terms are pushed to the scan by name; beyond, buckets alone prune.
PUSHED_TERMS = 1000
#: Scores are rounded to 6 places, so bounds are taken a little higher.
SLACK = 2e-6

COUNTED = "array<struct<term: string, n: bigint>>"
PAGES = f"block int, urls array<string>, dls array<bigint>, counted array<{COUNTED}>"
BLOCKS = "term string, block int, n long, tf_max long, dl_min long, pages array<int>, tfs array<int>, dls array<int>, bucket int"
GONE = "url string, victim long, dl long"
MANIFEST = "id string, first long, last long, pages long, terms long, gone_pages long, gone_terms long"


@dataclass(frozen=True)
class Segment:
    """A row of the manifest: the numbers of the updates it holds, its pages and their terms, and those it takes from
    earlier segments."""

    id: str
    first: int
    last: int
    pages: int
    terms: int
    gone_pages: int
    gone_terms: int


def block_count(n: int) -> int:
    """The blocks of a segment of n pages."""
    return 1 << max(0, math.ceil(math.log2(max(1, n / BLOCK_PAGES))))


def block_of(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)).cast("int")


def counted_pages(pages: DataFrame, n_blocks: int) -> DataFrame:
    """(block, url, dl, counted) of pages (url and the indexed columns), one row for each url; counted within the row, so the only
    shuffle is that of the texts by block."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in INDEXED))
    dealt = pages.filter("url IS NOT NULL").select(block_of(F.col("url"), n_blocks).alias("block"), "url", text.alias("text")).repartition("block")
    one = dealt.groupBy("block", "url").agg(F.max("text").alias("text"))
    terms = one.select("block", "url", T.tokens(T.fold(F.col("text"))).alias("terms"))
    return terms.select("block", "url", F.size("terms").cast("long").alias("dl"), T.counted(F.col("terms")).alias("counted"))


def _posted(pages: DataFrame, buckets: int) -> DataFrame:
    """The blocks' terms, from rows of `pages`; within each row, so without a shuffle."""
    entry = lambda x, page: F.struct(x["term"].alias("term"), page.alias("page"), x["n"].cast("int").alias("tf"), F.get("dls", page).cast("int").alias("dl"))
    entries = F.flatten(F.transform("counted", lambda c, page: F.transform(c, lambda x: entry(x, page))))
    found = T.runs(F.sort_array(entries), lambda e: e["term"], lambda s, i, n: F.struct(F.get(s, i)["term"].alias("term"), F.slice(s, i + 1, n).alias("e")))
    rows = pages.filter(F.exists("counted", lambda c: F.size(c) > 0)).select("block", F.inline(found))
    bounds = [F.size("e").cast("long").alias("n"), F.array_max("e.tf").cast("long").alias("tf_max"), F.array_min("e.dl").cast("long").alias("dl_min")]
    out = rows.select("term", "block", *bounds, F.col("e.page").alias("pages"), F.col("e.tf").alias("tfs"), F.col("e.dl").alias("dls"))
    return out.withColumn("bucket", bucket_of(F.col("term"), buckets)).sortWithinPartitions("bucket", "term")


class SearchIndex:
    """An index below a path; open the same path again to read it later. `buckets` has to stay the same."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.version, rows = versions.latest(spark, f"{self.path}/manifest")
        self.segments = sorted((Segment(**r.asDict()) for r in rows.collect()), key=lambda s: s.first) if rows is not None else []

    # reading

    def _table(self, s: Segment, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s.id}/{name}")

    def _all(self, name: str, schema: str, of: list[Segment] | None = None) -> DataFrame:
        """Rows of a table of all segments, each with its segment's last number."""
        out = self.spark.createDataFrame([], f"{schema}, seg long")
        for s in self.segments if of is None else of:
            out = out.unionByName(self._table(s, name, schema).withColumn("seg", F.lit(s.last).cast("long")))
        return out

    def _pages(self, of: list[Segment] | None = None, *more: str) -> DataFrame:
        """(url, seg) of all pages, live or not, and the given ones of dl and counted."""
        lists = {"url": "urls", "dl": "dls", "counted": "counted"}
        zipped = F.arrays_zip(*(F.col(lists[x]).alias(x) for x in ("url", *more)))
        return self._all("pages", PAGES, of).select("seg", F.inline(zipped)).toDF("seg", "url", *more)

    def _gone(self, of: list[Segment] | None = None) -> DataFrame:
        """(url, seg, block) of the pages that aren't live any more: seg is the last number of their segment."""
        own = self.segments if of is None else of
        rows = self._all("gone", GONE, [s for s in own if s.gone_pages])
        seg, block = F.lit(None).cast("long"), F.lit(None).cast("int")
        for s in own:
            here = F.col("victim").between(s.first, s.last)
            seg, block = F.when(here, s.last).otherwise(seg), F.when(here, block_of(F.col("url"), block_count(s.pages))).otherwise(block)
        return rows.select("url", seg.cast("long").alias("seg"), block.alias("block")).filter("seg IS NOT NULL")

    def live(self) -> DataFrame:
        """(url, dl, seg) of all live pages."""
        return self._pages(None, "dl").join(self._gone().select("url", "seg"), ["url", "seg"], "left_anti")

    def totals(self) -> tuple[int, float]:
        """How many pages are live, and their average length; from the manifest alone."""
        n = sum(s.pages - s.gone_pages for s in self.segments)
        return n, sum(s.terms - s.gone_terms for s in self.segments) / n if n else 0.0

    def blocks(self, queries: DataFrame) -> DataFrame:
        """The blocks of all segments that the queries' terms can be in. Of up to PUSHED_TERMS distinct terms their names reach the
        scan, of more their buckets (which are numbers below `buckets`)."""
        terms = _wanted(queries).select("term").distinct()
        some = [r.term for r in terms.limit(PUSHED_TERMS + 1).collect()]
        rows = self._all("blocks", BLOCKS)
        if len(some) <= PUSHED_TERMS:
            own = self.spark.createDataFrame([(t,) for t in some], "term string")
            keys = [r.b for r in own.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect()]
            return rows.filter(F.col("bucket").isin(keys) & F.col("term").isin(some))
        keys = [r.b for r in terms.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect()]
        return rows.filter(F.col("bucket").isin(keys))

    def live_blocks(self, queries: DataFrame) -> DataFrame:
        """(term, seg, block, n, tf_max, dl_min, pages, tfs, dls) of the queries' terms, without pages that aren't live."""
        columns = ["term", "seg", "block", "n", "tf_max", "dl_min", "pages", "tfs", "dls"]
        rows = self.blocks(queries).join(_wanted(queries).select("term").distinct(), "term", "left_semi").select(columns)
        if not any(s.gone_pages for s in self.segments):
            return rows
        urls = self._gone().groupBy("seg", "block").agg(F.collect_set("url").alias("_urls"))
        places = F.filter(F.sequence(F.lit(0), F.size("urls") - 1), lambda i: F.array_contains("_urls", F.get("urls", i)))
        gone = self._all("pages", PAGES).select("seg", "block", "urls").join(urls, ["seg", "block"]).select("seg", "block", places.alias("_gone"))
        left = F.filter(F.arrays_zip("pages", "tfs", "dls"), lambda e: ~F.array_contains("_gone", e["pages"]))
        some = rows.join(written(gone, "gone-pages"), ["seg", "block"], "left").withColumn("e", F.when(F.col("_gone").isNull(), F.arrays_zip("pages", "tfs", "dls")).otherwise(left))
        return some.filter(F.size("e") > 0).select("term", "seg", "block", F.size("e").cast("long").alias("n"), "tf_max", "dl_min", *(F.col(f"e.{c}").alias(c) for c in ("pages", "tfs", "dls")))

    # writing

    def _write(self, pages: DataFrame, gone: DataFrame, n: int, first: int, last: int) -> Segment:
        """A segment of n pages (block, url, dl, counted), dealt by block, and `gone` rows; not in the manifest yet."""
        name = f"{last:010d}-{uuid.uuid4().hex[:8]}"
        top = f"{self.path}/segments/{name}"
        gone.select("url", "victim", "dl").write.parquet(f"{top}/gone")
        lists = F.sort_array(F.collect_list(F.struct("url", "dl", "counted"))).alias("p")
        rows = pages.groupBy("block").agg(lists).select("block", F.col("p.url").alias("urls"), F.col("p.dl").alias("dls"), F.col("p.counted").alias("counted"))
        # a task holds the pages of one block at a time, when it makes these rows and when it reads them
        with settings(self.spark, spark__sql__execution__useObjectHashAggregateExec="false"):
            rows.write.option("compression", "zstd").parquet(f"{top}/pages")
        own = self.spark.read.schema(PAGES).parquet(f"{top}/pages")
        with settings(self.spark, spark__sql__parquet__enableNestedColumnVectorizedReader="false"):
            _posted(own, self.buckets).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{top}/blocks")
        count = lambda t: tuple(x or 0 for x in t.agg(F.count(F.lit(1)), F.sum("dl")).first())
        written_pages, terms = count(own.select(F.explode("dls").alias("dl")))
        if written_pages != n:
            raise RuntimeError(f"the pages changed while they were read: {written_pages} of {n} were written")
        return Segment(name, first, last, n, terms, *count(self.spark.read.schema(GONE).parquet(f"{top}/gone")))

    def _publish(self, segments: list[Segment]) -> None:
        rows = self.spark.createDataFrame([tuple(vars(s).values()) for s in segments], MANIFEST)
        versions.publish(rows.coalesce(1), f"{self.path}/manifest", self.version + 1)
        self.version, self.segments = self.version + 1, segments

    def update(self, pages: DataFrame, removed: DataFrame | None = None) -> None:
        """Add or replace pages (url and the indexed columns) and remove urls, as one new segment; then merge as needed. The
        pages are read twice, first their urls alone."""
        number = 1 + max((s.last for s in self.segments), default=0)
        urls = written(pages.select("url").filter("url IS NOT NULL").distinct(), "changed-urls")
        n = urls.count()
        if removed is not None:
            both = written(urls.join(removed.select("url"), "url", "left_semi"), "removed-urls")
            if twice := both.count():
                pages, n = pages.join(both, "url", "left_anti"), n - twice
        if not self.segments:
            gone = self.spark.createDataFrame([], GONE)
        else:
            urls = urls if removed is None else urls.unionByName(removed.select("url")).distinct()
            gone = self.live().join(urls, "url", "left_semi").withColumnRenamed("seg", "victim")
        self._publish([*self.segments, self._write(counted_pages(pages, block_count(n)), gone, n, number, number)])
        while (run := self.next_merge()) is not None:
            self.merge(run)

    def next_merge(self) -> tuple[int, int] | None:
        """(from, to) of neighbouring segments to merge: the smallest tier with FAN of them in a row that are no larger."""
        tier = [int(math.log(max(s.pages + s.gone_pages, 1), FAN)) for s in self.segments]
        for t in sorted(set(tier)):
            end = len(tier)
            while end > 0:
                begin = end
                while begin > 0 and tier[begin - 1] <= t:
                    begin -= 1
                if end - begin >= FAN:
                    return begin, end
                end = begin - 1 if begin == end else begin
        return None

    def merge(self, run: tuple[int, int]) -> None:
        """Segments run[0] to run[1] (not included) become one: their live pages, and what they take from earlier ones."""
        own = self.segments[run[0] : run[1]]
        first, last = own[0].first, own[-1].last
        inside = self._gone(own).select("url", "seg")
        n = sum(s.pages for s in own) - inside.count()
        pages = self._pages(own, "dl", "counted").join(inside, ["url", "seg"], "left_anti")
        dealt = pages.select(block_of(F.col("url"), block_count(n)).alias("block"), "url", "dl", "counted").repartition("block")
        gone = self._all("gone", GONE, [s for s in own if s.gone_pages]).filter(F.col("victim") < first)
        self._publish([*self.segments[: run[0]], self._write(dealt, gone, n, first, last), *self.segments[run[1] :]])

    def vacuum(self) -> None:
        """Remove segments and manifests that the newest manifest doesn't name; when nobody reads an older version any more."""
        names = {s.id for s in self.segments}
        old = [p for p, _, _ in versions.children(self.spark, f"{self.path}/segments") if p.rsplit("/", 1)[1] not in names]
        old += [versions.at_version(f"{self.path}/manifest", v) for v in versions.versions(self.spark, f"{self.path}/manifest")[:-1]]
        remove(self.spark, old)


def _wanted(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms)."""
    return queries.select("query_id", query_terms(F.col("query")).alias("terms")).select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def weights(index: SearchIndex, blocks: DataFrame) -> DataFrame:
    """(term, df, idf) over the live pages."""
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(index.totals()[0]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", "df", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))


def _impact(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


@dataclass(frozen=True)
class Search:
    """A search of an index: the live blocks of its terms, `asked` (query_id, term, n_terms, idf, rarest: whether no other term
    of the query is in fewer pages) of queries whose terms are all there, and the blocks in which all of a query's terms have pages."""

    index: SearchIndex
    blocks: DataFrame
    asked: DataFrame
    candidates: DataFrame


def prepare(index: SearchIndex, queries: DataFrame) -> Search:
    """The blocks that a search has to choose from, with an upper bound of their scores: (query_id, seg, block, bound, pages). Both passes
    need the terms' blocks, so they are written."""
    blocks = written(index.live_blocks(queries), "term-blocks")
    known = written(_wanted(queries).join(weights(index, blocks), "term"), "term-weights")
    own = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("df", "term")).alias("_r"))
    asked = known.join(own, "query_id").filter("_n = n_terms").select("query_id", "term", "n_terms", "idf", (F.col("term") == F.col("_r.term")).alias("rarest"))
    asked = written(asked, "query-terms")
    bounds = blocks.select("term", "seg", "block", "n", "tf_max", "dl_min")
    part = F.col("idf") * _impact(F.col("tf_max"), F.col("dl_min"), index.totals()[1])
    first = bounds.join(asked.filter("rarest"), "term").select("query_id", "seg", "block", "n_terms", "n", part.alias("part"))
    others = asked.filter("NOT rarest").select("query_id", "term", "idf")
    more = first.select("query_id", "seg", "block", "n_terms").join(others, "query_id").join(bounds, ["term", "seg", "block"]).select("query_id", "seg", "block", "n_terms", "n", part.alias("part"))
    found = first.unionByName(more).groupBy("query_id", "seg", "block").agg(F.count(F.lit(1)).alias("_n"), F.first("n_terms").alias("_of"), F.sum("part").alias("bound"), F.min("n").alias("pages"))
    found = found.filter("_n = _of").select("query_id", "seg", "block", (F.col("bound") + SLACK).alias("bound"), "pages")
    return Search(index, blocks, asked, written(found, "candidate-blocks"))


def score(search: Search, candidates: DataFrame) -> DataFrame:
    """(query_id, url, score) of the live pages in these blocks that have every term, scores rounded to 6 places."""
    index, blocks = search.index, search.blocks
    rare = candidates.select("query_id", "seg", "block").join(search.asked.filter("rarest").select("query_id", "term"), "query_id")
    own = rare.join(blocks.select("term", "seg", "block", "pages"), ["term", "seg", "block"]).select("query_id", "seg", "block", F.col("pages").alias("_own"))
    rows = own.join(search.asked, "query_id").join(blocks.select("term", "seg", "block", "pages", "tfs", "dls"), ["term", "seg", "block"])
    entries = F.arrays_zip("pages", "tfs", "dls")
    kept = F.when(F.col("rarest"), entries).otherwise(F.filter(entries, lambda e: F.array_contains("_own", e["pages"])))
    hits = rows.select("query_id", "seg", "block", "term", "idf", "n_terms", kept.alias("e")).filter(F.size("e") > 0)
    # a block's pages stay together in the shuffle, and are told apart after it
    hits = hits.select("query_id", "seg", "block", "term", "idf", "n_terms", *(F.col(f"e.{c}").alias(c) for c in ("pages", "tfs", "dls"))).repartition("query_id", "seg", "block")
    hits = hits.select("query_id", "seg", "block", "term", "idf", "n_terms", F.inline(F.arrays_zip("pages", "tfs", "dls")))
    part = F.col("idf") * _impact(F.col("tfs"), F.col("dls"), index.totals()[1])
    whole = hits.groupBy("query_id", "seg", "block", "pages").agg(F.collect_list(F.struct("term", part.alias("part"))).alias("parts"), F.first("n_terms").alias("n")).filter("size(parts) = n")
    # parts are added in the order of their terms, so that a score doesn't depend on partitions
    parts = F.transform(F.array_sort("parts"), lambda x: x["part"])
    scored = whole.select("query_id", "seg", "block", "pages", F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6).alias("score"))
    urls = index._all("pages", PAGES).select("seg", "block", F.posexplode("urls").alias("pages", "url"))
    return scored.join(urls, ["seg", "block", "pages"]).select("query_id", "url", "score")


def matches(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, url) where the page has every term of the query."""
    search = prepare(index, queries)
    return score(search, search.candidates).select("query_id", "url")


def _first_pages(scores: DataFrame, parts: int = 32) -> DataFrame:
    """The best _k of each query with rank, ties by url; picked in parts first, since a query can match most pages."""
    by = W.partitionBy("query_id", F.pmod(F.xxhash64("url"), F.lit(parts))).orderBy(F.desc("score"), "url")
    some = scores.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= F.col("_k")).drop("_r")
    return top_k(some, F.col("_k"))


def best_pages(index: SearchIndex, queries: DataFrame, first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """((query_id, url, score, rank), report) of queries (query_id, query, k): the k best pages of each, ties by url. The report
    (query_id, n_blocks, n_first, n_second) says in how many blocks all terms of a query have pages, and how many of
    these each pass scored."""
    search = prepare(index, queries)
    by = W.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "block")
    # a rank of so few is limited in every task before the shuffle, so a query of one frequent term isn't sorted as a whole
    best_blocks = search.candidates.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= first_blocks)
    best_blocks = written(best_blocks.select("query_id", "seg", "block"), "first-blocks")
    limits = queries.select("query_id", F.col("k").cast("int").alias("_k"))
    first = written(_first_pages(score(search, best_blocks).join(limits, "query_id")), "first-pages")
    # the score that a block has to reach; none if fewer than k pages are found so far
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= F.first("_k"), F.min("score")).alias("least"))
    others = search.candidates.join(best_blocks, ["query_id", "seg", "block"], "left_anti")
    rest = others.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    rest = written(rest.select("query_id", "seg", "block"), "second-blocks")
    both = first.select("query_id", "url", "score").unionByName(score(search, rest))
    counts = search.candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks")).join(rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_second")), "query_id", "left")
    report = counts.select("query_id", "n_blocks", F.least(F.col("n_blocks"), F.lit(first_blocks).cast("long")).alias("n_first"), F.coalesce("n_second", F.lit(0)).cast("long").alias("n_second"))
    return _first_pages(both.join(limits, "query_id")).drop("_k"), report


def section_pages(index: SearchIndex, queries: DataFrame, pages: DataFrame, fetched: int = 200) -> DataFrame:
    """Queries (query_id, query, section, k): the best `fetched` pages (without a section: k), of these the ones whose
    section is the wanted one but for case, and the first k of them; total_found counts before the filter."""
    q = queries.select("query_id", "query", "section", clamp_limit(F.col("k")).alias("_most"))
    first, _ = best_pages(index, q.withColumn("k", F.when(F.col("section").isNotNull(), fetched).otherwise(F.col("_most"))))
    first = first.withColumn("total_found", F.count(F.lit(1)).over(W.partitionBy("query_id"))).drop("rank").join(q.drop("query"), "query_id")
    hits = first.join(pages.select("url", F.col("section").alias("page_section")), "url")
    kept = hits.filter(F.col("section").isNull() | (F.col("section") == "") | (F.lower("page_section") == F.lower("section")))
    return top_k(kept, F.col("_most")).select("query_id", "rank", "url", "score", "page_section", "total_found")
