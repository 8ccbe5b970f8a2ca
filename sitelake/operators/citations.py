"""Citations: found in result texts, numbered in a conversation, linked and parsed in answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.functions import text as T

# The labels of result texts.
URL_LABEL, SECTION_LABEL, BREADCRUMB_TITLE = "URL:", "Seção:", "Breadcrumb"
#: Turns of a conversation that are numbered together.
TURNS = 1000
# The form of a link and of a marker.
_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
_MARKER = r"\[([^\]]+)\]\^([0-9]+)"


def extract_citations(messages: DataFrame, url_label: str = URL_LABEL, section_label: str = SECTION_LABEL, breadcrumb: str = BREADCRUMB_TITLE) -> DataFrame:
    """(conv_id, turn, pos, title, breadcrumb, url) of messages (conv_id, turn, text): search results (a heading
    `## N. title`, up to the first line with a URL, with a section line between or not) and after them single pages
    (`# title`, right below it a line with its URL; their breadcrumb is the line below the breadcrumb heading).
    Lines are tagged by what they are and folded from first to last, in one pass."""
    after = lambda line, label: T.trimmed(F.substring_index(line, f"**{label}**", -1))
    has = lambda line, label: F.contains(line, F.lit(f"**{label}**"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cited = "array<struct<title:string,breadcrumb:string,url:string>>"
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("title"), none.alias("section"), none.alias("page"), F.lit(False).alias("below"), none.alias("crumb"), F.array().cast(cited).alias("results"), F.array().cast(cited).alias("pages"))
    entry = lambda title, crumb, url: F.array(F.struct(T.trimmed(title).alias("title"), crumb.alias("breadcrumb"), url.alias("url")))

    def step(s, line):
        numbered = F.regexp_extract(line, r"(?s)^## [0-9]+[.][ \t]+(.+)$", 1)
        url = F.when(has(line, url_label), after(line, url_label))
        ends = s["title"].isNotNull() & (url != "")
        single = s["page"].isNotNull() & F.startswith(line, F.lit(f"**{url_label}**")) & (url != "")
        title = F.when(ends, None).otherwise(F.coalesce(s["title"], F.nullif(numbered, F.lit(""))))
        section = F.when(ends | s["title"].isNull(), None).otherwise(F.coalesce(s["section"], F.when(has(line, section_label), after(line, section_label))))
        return F.struct(
            title.alias("title"),
            section.alias("section"),
            F.nullif(F.regexp_extract(line, "(?s)^# (.+)$", 1), F.lit("")).alias("page"),
            (line == f"## {breadcrumb}").alias("below"),
            F.coalesce(s["crumb"], F.when(s["below"] & (line != ""), T.trimmed(line))).alias("crumb"),
            F.when(ends, F.concat(s["results"], entry(s["title"], F.coalesce(s["section"], F.lit("")), url))).otherwise(s["results"]).alias("results"),
            F.when(single, F.concat(s["pages"], entry(s["page"], F.lit(""), url))).otherwise(s["pages"]).alias("pages"),
        )

    def finish(s):
        crumb = F.coalesce(s["crumb"], F.lit(""))
        return F.concat(s["results"], F.transform(s["pages"], lambda p: F.struct(p["title"].alias("title"), crumb.alias("breadcrumb"), p["url"].alias("url"))))

    return messages.select("conv_id", "turn", F.posexplode(F.aggregate(lines, empty, step, finish)).alias("pos", "c")).select("conv_id", "turn", "pos", "c.*")


def extract_urls(messages: DataFrame, url_label: str = URL_LABEL) -> DataFrame:
    """(conv_id, turn, pos, url) of every labelled URL."""
    # the text is cut at labels; what follows one is a URL if it begins with one after some space, up to the next space
    after = F.slice(F.split(F.coalesce("text", F.lit("")), rf"\Q**{url_label}**\E", -1), 2, 1_000_000_000)
    first = F.filter(F.transform(after, lambda t: F.regexp_extract(t, r"^\s+(\S+)", 1)), lambda w: w.rlike("^https?://."))
    return messages.select("conv_id", "turn", F.posexplode(first).alias("pos", "url"))


def number_citations(citations: DataFrame) -> DataFrame:
    """(conv_id, id, title, breadcrumb, url): each URL of a conversation once, numbered by its first place (of ties,
    by URL). Numbers are given within spans of TURNS turns, to which the counts of the spans before are added, so that
    a long conversation isn't sorted in one task."""
    at = F.struct("turn", "pos")
    first = citations.groupBy("conv_id", "url").agg(F.min(at).alias("_at"), F.min_by(F.struct("title", "breadcrumb"), at).alias("_c"))
    first = first.withColumn("_span", F.floor(F.col("_at.turn") / TURNS))
    before = W.partitionBy("conv_id").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = first.groupBy("conv_id", "_span").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    spans = spans.select(F.col("conv_id").alias("_conv"), F.col("_span").alias("_of"), "_before")
    own = first.withColumn("_r", F.row_number().over(W.partitionBy("conv_id", "_span").orderBy("_at", "url")))
    joined = own.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_span").eqNullSafe(F.col("_of")))
    return joined.select("conv_id", (F.col("_r") + F.col("_before")).cast("int").alias("id"), "_c.title", "_c.breadcrumb", "url")


def rewrite_inline_links(messages: DataFrame, citations: DataFrame, bracketed: bool = False) -> DataFrame:
    """Messages whose `[text](url)` became `text^N` (or `[text]^N`) where the conversation cites the url.
    The links of each distinct text are joined to the citations; what a message gets is a map of its own
    links only, and they are folded in one pass."""
    text_hash = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    urls = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_LINK), F.lit(2)))
    own = messages.select("conv_id", text_hash.alias("_hash"), F.explode(urls).alias("url")).distinct().join(citations.select("conv_id", "url", "id"), ["conv_id", "url"])
    cited = own.groupBy(F.col("conv_id").alias("_conv"), "_hash").agg(F.map_from_entries(F.collect_list(F.struct("url", "id"))).alias("_ids"))
    joined = messages.join(cited, (F.col("conv_id") == F.col("_conv")) & (text_hash == F.col("_hash")), "left")
    text = F.coalesce("text", F.lit(""))
    links = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(f"({_LINK})"), F.lit(i)).alias(n) for i, n in ((1, "link"), (2, "label"), (3, "url"))))
    marked = (lambda x: F.concat(F.lit("["), x, F.lit("]"))) if bracketed else (lambda x: x)

    def step(s, x):
        """The text is walked from link to link: what stands before one, then its new form."""
        at = F.instr(s["rest"], x["link"])
        cited_as = F.concat(marked(x["label"]), F.lit("^"), F.try_element_at(F.col("_ids"), x["url"]).cast("string"))
        return F.struct(
            F.concat(s["out"], F.left(s["rest"], at - 1), F.coalesce(cited_as, x["link"])).alias("out"),
            F.substr(s["rest"], at + F.char_length(x["link"])).alias("rest"),
        )

    start = F.struct(F.lit("").alias("out"), text.alias("rest"))
    folded = F.aggregate(links, start, step, lambda s: F.concat(s["out"], s["rest"]))
    return joined.withColumn("text", folded).drop("_ids", "_conv", "_hash")


def _markers(texts: pd.Series) -> pd.Series:
    number = lambda d: int(d) if len(d.lstrip("0")) <= 9 or int(d) < 1 << 31 else None
    return texts.map(lambda t: [(m[1], number(m[2]), m.start(), m.end()) for m in re.finditer(_MARKER, t)])


def parse_citation_markers(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, label, number, start, end) of every `[text]^N`, in characters, end exclusive; a number that is no int is
    null. In time in proportion to the text: places are running sums, which columns can only say by copying arrays."""
    parse = F.pandas_udf(_markers, "array<struct<label: string, number: int, start: int, end: int>>")
    found = messages.select("conv_id", "turn", parse(F.coalesce("text", F.lit(""))).alias("m"))
    return found.select("conv_id", "turn", F.posexplode("m").alias("pos", "m")).select("conv_id", "turn", "pos", "m.*")
