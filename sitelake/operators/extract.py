"""Page extraction: one pass of Python over the HTML gives raw facts, everything after it is columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as T
from sitelake.functions import urls as U
from sitelake.sources.work import small_batches

# Where the content is, what is not content, which blocks hold text.
CONTAINERS = (("id", "content-core"), ("id", "content"), ("tag", "main"), ("tag", "article"))
CHROME_TAGS = {"script", "style", "nav", "header", "footer", "aside"}
CHROME_IDS = {"portal-footer", "portal-header", "portal-searchbox"}
CHROME_CLASSES = {"portlet", "nao-imprimir"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd"}
CONTEXT_TAGS = {"p", "li", "dd", "dt", "td", "div"}
DOCUMENT_EXTENSIONS = ("pdf", "csv", "xlsx", "xls", "docx", "doc", "ods", "odt", "zip", "rar")
# Metas with the date of the content and of its last change, in order of trust.
CONTENT_DATES = (("name", "DC.date"), ("name", "DC.date.created"), ("name", "DCTERMS.created"), ("property", "article:published_time"))
UPDATE_DATES = (("name", "DC.date.modified"), ("name", "DCTERMS.modified"), ("property", "article:modified_time"), ("property", "og:updated_time"))
# Titles of a site's root in breadcrumbs.
ROOT_LABELS = ("página inicial", "inicio", "início", "home", "portal")
TITLE_CUT = " — "
# Words that are no keywords.
STOPWORDS = """
a o as os e de do da dos das em no na nos nas para por com sem que se ou um uma mais menos isto isso ele ela
eles elas você nós seu sua seus suas muito tudo todo toda também então quando onde como qual quais até sobre
entre após antes depois ser ter estar foi são está estão pela pelo pelas pelos ao aos à às este esta estes
estas esse essa esses essas aquele aquela aqueles aquelas num numa nuns numas deste desta neste nesta nesses
nessas desse dessa desses dessas daquele daquela naquele naquela des from the and for with
""".split()

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag ends these, if they are open and nothing in the second set stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}
_END_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Characters of a link's context.
CONTEXT = 200
_SPACE = re.compile(r"\s+")
#: A tag that the end of the page cuts is no text.
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
#: A sign that can begin a character reference, and the reference if a semicolon closes it.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


# What an element stands in, as bits that its children inherit.
_TAGS, _CRUMBS_A, _CRUMBS_B, _LIST, _LISTED, _NAV, _MICRO = (1 << i for i in range(7))


def _marks(tag: str, attrs: dict[str, str], above: int) -> int:
    """What the children of an element stand in."""
    own, name = attrs.get("id"), attrs.get("class", "")
    crumb = "breadcrumb" in name and "breadcrumb" in name.split()
    out = above | {"tags": _TAGS, "portal-breadcrumbs": _CRUMBS_A, "breadcrumb": _CRUMBS_B}.get(own, 0)
    if tag == "ol" and crumb:
        out |= _LIST
    elif tag == "nav" and crumb:
        out |= _NAV
    elif tag == "li" and above & _LIST:
        out |= _LISTED
    return out | _MICRO * ("data-microdata-breadcrumb" in attrs)


class Node:
    __slots__ = ("attrs", "children", "inner", "parent", "tag", "within")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.within = parent.inner if parent else 0
        self.inner = _marks(tag, attrs, self.within)
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            yield (n := stack.pop())
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack += reversed(n.children)

    def text(self) -> str:
        return "".join(self.strings())

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class _Tree(HTMLParser):
    """A tolerant tree: open paragraphs and items end where HTML says so, stray ends are ignored. The open
    elements of each tag are counted, so that nothing is looked for that isn't open: time in proportion to the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def _end(self, n: Node) -> None:
        """Close all up to and with an open element."""
        while self.at is not n.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags: set[str], stop: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        n = self.at
        while n.parent and n.tag not in tags and n.tag not in stop:
            n = n.parent
        if n.parent and n.tag in tags:
            self._end(n)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _END_P:
            self._close({"p"}, {"button", "td", "th", "table", "body"})
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end(self.at)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            n = self.at
            while n.tag != tag:
                n = n.parent
            self._end(n)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _clean(s: str) -> str:
    return _SPACE.sub(" ", s.strip())


def _chrome(n: Node) -> bool:
    return n.tag in CHROME_TAGS or n.attrs.get("id") in CHROME_IDS or bool(n.classes() & CHROME_CLASSES)


def _start(n: Node, most: int = CONTEXT) -> str:
    """The first characters of an element's text, cleaned; no more of it is read than these take."""
    out, size, space = [], 0, False
    for piece in n.strings():
        words = piece.split()
        for k, w in enumerate(words):
            if size and (space or k or piece[0].isspace()):
                out.append(" ")
                size += 1
            out.append(w)
            size += len(w)
            space = False
            if size >= most:
                return "".join(out)[:most]
        space = space or not words and bool(piece) or bool(words) and piece[-1].isspace()
    return "".join(out)


def _breadcrumb(nodes: list[Node]) -> list[dict]:
    """The anchors of the first selector that has any."""
    anchors = [n for n in nodes if n.tag == "a"]
    for marks in (_LISTED | _CRUMBS_A, _LISTED | _CRUMBS_B, _LISTED, _NAV, _MICRO):
        if found := [n for n in anchors if n.within & marks == marks]:
            return [{"title": n.text().strip(), "href": n.attrs.get("href", "")} for n in found]
    return []


def _only_closed(html: str) -> str:
    """The HTML with every & that begins no reference closed by a semicolon written as one that does."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def page_facts(html: str | None, open_references: bool = True) -> dict:
    """Raw facts of one page. Never fails on bad HTML. As in HTML, some character references need no semicolon (&amp as
    the last of a cut title is &); without open_references those stay as they are."""
    tree = _Tree()
    html = _CUT_TAG.sub("", html or "")
    tree.feed(html if open_references else _only_closed(html))
    tree.close()
    nodes = list(tree.root.walk())
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    facts = {
        "lang": root.attrs.get("lang", "").strip() if (root := first("html")) else "",
        "raw_title": "".join(n.text() for n in nodes if n.tag == "title").strip(),
        "metas": [{"attr": a, "key": n.attrs[a], "content": n.attrs.get("content", "")} for n in nodes if n.tag == "meta" for a in ("name", "property") if n.attrs.get(a)],
        "tag_links": [t for n in nodes if n.tag == "a" and n.within & _TAGS and (t := n.text().strip().removeprefix("#").strip())],
        "breadcrumb": _breadcrumb(nodes),
        "active_titles": [t for n in nodes if n.tag == "li" and n.within & _LIST and ("active" in n.classes() or n.attrs.get("aria-current") == "page") and (t := n.text().strip())],
    }
    find = lambda kind, name: next((n for n in nodes if (n.attrs.get("id") if kind == "id" else n.tag) == name), None)
    container = next((c for kind, name in CONTAINERS if (c := find(kind, name))), None) or first("body") or tree.root
    for n in [container, *container.walk()]:
        n.children = [c for c in n.children if isinstance(c, str) or not _chrome(c)]
    blocks = [t for n in container.walk() if n.tag in BLOCKS and (t := _clean(n.text()))]
    # links and documents are of the tree after that removal
    body = first("body") or tree.root
    anchors, starts = [], {}
    for n in body.walk():
        if n.tag == "a" and "href" in n.attrs and (href := n.attrs["href"].strip()):
            title = _clean(n.text()) or n.attrs.get("title", "") or href
            p = n.parent
            while p and p.tag not in CONTEXT_TAGS:
                p = p.parent
            if p and p not in starts:  # once for all links in it
                starts[p] = _start(p)
            anchors.append({"href": href, "title": title, "context": starts[p] if p else title[:CONTEXT]})
    return {**facts, "blocks": blocks, "anchors": anchors}


_FACTS = (
    "lang string, raw_title string, metas array<struct<attr:string,key:string,content:string>>, tag_links array<string>, "
    "breadcrumb array<struct<title:string,href:string>>, active_titles array<string>, blocks array<string>, anchors array<struct<href:string,title:string,context:string>>"
)


def raw_facts(pages: DataFrame, open_references: bool = True) -> DataFrame:
    """Pages (url, html) with the facts in place of the HTML."""

    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 200):  # facts of a few pages at a time
                part = batch.iloc[i : i + 200]
                yield pd.concat([part.drop(columns="html").reset_index(drop=True), pd.DataFrame([page_facts(h, open_references) for h in part.html])], axis=1)

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"]
    return pages.mapInPandas(run, ", ".join([*rest, _FACTS]))


def _meta(attr: str, key: str) -> Column:
    """The first non-empty content of a meta, by a case-insensitive name."""
    found = F.filter("metas", lambda m: (m["attr"] == attr) & (F.lower(m["key"]) == key.lower()) & (m["content"] != ""))
    return F.get(found, 0)["content"]


def _date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")))


def title_of(raw: Column) -> Column:
    """Cut at the first dash that separates the site's name, unless it comes first."""
    return F.when(F.instr(raw, TITLE_CUT) > 1, F.trim(F.substring_index(raw, TITLE_CUT, 1))).otherwise(raw)


def content_dates() -> dict[str, Column]:
    return {
        "content_date": F.date_format(F.coalesce(*(_date(_meta(a, k)) for a, k in CONTENT_DATES)), "yyyy-MM-dd"),
        "page_updated_at": F.coalesce(*(_date(_meta(a, k)) for a, k in UPDATE_DATES)),
    }


def breadcrumb_section() -> dict[str, Column]:
    titles = F.filter(F.transform("breadcrumb", lambda b: b["title"]), lambda t: (t != "") & ~F.lower(t).isin(*ROOT_LABELS))
    more = F.filter("active_titles", lambda t: ~F.array_contains(titles, t))
    path = F.concat(titles, F.array_distinct(more))
    return {"path_titles": path, "section": F.coalesce(F.get(path, 1), F.lit("")), "warnings": F.when(F.size("breadcrumb") == 0, F.array(F.lit("breadcrumb not found"))).otherwise(F.array().cast("array<string>"))}


def extract_pages(pages: DataFrame, open_references: bool = True) -> DataFrame:
    """Pages (url, html, ...) as page rows: lang, title, description, tags, breadcrumb, path_titles, section,
    warnings, full_text, content_length, summary, hashes, dates, and the anchors for link_edges(). For open_references
    see page_facts()."""
    facts = raw_facts(pages, open_references)
    named = lambda attr, key: F.filter("metas", lambda m: (m["attr"] == attr) & (m["key"] == key) & (m["content"] != ""))
    keywords = F.flatten(F.transform(named("name", "keywords"), lambda m: F.split(m["content"], ",")))
    tags = F.concat(F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != ""), F.col("tag_links"))
    og = named("property", "og:description")
    description = F.coalesce(F.trim(F.get(named("name", "description"), 0)["content"]), F.trim(F.get(og, F.greatest(F.size(og) - 1, F.lit(0)))["content"]), F.lit(""))
    out = facts.withColumns({"title": title_of(F.col("raw_title")), "description": description, "tags": tags, "full_text": F.array_join("blocks", "\n\n"), **content_dates(), **breadcrumb_section()})
    out = out.withColumns({"content_length": F.char_length("full_text"), "summary": T.summary(F.col("full_text")), "full_text_hash": T.hashed(F.col("full_text")), "content_hash": T.content_hash(F.col("title"), F.col("description"), F.col("full_text"))})
    crumbs = F.transform("breadcrumb", lambda b: F.struct(b["title"].alias("title"), U.resolve(F.col("url"), b["href"]).alias("url")))
    return out.withColumn("breadcrumb", crumbs).drop("raw_title", "metas", "tag_links", "active_titles", "blocks")


def _extension(href: Column) -> Column:
    """The extension of a document link, before ? and #, or blank."""
    found = F.lower(F.regexp_extract(F.regexp_extract(href, "^[^?#]*", 0), r"\.([^./]+)$", 1))
    return F.when(found.isin(*DOCUMENT_EXTENSIONS), found).otherwise("")


def _anchors(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.posexplode("anchors").alias("pos", "a")).select("url", "pos", "a.*")


def link_edges(pages: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(src, dst, title, kind) from pages with anchors: child below the page (one for each first segment),
    else internal in scope (host, prefix rows), else external if http. The first of equal ones stays."""
    skipped = F.lower("href").rlike("^(mailto:|tel:|javascript:|#)")
    a = _anchors(pages).filter(~skipped).withColumn("dst", F.regexp_replace(U.resolve(F.col("url"), F.col("href")), "#.*$", "")).filter((F.col("dst") != "") & (_extension(F.col("dst")) == ""))
    base = U.bare(F.regexp_replace("url", "#.*$", ""))
    below = F.when(F.startswith("dst", F.concat(base, F.lit("/"))), F.substring_index(U.bare(F.substr("dst", F.char_length(base) + 2)), "/", 1)).otherwise("")
    a = a.withColumns({"_below": below, "_host": U.host_of(F.col("dst"))})
    inside = F.lit(False)
    if scopes is not None:
        prefixes = scopes.groupBy(F.col("host").alias("_host")).agg(F.collect_set("prefix").alias("_prefixes"))
        a = a.join(prefixes, "_host", "left")
        inside = F.coalesce(F.exists("_prefixes", lambda p: U.in_scope(F.col("dst"), p)), F.lit(False))
    kind = F.when(F.col("_below") != "", "child").when(inside, "internal").when(F.lower("dst").startswith("http"), "external")
    key = F.when(F.col("_below") != "", F.concat(base, F.lit("/"), F.col("_below"))).otherwise(F.col("dst"))
    a = a.withColumns({"kind": kind, "_key": key}).filter("kind IS NOT NULL")
    first = a.groupBy("url", "kind", "_key").agg(F.min_by(F.struct("dst", "title"), "pos").alias("f"))
    return first.select(F.col("url").alias("src"), "f.dst", "f.title", "kind")


def document_links(pages: DataFrame) -> DataFrame:
    """(src, url, type, title, context) of links to documents, one for each resolved URL of a page; context is
    the first CONTEXT characters around the link."""
    a = _anchors(pages).withColumn("type", _extension(F.col("href"))).filter("type <> ''").withColumn("dst", U.resolve(F.col("url"), F.col("href")))
    first = a.groupBy("url", "dst").agg(F.min_by(F.struct("type", "title", "context"), "pos").alias("f"))
    return first.select(F.col("url").alias("src"), F.col("dst").alias("url"), "f.type", "f.title", "f.context")


def keywords_top10(docs: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, keywords): the n most frequent words of at least 3 bytes that are no stopwords, by count and
    then by name; no row for a text without any or below 50 bytes."""
    long = docs.filter(F.octet_length("text") >= 50).select("doc_id", T.tokens(F.lower("text")).alias("words"))
    # counted within the row: no shuffle, and rows that share an id stay apart
    kept = long.select("doc_id", F.filter("words", lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOPWORDS)).alias("words"))
    counts = kept.filter(F.size("words") > 0).select("doc_id", T.counted(F.col("words")).alias("c"))
    ranked = F.array_sort(F.transform("c", lambda x: F.struct((-x["n"]).alias("n"), x["term"].alias("term"))))
    return counts.select("doc_id", F.transform(F.slice(ranked, 1, n), lambda x: x["term"]).alias("keywords"))


def link_counts(pages: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages with n_children, n_internal, link_title_bytes and n_documents, for the page type."""
    title = F.octet_length(T.trimmed(F.col("title")))
    e = edges.groupBy(F.col("src").alias("_src")).agg(
        F.count_if(F.col("kind") == "child").alias("n_children"),
        F.count_if(F.col("kind") == "internal").alias("n_internal"),
        F.sum(F.when(F.col("kind") != "external", title).otherwise(0)).alias("link_title_bytes"),
    )
    d = documents.groupBy(F.col("src").alias("_doc_src")).agg(F.count(F.lit(1)).alias("n_documents"))
    joined = pages.join(e, F.col("url") == F.col("_src"), "left").join(d, F.col("url") == F.col("_doc_src"), "left").drop("_src", "_doc_src")
    return joined.fillna(0, ["n_children", "n_internal", "link_title_bytes", "n_documents"])
