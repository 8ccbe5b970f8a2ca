"""URL rules as column expressions: canonical form, copies, place in a hierarchy, resolution of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track visitors; utm_ is a prefix.
TRACKING_KEYS = ("gclid", "fbclid", "_ga", "portal_form_id")
TRACKING_PREFIX = "utm_"
# Path parts that mark views and theme files.
EXCLUDED_PARTS = ("@@", "++theme++")
# Fixed value: a path segment that marks a copied page.
COPY_SEGMENT = r"(^|/)copy\d*_of"

_URL = r"^(?s)([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def _part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_of(url: Column) -> Column:
    """Host with port, lower-cased, without the scheme's default port."""
    host = F.lower(_part(url, 2))
    for scheme, port in DEFAULT_PORTS.items():
        host = F.when((scheme_of(url) == scheme) & host.endswith(f":{port}"), F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    return F.regexp_replace(host, ":$", "")


def path_of(url: Column) -> Column:
    return _part(url, 3)


def _encoded(c: Column) -> Column:
    """Query escaping that leaves letters, digits and -_.~ and writes a space as +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """The pairs of a query string without tracking keys, sorted by key (stable), escaped anew."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    decoded = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.regexp_extract(p, "^[^=]*", 0)).alias("key"),
            i.alias("i"),
            F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("value"),
        ),
    )
    kept = F.filter(decoded, lambda x: x["key"].isNotNull() & x["value"].isNotNull() & ~x["key"].isin(*TRACKING_KEYS) & ~x["key"].startswith(TRACKING_PREFIX))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(_encoded(x["key"]), F.lit("="), _encoded(x["value"]))), "&")


def canonicalize(url: Column) -> Column:
    """STRUCT<canonical, excluded, error>. Only http and https without control characters or broken
    escapes in the path are canonicalized; anything else (null too) is an error without a canonical form.
    Path escapes stay as they are, non-ASCII characters too."""
    scheme, path = scheme_of(url), path_of(url)
    error = url.isNull() | ~scheme.isin("http", "https") | url.rlike(r"[\x00-\x1F\x7F]") | path.rlike("%(?![0-9A-Fa-f]{2})")
    raw_query = _part(url, 4)
    query = canonical_query(F.regexp_replace(raw_query, r"^\?", ""))
    tail = F.when(raw_query == "?", "?").when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    trimmed = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/+$", "")).otherwise(path)
    excluded = F.lit(False)
    for part in EXCLUDED_PARTS:
        excluded = excluded | F.contains(path, F.lit(part))
    return F.struct(
        F.when(~error, F.concat(scheme, F.lit("://"), host_of(url), trimmed, tail)).alias("canonical"),
        (F.coalesce(~error & excluded, F.lit(False))).alias("excluded"),
        F.coalesce(error, F.lit(True)).alias("error"),
    )


def is_copy(url_or_path: Column) -> Column:
    """Whether a path segment begins with copy_of or copy<N>_of."""
    path = F.when(url_or_path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(url_or_path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)).otherwise(url_or_path)
    return F.coalesce(path.rlike(COPY_SEGMENT), F.lit(False))


def bare(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def in_scope(url: Column, prefix: Column) -> Column:
    p = bare(prefix)
    return (prefix != "") & ((url == p) | F.startswith(url, F.concat(p, F.lit("/"))))


def depth(url: Column, prefix: Column) -> Column:
    """Path segments below the prefix; 0 for the prefix itself and for URLs outside it."""
    u, p = bare(url), bare(prefix)
    below = F.substr(u, F.char_length(p) + 2)
    return F.when(F.startswith(u, F.concat(p, F.lit("/"))) & (below != ""), F.size(F.split(below, "/"))).otherwise(0)


def parent_url(url: Column, prefix: Column) -> Column:
    """One segment up, the prefix at depth 1, and blank for the prefix itself or outside it."""
    u, p = bare(url), bare(prefix)
    up = F.regexp_replace(u, "/[^/]*$", "")
    return F.when(~F.startswith(u, F.concat(p, F.lit("/"))), "").when(F.char_length(up) <= F.char_length(p), p).otherwise(up)


def relative_path(url: Column, prefix: Column) -> Column:
    """Below the prefix: the rest; the prefix itself: blank; elsewhere: the URL."""
    u, p = bare(url), bare(prefix)
    return F.when(u == p, "").when(F.startswith(u, F.concat(p, F.lit("/"))), F.regexp_replace(F.substr(u, F.char_length(p) + 1), "^/+", "")).otherwise(u)


def resolve(base: Column, href: Column) -> Column:
    """A link's absolute URL: full URLs as they are; //, /, ?, # and relative paths against the base,
    with . and .. segments removed."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0)
    path = path_of(base)
    own, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_replace(href, "^[^?#]*", "")
    joined = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")), own))
    parts = F.slice(F.split(joined, "/"), 2, 1_000_000_000)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    slash = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(folded) > 0), "/").otherwise("")
    absolute = F.concat(origin, F.lit("/"), F.array_join(folded, "/"), slash, rest)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(href == "", base)
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(absolute)
    )
