"""Page types, suspicious responses and fetch outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as T

# Statuses that may pass, and what network errors say.
TRANSIENT = (429, 500, 502, 503, 504)
NETWORK_ERRORS = ("connection reset", "connection refused", "no such host", "i/o timeout")
LONG_PAUSE_S = 60


@dataclass(frozen=True)
class PageTypes:
    """Thresholds of classify_page_type()."""

    empty_below: int = 100
    landing_below: int = 500
    link_ratio: float = 0.5
    listing_items: int = 8
    listing_paragraphs: int = 2
    paragraph_bytes: int = 160
    few_links: int = 3


@dataclass(frozen=True)
class Suspicion:
    """Settings of suspicious_responses(). Block titles, firewall headers, marker headers."""

    least_body: int = 500
    titles: tuple[str, ...] = ("Access Denied", "Forbidden", "Captcha", "Cloudflare", "Just a moment")
    firewall_headers: tuple[str, ...] = ("Cf-Ray", "X-Sucuri-Id")
    markers: dict[str, str] = field(default_factory=lambda: {"X-Generator": "Plone"})


def long_paragraphs(text: Column, least: int) -> Column:
    """Lines of at least so many bytes, without white space around them."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.octet_length(T.trimmed(x)) >= least))


def classify_page_type(pages: DataFrame, cfg: PageTypes = PageTypes()) -> DataFrame:
    """Pages (content_length, full_text, n_children, n_internal, link_title_bytes, n_documents, http_status,
    redirected_from) with page_type and has_substantive_content. The status is known before the type."""
    items = F.col("n_children") + F.col("n_documents")
    redirect = F.coalesce(F.col("http_status").between(300, 399), F.lit(False)) | (F.coalesce("redirected_from", F.lit("")) != "")
    empty = (F.col("content_length") < cfg.empty_below) & (F.col("n_children") == 0) & (F.col("n_documents") == 0) & (F.col("n_internal") < cfg.few_links)
    listing = (items >= cfg.listing_items) & (long_paragraphs(F.coalesce("full_text", F.lit("")), cfg.paragraph_bytes) <= cfg.listing_paragraphs)
    ratio = F.col("link_title_bytes") / F.greatest(F.col("content_length"), F.lit(1))
    landing = (F.col("content_length") < cfg.landing_below) & (ratio > cfg.link_ratio)
    kind = F.when(redirect, "redirect").when(empty, "empty").when(listing, "listing").when(landing, "landing").otherwise("article")
    return pages.withColumn("page_type", kind).withColumn("has_substantive_content", F.col("page_type").isin("article", "listing"))


def suspicious_responses(fetches: DataFrame, prior: DataFrame, cfg: Suspicion = Suspicion()) -> DataFrame:
    """Fetches (url, title, body_bytes, headers) with reason: title_pattern, body_too_small (the prior
    snapshot has content for the URL) or waf_headers (and no marker header), or null."""
    known = prior.filter("content_length > 0").select(F.col("canonical_url").alias("_url")).distinct().withColumn("_known", F.lit(True))
    low = F.lower(F.coalesce("title", F.lit("")))
    blocked = F.exists(F.array(*(F.lit(t.lower()) for t in cfg.titles)), lambda t: F.contains(low, t))
    lowered = F.transform_keys("headers", lambda k, _: F.lower(k))
    has = lambda name: F.coalesce(F.try_element_at(lowered, F.lit(name.lower())), F.lit(""))
    walled = F.lit(False)
    for name in cfg.firewall_headers:
        walled = walled | (has(name) != "")
    for name, value in cfg.markers.items():
        walled = walled & (has(name) != value)
    joined = fetches.join(known, F.col("url") == F.col("_url"), "left")
    reason = F.when(blocked, "title_pattern").when(F.col("_known") & (F.col("body_bytes") < cfg.least_body), "body_too_small").when(F.coalesce(walled, F.lit(False)), "waf_headers")
    return joined.withColumn("reason", reason).drop("_url", "_known")


def fetch_outcomes(log: DataFrame, now: datetime) -> DataFrame:
    """Log (status, error, retry_after) with outcome (ok, transient or permanent), retry_after_s (seconds or an
    HTTP date against `now`, never negative) and long_pause."""
    network = F.exists(F.array(*map(F.lit, NETWORK_ERRORS)), lambda e: F.contains(F.lower("error"), e))
    outcome = (
        F.when(F.col("error").isNotNull(), F.when(network, "transient").otherwise("permanent"))
        .when(F.col("status").isin(*TRANSIENT), "transient")
        .when(F.col("status") < 400, "ok")
        .otherwise("permanent")
    )
    value = F.trim("retry_after")
    at = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(value.rlike(r"^[+-]?\d{1,9}$"), value.cast("long")).otherwise(F.unix_timestamp(at) - F.unix_timestamp(F.lit(now).cast("timestamp")))
    out = log.withColumns({"outcome": outcome, "retry_after_s": F.greatest(seconds, F.lit(0).cast("long"))})
    return out.withColumn("retry_after_s", F.when(seconds.isNotNull(), F.col("retry_after_s"))).withColumn("long_pause", F.coalesce(F.col("retry_after_s") > LONG_PAUSE_S, F.lit(False)))
