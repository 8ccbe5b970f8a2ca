"""Redirect chains: where every URL ends up, over how many hops, and which run in circles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.sources.work import written


def redirects_of(pages: DataFrame) -> DataFrame:
    """(url, target) of pages (url, redirected_from): what was asked for and where it led."""
    return pages.filter("redirected_from <> '' AND url IS NOT NULL AND redirected_from <> url").select(F.col("redirected_from").alias("url"), F.col("url").alias("target"))


def redirect_chains(redirects: DataFrame, order: str | None = None) -> DataFrame:
    """(url, target, hops, cyclic) of redirects (url, target): every URL that redirects, with the first URL on its way that doesn't and
    the number of redirects up to it; on a way that ends in a circle, cyclic, both are null. Of several redirects of a URL the last by
    the column `order` counts, of ties, or without it, the largest target. A URL that redirects to itself, or null, is none.

    Every pointer is followed by that of its target, so ways get twice as long a round: as many rounds as the logarithm of
    the longest chain, and at most of the number of redirects, when what isn't done is cyclic. Ways that are done aren't joined
    again; both sides of a join come from written tables, so that a target that many share can be split."""
    by = F.struct(*([F.col(order)] if order else []), "target")
    edges = redirects.filter("url IS NOT NULL AND target IS NOT NULL AND url <> target").groupBy("url").agg(F.max_by("target", by).alias("target"))
    edges = written(edges, "redirects")
    goes_on = edges.select(F.col("url").alias("_next"), F.lit(True).alias("_on"))
    state = edges.join(goes_on, F.col("target") == F.col("_next"), "left").select("url", "target", F.lit(1).cast("long").alias("hops"), F.col("_on").isNull().alias("done"))
    state, longest, n = written(state, "chains"), 1, edges.count()
    while longest <= n and not (open_ways := state.filter("NOT done")).isEmpty():
        after = state.select(F.col("url").alias("_url"), F.col("target").alias("_target"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = open_ways.join(after, F.col("target") == F.col("_url")).select("url", F.col("_target").alias("target"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        state, longest = written(state.filter("done").unionByName(moved), "chains"), longest * 2
    only = lambda c: F.when(F.col("done"), F.col(c)).alias(c)
    return state.select("url", only("target"), only("hops"), (~F.col("done")).alias("cyclic"))


def resolved(urls: DataFrame, chains: DataFrame, column: str = "url") -> DataFrame:
    """The rows with `final`: where the URL leads (itself without a redirect, null in a circle)."""
    to = chains.select(F.col("url").alias("_from"), F.col("target").alias("_to"), "cyclic")
    joined = urls.join(to, F.col(column) == F.col("_from"), "left")
    return joined.withColumn("final", F.when(F.coalesce("cyclic", F.lit(False)), None).otherwise(F.coalesce("_to", F.col(column)))).drop("_from", "_to", "cyclic")
