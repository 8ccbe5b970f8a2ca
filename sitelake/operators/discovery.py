"""URL operators: canonical forms, scope, hierarchy, copies, robots rules, doubled segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.functions import urls as U


def canonicalize_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """The rows with canonical, excluded and error."""
    return df.withColumn("_c", U.canonicalize(F.col(column))).withColumns({k: F.col(f"_c.{k}") for k in ("canonical", "excluded", "error")}).drop("_c")


def discover_in_scope(sitemap: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each (loc) with canonical and status: invalid, excluded, out_of_scope or in_scope. scopes: (host,
    prefix) rows; a URL is in scope if it stands under any prefix of its host."""
    c = canonicalize_urls(sitemap, "loc").withColumn("host", U.host_of(F.col("canonical")))
    prefixes = scopes.groupBy("host").agg(F.collect_set("prefix").alias("prefixes"))
    inside = F.exists("prefixes", lambda p: U.in_scope(F.col("canonical"), p))
    status = F.when(F.col("error"), "invalid").when(F.col("excluded"), "excluded").when(F.coalesce(inside, F.lit(False)), "in_scope").otherwise("out_of_scope")
    return c.join(prefixes, "host", "left").withColumn("status", status).drop("prefixes", "error", "excluded")


def scope_counts(discovered: DataFrame) -> DataFrame:
    return discovered.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def require_in_scope(counts: DataFrame) -> None:
    """Nothing in scope is an error."""
    if counts.filter("status = 'in_scope' AND n > 0").isEmpty():
        raise ValueError("no URL is in scope")


def url_hierarchy(df: DataFrame, prefix: str = "prefix", column: str = "url") -> DataFrame:
    """The rows with depth, parent_url and path below their prefix."""
    u, p = F.col(column), F.col(prefix)
    return df.withColumns({"depth": U.depth(u, p), "parent_url": U.parent_url(u, p), "path": U.relative_path(u, p)})


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """The rows with `allowed`. rules: (host, agent, allow, path_pattern), where * stands for anything and
    a final $ for the end; rules of the agent are taken if its host has any, else those of *. The longest
    pattern wins, and of equal ones the allowing one; hosts without rules allow. Rules are keys: a distinct path looks up its
    beginnings, of the lengths that its host's rules have, so it meets the rules it begins with and not the others. A pattern with
    a sign (*, $) is found by what stands before it and tried then."""
    own = rules.filter(F.lower("agent").isin(agent.lower(), "*")).withColumn("_own", F.lower("agent") == agent.lower())
    best = own.groupBy(F.col("host").alias("_host")).agg(F.max("_own").alias("_has_own"))
    own = own.join(best, (F.col("host") == F.col("_host")) & (F.col("_own") == F.col("_has_own")))
    pattern = F.col("path_pattern")
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.concat(F.lit(r"^\Q"), F.replace(body, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"), F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))
    # what a path has to begin with: all of a plain rule, of others what stands before the first sign
    head = F.regexp_extract(pattern, r"(?s)^([^*]*?)(?:\*|\$$|$)", 1)
    plain = ~F.contains(pattern, F.lit("*")) & ~F.endswith(pattern, F.lit("$"))
    keyed = own.filter("path_pattern <> ''").select("_host", head.alias("_head"), F.char_length(pattern).alias("length"), "allow", F.when(~plain, quoted).alias("regex"))
    # of rules with one head: the best plain one, and those that have to be tried
    keyed = keyed.groupBy("_host", "_head").agg(
        F.max(F.when(F.col("regex").isNull(), F.struct("length", "allow"))).alias("_plain"),
        F.collect_set(F.when(F.col("regex").isNotNull(), F.struct("length", "allow", "regex"))).alias("_signs"),
    )
    lengths = keyed.groupBy("_host").agg(F.collect_set(F.char_length("_head")).alias("_lengths"))
    path = F.when(U.path_of(F.col("url")) == "", "/").otherwise(U.path_of(F.col("url")))
    placed = urls.withColumns({"_url_host": U.host_of(F.col("url")), "_path": path})
    asked = placed.select(F.col("_url_host").alias("_host"), "_path").distinct().join(lengths, "_host")
    heads = asked.select("_host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("_path"))).alias("_n"))
    hits = heads.withColumn("_head", F.left("_path", F.col("_n"))).join(keyed, ["_host", "_head"])
    tried = F.array_max(F.transform(F.filter("_signs", lambda r: F.regexp_like(F.col("_path"), r["regex"])), lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))))
    best = hits.groupBy("_host", "_path").agg(F.max(F.greatest(F.col("_plain"), tried)).alias("_best"))
    best = best.select(F.col("_host").alias("_best_host"), F.col("_path").alias("_best_path"), F.col("_best.allow").alias("_allow"))
    joined = placed.join(best, (F.col("_url_host") == F.col("_best_host")) & (F.col("_path") == F.col("_best_path")), "left")
    return joined.withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_url_host", "_path", "_best_host", "_best_path", "_allow")


def doubled_segment_pairs(pages: DataFrame) -> DataFrame:
    """(short_url, long_url) where long_url repeats the last segment of short_url and both have one hash."""
    long = pages.filter(F.col("url").rlike(r"/([^/]+)/\1$") & (F.col("content_hash") != "")).select(F.regexp_replace("url", "/[^/]+$", "").alias("short_url"), F.col("url").alias("long_url"), F.col("content_hash").alias("_h"))
    short = pages.select(F.col("url").alias("short_url"), F.col("content_hash").alias("_h"))
    return long.join(short, ["short_url", "_h"]).select("short_url", "long_url")
