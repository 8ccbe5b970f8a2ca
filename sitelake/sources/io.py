"""Sources and sinks: page tables, sitemaps, catalogs, CSV profiles, named extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sitelake.schemas import PAGE
from sitelake.sources.pagetree import load_tree


def load_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Page records of a Parquet table, of a tree of JSON files (one record each; kind="json") or of a tree of `_index.json` files
    (kind="tree"; pagetree.load_tree() also gives those that were rejected)."""
    if kind == "tree":
        return load_tree(spark, path)[0]
    if kind == "json":
        return spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return spark.read.parquet(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of a plain or gzip sitemap; rows without loc are dropped, a lastmod that can't be read is
    null."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    at = F.coalesce(*(F.try_to_timestamp(F.trim("lastmod"), F.lit(f)) for f in formats))
    return rows.select(F.trim("loc").alias("loc"), at.alias("lastmod")).filter("loc <> ''")


def write_catalog(entries: DataFrame, stats: DataFrame, path: str) -> None:
    """Entries sorted by path, and their statistics, as JSON below path."""
    entries.orderBy("path", "url").write.mode("overwrite").json(f"{path}/entries")
    stats.orderBy("dimension", "key").write.mode("overwrite").json(f"{path}/stats")


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(header=True, inferSchema=True, **options).csv(path)


def csv_profile(df: DataFrame, value_name: str = "valor") -> DataFrame:
    """One row: n_rows, n_columns, column_names, and the sum of the first column whose name holds value_name."""
    found = next((f for f in df.schema if value_name in f.name.lower()), None)
    total = F.sum(F.col(f"`{found.name}`") if isinstance(found.dataType, NumericType) else F.try_to_number(F.col(f"`{found.name}`"), F.lit("S999999999999D99"))) if found else F.lit(None)
    names = F.array(*map(F.lit, df.columns)) if df.columns else F.array().cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("double").alias("total")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), names.alias("column_names"), "total")


def save_extract(df: DataFrame, path: str, name: str) -> None:
    """Write a named extract; an empty one is an error."""
    if df.limit(1).isEmpty():
        raise ValueError(f"extract {name} has no rows")
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_extract(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a named extract; a missing one is an error of the reader."""
    return spark.read.parquet(f"{path}/{name}")
