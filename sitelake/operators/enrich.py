"""Summary enrichment: which pages need one, their prompts, a user function's results, reports and costs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.sources import versions

LONGEST, EXCERPT, CHILDREN = 500, 1500, 15
TEMPLATES = {
    "landing": "Describe in at most 500 characters what a visitor finds on the page '{title}' ({path}). Subpages: {children}. It has {n_children} subpages and {n_documents} documents.\n\n{excerpt}",
    "listing": "Say in at most 500 characters what the list on the page '{title}' in {section} ({path}) holds. It has {n_children} entries and {n_documents} documents.\n\n{excerpt}",
    "article": "Summarize the page '{title}' in {section} ({path}) in at most 500 characters.\n\n{excerpt}",
}


def select_for_summary(pages: DataFrame, force: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(todo, skipped with reason) of pages (url, page_type, full_text_hash, summary_text, summary_hash)."""
    done = (F.coalesce("summary_text", F.lit("")) != "") & F.col("summary_hash").eqNullSafe(F.col("full_text_hash")) & F.lit(not force)
    reason = F.when(F.col("page_type") == "empty", "empty_content").when(F.col("page_type") == "redirect", "redirect").when(done, "up_to_date")
    marked = pages.withColumn("reason", reason)
    todo = marked.filter("reason IS NULL").drop("reason")
    return todo if most is None else todo.orderBy("url").limit(most), marked.filter("reason IS NOT NULL")


def render_prompts(pages: DataFrame) -> DataFrame:
    """Pages (title, section, path_titles, child_titles, n_documents, page_type, full_text) with prompt."""
    values = {
        "{title}": F.coalesce("title", F.lit("")),
        "{section}": F.coalesce("section", F.lit("")),
        "{path}": F.array_join("path_titles", " › "),
        "{children}": F.array_join(F.slice("child_titles", 1, CHILDREN), ", "),
        "{n_documents}": F.col("n_documents").cast("string"),
        "{n_children}": F.size("child_titles").cast("string"),
        "{excerpt}": F.left(F.coalesce("full_text", F.lit("")), F.lit(EXCERPT)),
    }
    template = F.when(F.col("page_type") == "landing", TEMPLATES["landing"]).when(F.col("page_type") == "listing", TEMPLATES["listing"]).otherwise(TEMPLATES["article"])
    for mark, value in values.items():
        template = F.replace(template, F.lit(mark), value)
    return pages.withColumn("prompt", template)


def enrich_batches(prompts: DataFrame, fn: Callable[[str], tuple[str, int, int]], concurrency: int | None = None) -> DataFrame:
    """Prompts (url, prompt) with text (at most 500 characters), error_class, tokens_in and tokens_out of a
    user's function; an exception becomes the row's error class. `concurrency` tasks run at a time at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch.prompt:
                try:
                    text, tokens_in, tokens_out = fn(prompt)
                    rows.append((text.strip()[:LONGEST], None, tokens_in, tokens_out))
                except Exception as e:  # noqa: BLE001  a failing row must not end the job
                    rows.append((None, type(e).__name__, 0, 0))
            yield pd.DataFrame({"url": batch.url, **dict(zip(("text", "error_class", "tokens_in", "tokens_out"), map(list, zip(*rows, strict=True)), strict=True))}) if rows else pd.DataFrame(columns=["url", "text", "error_class", "tokens_in", "tokens_out"])

    dealt = prompts.select("url", "prompt")
    return (dealt.repartition(concurrency) if concurrency else dealt).mapInPandas(run, "url string, text string, error_class string, tokens_in long, tokens_out long")


LOG = "hash string, text string, error_class string, tokens_in long, tokens_out long"


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The results in a log, one for each prompt (by its hash): a good one if there is any."""
    if not versions.exists(spark, log):
        return spark.createDataFrame([], LOG)
    rows = spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(log)
    best = F.max_by(F.struct("text", "error_class", "tokens_in", "tokens_out"), F.struct(F.col("error_class").isNull(), F.col("text"), F.col("error_class")))
    return rows.groupBy("hash").agg(best.alias("r")).select("hash", "r.*")


def enrich_resumable(prompts: DataFrame, fn: Callable[[str], tuple[str, int, int]], log: str, buckets: int = 64, flush: int = 16) -> DataFrame:
    """enrich_batches() with a log that outlives the run: (url, text, error_class, tokens_in, tokens_out) of prompts (url, prompt).
    Equal prompts are called for once. Results go to the log from inside the task, after every `flush` calls, so a run that is
    killed has lost at most so many calls a task; the next one, or a task that is tried again, leaves out what the log has. Failed calls
    are made again by the next run. `log` is a path or URI that Spark and pyarrow's file systems both open, and goes
    with one function: another one needs another log."""
    spark = prompts.sparkSession
    hashed = prompts.select("url", F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("hash", F.sha2("prompt", 256))
    done = read_log(spark, log).filter("error_class IS NULL").select("hash")
    todo = hashed.groupBy("hash").agg(F.first("prompt").alias("prompt")).join(done, "hash", "left_anti")
    dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, own, rows = None, ResultLog(log), []
        for batch in batches:
            for b, key, prompt in zip(batch.bucket, batch.hash, batch.prompt, strict=True):
                if b != bucket:
                    own.add(bucket, rows)
                    bucket, rows, seen = b, [], own.finished(b)
                if key in seen:
                    continue
                try:
                    text, tokens_in, tokens_out = fn(prompt)
                    rows.append((key, text.strip()[:LONGEST], None, tokens_in, tokens_out))
                except Exception as e:  # noqa: BLE001  a failing row must not end the job
                    rows.append((key, None, type(e).__name__, 0, 0))
                if len(rows) >= flush:
                    own.add(bucket, rows)
                    rows = []
        own.add(bucket, rows)
        yield pd.DataFrame({"n": [own.n]})

    dealt.mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one number
    results = read_log(spark, log)
    return hashed.join(results, "hash").select("url", "text", "error_class", "tokens_in", "tokens_out")


class ResultLog:
    """A log of results as a task writes it: a file for each flush, in the folder of its bucket, seen once it is whole."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.n = 0

    def finished(self, bucket: int) -> set[str]:
        """Hashes of the good results of a bucket."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        found: set[str] = set()
        for x in self.fs.get_file_info(fs.FileSelector(f"{self.top}/b{bucket}", allow_not_found=True)):
            if x.base_name.startswith("part-"):
                rows = pq.read_table(x.path, filesystem=self.fs, columns=["hash", "error_class"]).to_pylist()
                found |= {r["hash"] for r in rows if r["error_class"] is None}
        return found

    def add(self, bucket: int | None, rows: list[tuple]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not rows:
            return
        folder, name = f"{self.top}/b{bucket}", f"{uuid.uuid4().hex}.parquet"
        self.fs.create_dir(folder, recursive=True)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        table = pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split(" ")[0] for f in LOG.split(", ")])
        pq.write_table(table, f"{folder}/_{name}", filesystem=self.fs)
        self.fs.move(f"{folder}/_{name}", f"{folder}/part-{name}")
        self.n += len(rows)


def summarize_report(results: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of counts and tokens, failures by reason)."""
    one = results.agg(
        F.count_if(F.col("error_class").isNull()).alias("n_generated"),
        F.count("error_class").alias("n_failed"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
    ).join(skipped.agg(F.count(F.lit(1)).alias("n_skipped")))
    reasons = results.filter("error_class IS NOT NULL").groupBy(F.col("error_class").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return one.withColumn("n_total", F.col("n_generated") + F.col("n_failed") + F.col("n_skipped")), reasons


def estimate_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage (usage_id, provider, model, tokens_in, tokens_out) with cost: that of the first price row
    (rank, provider, model_prefix, in_per_mtok, out_per_mtok) that fits but for case; without one 0. The
    provider is the key of the join; distinct models are priced once and joined back."""
    models = usage.select(F.lower("provider").alias("_p"), F.lower("model").alias("_m")).distinct()
    # a model looks up its own beginnings, so it meets only prices that fit
    p = prices.groupBy(F.lower("provider").alias("_p"), F.lower("model_prefix").alias("_prefix")).agg(F.min(F.struct("rank", "in_per_mtok", "out_per_mtok")).alias("price"))
    begins = models.select("_p", "_m", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("_m")), lambda n: F.left("_m", n))).alias("_prefix"))
    fit = begins.join(p, ["_p", "_prefix"]).groupBy("_p", "_m").agg(F.min("price").alias("price"))
    joined = usage.withColumns({"_p": F.lower("provider"), "_m": F.lower("model")}).join(fit, ["_p", "_m"], "left")
    cost = F.col("tokens_in") / 1e6 * F.col("price.in_per_mtok") + F.col("tokens_out") / 1e6 * F.col("price.out_per_mtok")
    return joined.withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("_p", "_m", "price")
