"""A table of pages that a stream of changes keeps up to date.

Changes are (url, <order>, deleted, ...): of all changes of a url the last by the order column counts, whenever it arrives; of ties, that
whose values are the largest as JSON. A deleted page stays as a mark, so that an older change that comes later doesn't bring
it back. Urls outside the prefix or with an unsafe segment are rejected, and kept aside.

The table is dealt to a fixed number of buckets by a hash of the url. A batch writes new files for the buckets that it touches and
then publishes a version of the manifest (bucket, folder), so readers see all of a batch or nothing. The manifest
carries the number of the last batch: a batch that comes again, as after a restart, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from sitelake.operators.snapshots import is_safe
from sitelake.sources import versions
from sitelake.sources.work import remove

BUCKETS = 64
MANIFEST = "bucket int, folder string, batch long"


class PageStore:
    """The table below a path. `schema` has url and the order column; `buckets` has to stay the same."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, prefix: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.prefix, self.order, self.buckets = spark, path.rstrip("/"), prefix, order, buckets
        self.schema = StructType([*(f for f in schema if f.name != "deleted"), StructField("deleted", BooleanType())])

    def _manifest(self) -> tuple[int, list]:
        number, rows = versions.latest(self.spark, f"{self.path}/manifest")
        return number, rows.collect() if rows is not None else []  # a row for each bucket

    def _read(self, entries: list) -> DataFrame:
        paths = [f"{self.path}/data/{e.folder}/bucket={e.bucket}" for e in entries if e.folder]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def pages(self) -> DataFrame:
        """The pages as of the newest batch."""
        return self._read(self._manifest()[1]).filter("NOT deleted").drop("deleted")

    def rejects(self) -> DataFrame:
        """All changes that were refused, of batches that have been published."""
        done = max((e.batch for e in self._manifest()[1]), default=-1)
        top = f"{self.path}/rejects"
        if not versions.exists(self.spark, top):
            return self.spark.createDataFrame([], self.schema)
        own = StructType([*self.schema, StructField("batch", IntegerType())])
        return self.spark.read.schema(own).option("basePath", top).parquet(top).filter(F.col("batch") <= done).drop("batch")

    def _last(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*(F.col(f"`{f.name}`") for f in self.schema))
        return rows.groupBy("url").agg(F.max_by(row, F.struct(F.col(f"`{self.order}`"), F.to_json(row))).alias("_row")).select("_row.*")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Apply a batch of changes, unless it or a later one has been applied."""
        number, entries = self._manifest()
        if batch <= max((e.batch for e in entries), default=-1):
            return
        known = changes.withColumn("deleted", F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False))
        known = known.select(*(F.col(f"`{f.name}`") for f in self.schema))
        good = is_safe(F.col("url"), self.prefix)
        known.filter(~good).write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch}")
        bucket = F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")
        new = self._last(known.filter(good)).withColumn("bucket", bucket)
        folder = f"{batch:010d}-{uuid.uuid4().hex[:8]}"
        changed = f"{self.path}/changes/{folder}"
        new.write.partitionBy("bucket").parquet(changed)  # read twice: for the buckets it touches, and to be merged
        of = self.spark.read.schema(StructType([*self.schema, StructField("bucket", IntegerType())])).parquet(changed)
        touched = {r.bucket for r in of.select("bucket").distinct().collect()}  # of self.buckets at most
        old = self._read([e for e in entries if e.bucket in touched])
        merged = self._last(old.unionByName(of.drop("bucket"))).withColumn("bucket", bucket)
        if touched:
            merged.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        # untouched buckets keep their files; a manifest without any row has one that says the batch was there
        rows = {e.bucket: e.folder for e in entries} | {b: folder for b in touched} or {-1: ""}
        publish = self.spark.createDataFrame([(b, f, batch) for b, f in rows.items()], MANIFEST)
        versions.publish(publish.coalesce(1), f"{self.path}/manifest", number + 1)
        remove(self.spark, [changed])

    def follow(self, changes: DataFrame) -> DataStreamWriter:
        """The writer of a stream of changes into this table; the caller adds a trigger and a checkpoint and starts it."""
        return changes.writeStream.foreachBatch(self.apply)

    def vacuum(self) -> None:
        """Remove files and manifests that the newest one doesn't name; when nobody reads an older version any more."""
        used = {e.folder for e in self._manifest()[1]}
        old = [p for p, _, _ in versions.children(self.spark, f"{self.path}/data") if p.rsplit("/", 1)[1] not in used]
        old += [versions.at_version(f"{self.path}/manifest", v) for v in versions.versions(self.spark, f"{self.path}/manifest")[:-1]]
        remove(self.spark, old)
