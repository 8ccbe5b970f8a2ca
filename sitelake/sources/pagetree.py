"""A tree of page files as a data source: one JSON file for each page, `_index.json` in a folder of its own by default.

Spark's own readers skip names that begin with an underscore. Here the driver lists folders down to where there are
enough of them (or `depth` levels), each of which is a partition, and tasks walk what is below. Files are read through
pyarrow's file systems, so a path is a local one or a URI that these open (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType, TimestampType

from sitelake.schemas import PAGE

NAME, DEPTH, PARTITIONS = "_index.json", 3, 200
#: Bytes of files that are handed to Spark at once.
BATCH_BYTES = 4 << 20


class Folders(InputPartition):
    """Folders whose own file is read, or (deep) all below them too."""

    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class PageTreeReader(DataSourceReader):
    def __init__(self, path: str, name: str, depth: int):
        self.path, self.name, self.depth = path, name, depth

    def _files(self):
        return _open(self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, top = self._files()
        level, above = [top], []
        for _ in range(self.depth):
            below = [x.path for d in level for x in files.get_file_info(fs.FileSelector(d)) if x.type == fs.FileType.Directory]
            if not below:
                break
            above, level = above + level, below
            if len(level) >= PARTITIONS:
                break
        cut = lambda xs, deep: [Folders(xs[i::n], deep) for n in [min(PARTITIONS, len(xs))] for i in range(n)] if xs else []
        return cut(above, False) + cut(sorted(level), True)

    def read(self, partition: Folders) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        files, _ = self._files()
        rows: list[tuple[str, bytes | None, str | None]] = []
        held = 0
        waiting = list(reversed(partition.folders))
        while waiting:
            folder = waiting.pop()
            for x in files.get_file_info(fs.FileSelector(folder)):
                if x.type == fs.FileType.Directory and partition.deep:
                    waiting.append(x.path)
                elif x.type == fs.FileType.File and x.base_name == self.name:
                    try:
                        with files.open_input_stream(x.path) as f:
                            raw = f.read()
                        raw.decode("utf-8")
                        rows.append((x.path, raw, None))
                        held += len(raw)
                    except (OSError, UnicodeDecodeError) as e:
                        rows.append((x.path, None, type(e).__name__))
                    if held >= BATCH_BYTES:
                        yield self._batch(pa, rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(pa, rows)

    @staticmethod
    def _batch(pa, rows):
        file, raw, error = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(raw, pa.binary()).cast(pa.string()), pa.array(error, pa.string())], ["file", "value", "error"])


class PageTree(DataSource):
    """Options: path, name of the files, depth to which the driver lists folders."""

    @classmethod
    def name(cls) -> str:
        return "pagetree"

    def schema(self) -> str:
        return "file string, value string, error string"

    def reader(self, schema) -> PageTreeReader:
        return PageTreeReader(self.options["path"], self.options.get("name", NAME), int(self.options.get("depth", DEPTH)))


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_tree(pages: DataFrame, path: str, name: str = NAME) -> None:
    """A file for each row (folder, value) at path/folder/name; each appears whole, and one that is there is replaced."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files, top = _open(path)
        for batch in batches:
            for folder, value in zip(batch.column("folder").to_pylist(), batch.column("value").to_pylist(), strict=True):
                files.create_dir(f"{top}/{folder}", recursive=True)
                part = f"{top}/{folder}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write((value or "").encode())
                files.move(part, f"{top}/{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    pages.select("folder", "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number


def _loose(schema: StructType) -> StructType:
    """The schema with times as strings, so that one that can't be read doesn't spoil its record."""
    out = StructType()
    for f in schema:
        kind = f.dataType
        kind = "string" if isinstance(kind, TimestampType) else _loose(kind) if isinstance(kind, StructType) else ArrayType(_loose(kind.elementType)) if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else kind
        out.add(f.name, kind)
    return out


def load_tree(spark: SparkSession, path: str, name: str = NAME, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects (file, error)) of a tree of page files. A file that can't be read, isn't JSON, isn't a record or has no url is
    rejected; fields that are missing are null, unknown ones are left out."""
    from pyspark.sql.types import _parse_datatype_string

    spark.dataSource.register(PageTree)
    schema = _parse_datatype_string(PAGE)
    raw = spark.read.format("pagetree").options(name=name, depth=str(depth)).load(path)
    loose = StructType([*_loose(schema), *_parse_datatype_string("_broken string")])
    parsed = raw.withColumn("p", F.from_json("value", loose, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    error = F.coalesce(F.col("error"), F.when(F.col("p").isNull() | F.col("p._broken").isNotNull(), "not a page record").when(F.coalesce(F.col("p.url"), F.lit("")) == "", "no url"))
    judged = parsed.select("file", error.alias("error"), "p")
    # times become timestamps where they are ones
    cast = lambda c, kind: F.try_to_timestamp(c) if isinstance(kind, TimestampType) else F.when(c.isNotNull(), F.struct(*(cast(c[f.name], f.dataType).alias(f.name) for f in kind))) if isinstance(kind, StructType) else c
    pages = judged.filter("error IS NULL").select(*(cast(F.col("p")[f.name], f.dataType).alias(f.name) for f in schema))
    return pages, judged.filter("error IS NOT NULL").select("file", "error")
