"""What several operators share: the shared work folder, written tables, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.sources.work import settled, small_batches, work_path, written  # noqa: F401  for the operators

#: ASCII white space, the only characters that separate words here.
ASCII_SPACE = " \t\n\u000b\f\r"

#: Rows without an id count as one document that sorts behind all others.
NULL_ID = 2**63 - 1

#: Texts are handed to Python in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def text_key(name: str = "text") -> Column:
    """128 bits of a text, null as empty: with id_key() what tells rows apart that share an id."""
    return F.unhex(F.md5(F.coalesce(F.col(name), F.lit("")).cast("binary")))


def without_rows(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs without the rows whose keys are in gone. Rows stay packed, so that none of their columns can clash."""
    packed = docs.select(F.struct("*").alias("row"), *(v.alias(k) for k, v in keys.items()))
    return packed.join(gone.select(*keys), list(keys), "left_anti").select("row.*")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the fast way where it does no more than that."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    same = ~c.rlike(r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{IsUppercase}]]")
    return F.when(same, F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds much more than `most` bytes of text (one long row can)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)
