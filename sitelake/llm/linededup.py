"""Line dedup: lines that several documents share stay in one of them.

Lines are exploded with a 128-bit hash of their key and written once, as hashes. Distinct documents
are counted for each hash (partial counts before the shuffle), the hashes over the limit are written,
and the lines are joined to them to find positions to drop. Positions go back to their document, whose
lines but those are put together, in time in proportion to its lines. Documents are told apart by id and 128
bits of their text. All of it is DataFrame functions. A line that a
third of all documents holds is aggregated before the shuffle, and its rows in the join come straight
from an exchange on either side, so adaptive execution can split them.

The key of a line is the line without ASCII white space at both ends, A-Z lower-cased. A null or empty
text is one empty line. Rows with a null doc_id count as one document behind all others. Of repeated
rows of one doc_id all are the same document and each gives a row. An empty table gives no rows. Rows stay packed until
the end, so extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import ASCII_SPACE, ascii_lower, id_key, written

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(ASCII_SPACE))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _own() -> list[Column]:
    """id, t1, t2: what tells rows apart."""
    return [id_key().alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, t1, t2 (hashes of the text), positions: the lines to drop of each text, counted from 0."""
    lines = (
        docs.select(*_own(), _lines(F.col("text")).alias("lines"))  # hashed before lines are exploded, not for each line
        .select("id", "t1", "t2", F.posexplode("lines").alias("pos", "line"))
        .select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    lines = written(lines, "lines")
    # with a limit of two, two distinct documents are a smallest and another largest one
    many = F.min("id") < F.max("id") if min_docs == 2 else F.count_distinct("id") >= min_docs
    over = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), many.alias("many")).filter("many").select("h1", "h2", "first")
    over = written(over, "shared-lines")
    drop = lines.join(over, ["h1", "h2"]).filter(F.col("id") != F.col("first"))
    return drop.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, n_lines, n_dropped, kept): doc has the columns of docs, its text null; kept is the text without dropped lines."""
    empty = F.struct("*").withField("text", F.lit(None).cast("string"))  # texts go as lines
    own = docs.select(empty.alias("doc"), *_own(), _lines(F.col("text")).alias("lines"))
    joined = own.join(shared_lines(docs, min_chars, min_docs), ["id", "t1", "t2"], "left")
    # a set difference of positions; lines are a column of the join's input, so that they aren't split for each position
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "positions")
    left = F.when(F.col("positions").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return joined.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(left, "\n").alias("kept"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def keep_unique_lines(docs: DataFrame) -> DataFrame:
    """The documents with the same columns, texts without dropped lines and n_chars counted anew."""
    doc = F.col("doc").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.char_length("kept").cast("long"))
    return dedup_lines(docs).select(doc.alias("doc")).select("doc.*")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
    SELECT doc_id, i, ls[i] AS line,
           translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)
),
keys AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(l.doc_id <> d.first, false) AS gone FROM lines l LEFT JOIN keys d ON l.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
