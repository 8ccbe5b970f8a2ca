"""Quality rules: counts for each document, and the frequency of its lines in its host.

One pass over the texts counts words, symbols, repeated lines and repeated word windows, and gives for
each document the hashes and word counts of its distinct normalised lines. Distinct documents are counted
for each line of a host (the column `source`). A line is over the limit if at least `min_docs` documents and
`share` of the host's hold it; it is removed from all texts but that of the first document that holds it, so
that what many documents repeat stays once. A document that has lost at least `depleted` of its words is
rejected.

Defined results: a null text has no words and fails; a null host is a host of its own; rows with a null
doc_id count as one document behind all others, as rows of one doc_id do; words are removed from each text by
itself, so rows that repeat an id, a host and a text give a row each with the same counts. Extra columns
pass through where documents are returned.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import id_key, raw_texts, sliced, small_batches, text_key, written

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Limits of a line, and the part of a document's words. Of 45,330 documents that pass the base rules these take
#: lines from 15,829 and reject 28; at twice the share no document would lose half of its words.
MIN_DOCS, SHARE, DEPLETED = 10, 0.005, 0.5

_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NOT_START = bytes(range(0x80, 0xC0))  # a character has one byte that isn't of these

_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
_DIGEST = ("text_sha256", pa.string())
_LINES = [("line_hashes", pa.list_(pa.binary())), ("line_words", pa.list_(pa.int32()))]


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = raw.split()
    chars = len(b"".join(words).translate(None, _NOT_START))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        n, last = Counter(windows), 0
        for i, x in enumerate(windows):
            if n[x] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return len(words), chars, len(raw.translate(None, _SYMBOLS)), dup, repeated


def _line_key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(line.split()))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found, lines, sizes, digests = [], [], [], []
        for raw in raw_texts(batch):
            found.append(counts(raw))
            digests.append(hashlib.sha256(raw).hexdigest())
            own: dict[bytes, int] = {}
            for line in raw.translate(_LOWER).split(b"\n"):
                if w := line.split():
                    key = _line_key(line)
                    own[key] = own.get(key, 0) + len(w)
            lines.append(list(own))
            sizes.append(list(own.values()))
        columns = [pa.array(x, t) for x, (_, t) in zip(zip(*found, strict=True), _FIELDS, strict=True)]
        columns += [pa.array(x, t) for x, (_, t) in zip((digests, lines, sizes), (_DIGEST, *_LINES), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "text_hash")), *columns], ["doc_id", "host", "text_hash", *(n for n, _ in [*_FIELDS, _DIGEST, *_LINES])])


_SCHEMA = "doc_id long, host string, text_hash binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_sha256 string, line_hashes array<binary>, line_words array<int>"


def _host() -> Column:
    return F.coalesce("source", F.lit(""))


#: What tells rows apart: rows that agree in these get one verdict.
def _keys() -> dict[str, Column]:
    return {"id": id_key(), "host": _host(), "text_hash": text_key()}


def _found(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host().alias("host"), text_key().alias("text_hash"), "text")
    return written(texts.mapInArrow(_batches, _SCHEMA), "line-hashes").withColumn("id", id_key())


def _removed(found: DataFrame, min_docs: int, share: float) -> DataFrame:
    """id, host, text_hash, lines, words: the distinct lines that a text loses, and their words in it."""
    lines = found.select("id", "host", "text_hash", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x"))
    lines = lines.select("id", "host", "text_hash", F.col("x.line_hashes").alias("line"), F.col("x.line_words").alias("words"))
    # distinct (host, line, document) first: neither a hot line nor a hot host meets in one task
    often = lines.select("host", "line", "id").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter(F.col("n") >= min_docs)
    hosts = found.select("host", "id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    over = often.join(hosts, "host").filter(F.col("n") >= F.col("of") * share).select("host", "line", "first")
    over = written(over, "frequent-lines")
    gone = lines.join(over, ["host", "line"]).filter(F.col("id") != F.col("first")).select("id", "host", "text_hash", "line", "words").distinct()
    return written(gone.groupBy("id", "host", "text_hash").agg(F.collect_list("line").alias("lines"), F.sum("words").alias("words")), "removed-lines")


def _verdicts(found: DataFrame, removed: DataFrame, depleted: float) -> DataFrame:
    """found with n_removed_words, base_failed and kept."""
    joined = found.join(removed.select("id", "host", "text_hash", "words"), ["id", "host", "text_hash"], "left")
    gone = F.coalesce("words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return joined.withColumns({"n_removed_words": gone, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") < depleted * F.col("n_words")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their `lines`; where these are null, texts stay as they are."""
    for batch in sliced(batches):
        at, where = batch.schema.get_field_index("text"), batch.column("lines").is_valid()
        if where.true_count:
            own, texts = batch.filter(where), []
            for raw, gone in zip(raw_texts(own), own.column("lines").to_pylist(), strict=True):
                gone = set(gone)
                texts.append(b"\n".join(line for line in raw.split(b"\n") if not (line.strip() and _line_key(line.translate(_LOWER)) in gone)))
            batch = batch.set_column(at, "text", pc.replace_with_mask(batch.column("text"), where, pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)))
        yield batch.drop_columns(["lines"])


def _cut_texts(rows: DataFrame) -> DataFrame:
    """rows (text, lines, others) with the lines removed from the text."""
    return rows.mapInArrow(_cut, rows.drop("lines").schema)


def _without(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs without those that changes (keys, lines, bad) call bad, the others without their lines; n_chars is
    counted anew where a text is cut. One join, so that texts are shuffled once."""
    rest = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("row")  # packed, so that no column can clash
    packed = docs.select(rest, "text", *(v.alias(k) for k, v in _keys().items()))
    joined = packed.join(changes, list(_keys()), "left").filter("bad IS NULL OR NOT bad")
    out = _cut_texts(joined.select("row", "text", "lines", F.col("lines").isNotNull().alias("cut")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """doc_id, the counts, n_removed_words, base_failed, kept, left_sha256 (of the text without its frequent
    lines): a row for each document."""
    found = _found(docs)
    removed = _removed(found, min_docs, share)
    own = docs.select("text", *(v.alias(k) for k, v in _keys().items())).join(removed.drop("words"), list(_keys()))
    left = _cut_texts(own).select(*_keys(), F.sha2("text", 256).alias("left")).dropDuplicates([*_keys()])
    out = _verdicts(found, removed, depleted).join(written(left, "texts-left"), list(_keys()), "left")
    return out.select("doc_id", *(n for n, _ in _FIELDS), "n_removed_words", "base_failed", "kept", F.coalesce("left", "text_sha256").alias("left_sha256"))


def without_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """All documents with the same columns, texts without the lines over the limit, and n_chars counted anew
    where it is there. A text that loses nothing stays as it is, null too."""
    removed = _removed(_found(docs), min_docs, share)
    return _without(docs, removed.select(*_keys(), "lines", F.lit(False).alias("bad")))


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The rows that are kept, without the lines over the limit; all columns stay. A row goes by its own verdict,
    not by that of others of its id."""
    found = _found(docs)
    removed = _removed(found, min_docs, share)
    bad = _verdicts(found, removed, depleted).filter("NOT kept").select(*_keys(), F.lit(None).cast("array<binary>").alias("lines"), F.lit(True).alias("bad"))
    cut = removed.select(*_keys(), "lines", F.lit(False).alias("bad"))
    both = bad.unionByName(cut).groupBy(*_keys()).agg(F.max_by("lines", F.col("lines").isNotNull()).alias("lines"), F.max("bad").alias("bad"))
    return _without(docs, written(both, "changes"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM docs),
win AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) r, (SELECT unnest([0, 1, 2]) AS k) o
    WHERE n >= 2 GROUP BY doc_id
),
lines AS (
    SELECT doc_id, host, i, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS k
    FROM (SELECT doc_id, host, i, ls[i] AS line FROM (SELECT doc_id, host, ls, unnest(range(1, len(ls) + 1)) AS i FROM w))
),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE k <> '' GROUP BY doc_id, line) GROUP BY doc_id),
often AS (SELECT host, k, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM lines WHERE k <> '' GROUP BY host, k HAVING count(DISTINCT doc_id) >= 10),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM docs GROUP BY host),
marked AS (
    SELECT l.*, coalesce(o.n >= h.docs * 0.005 AND l.doc_id <> o.first, false) AS gone
    FROM lines l JOIN hosts h ON h.host = l.host LEFT JOIN often o ON l.host = o.host AND l.k = o.k
),
removed AS (
    SELECT doc_id, coalesce(sum(len(string_split(k, ' '))) FILTER (WHERE gone), 0)::BIGINT AS n,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS left_sha256
    FROM marked GROUP BY doc_id
),
m AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, r.n AS n_removed_words, r.left_sha256
    FROM w LEFT JOIN dup d ON d.doc_id = w.doc_id LEFT JOIN rep p ON p.doc_id = w.doc_id JOIN removed r ON r.doc_id = w.doc_id
)
SELECT * EXCLUDE (base_failed_), base_failed_ AS base_failed, NOT base_failed_ AND n_removed_words < 0.5 * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed_ FROM m)
"""
