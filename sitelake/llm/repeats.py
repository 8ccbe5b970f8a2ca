"""Removal of repeated byte strings: every byte under a string of LENGTH bytes that occurs again anywhere.

Each window of LENGTH bytes is assigned to an anchor: of the SPREAD byte strings of length
LENGTH - SPREAD + 1 inside it, the leftmost with the least hash. The anchor depends on the window's
content only, so equal windows have equal anchors at equal places, and a document has about two anchors
for every SPREAD bytes instead of a window for every byte. An anchor's windows are neighbours; the bytes
under them are its context. The job goes from coarse to fine:

1. Anchors and contexts are hashed (64 bits each, by different functions) and written. Repeats inside a
   document are settled there, so that a long run of one character is a row and not a row a byte.
2. Anchors are counted with their smallest and largest context. Those found once are dropped.
3. A context found twice makes all its windows repeated. What is left are contexts found once whose
   anchor has others: the rims of repeats. Only these, and one of each other kind, get their bytes. They
   are short texts aligned at their anchors, and are compared by a column-wise construction: one symbol
   of each context a round, keeping the order of suffixes and their common prefixes (common_windows()).
   An anchor with more than CROWD contexts is dealt to cells: windows that begin within RANGE bytes of each
   other share all bytes but RANGE - 1 at either end, and a cell has the contexts that agree in those. A cell
   that is still crowded is compared by Spark, a row for each of its windows, keyed by the window's hash.
4. Ranges go to their documents, which are cut.

Rows are tied to their texts by 128 bits of id and text.

Groups are aggregated before the shuffle; joins that bring a group's verdict to its rows have an exchange
on both sides, so that adaptive execution splits a hot one.

Defined results: a null text is empty; texts below LENGTH bytes keep all; repeated rows are documents of
their own and so repeat each other; null ids are ids like others; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import raw_texts, sliced, small_batches, written

LENGTH, SPREAD = 400, 200
#: Contexts of an anchor or cell that one task compares, and the windows of a cell that begin at different places.
CROWD, RANGE = 500, 25
#: Contexts compared in one construction, at least; then the current group is filled.
TOGETHER_CONTEXTS = 4_000
#: Bytes hashed together; a longer text is cut into overlapping pieces of at most PIECE.
TOGETHER, PIECE = 1 << 20, 8 << 20

_NOT_START = bytes(range(0x80, 0xC0))  # a character has one byte that isn't of these
_U = np.uint64
_POS = _U((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: A random number for each byte and hash function.
_VALUES = [np.random.default_rng(s).integers(0, 2**64, 256, dtype=np.uint64) | _U(1) for s in (11, 12)]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out, m = np.ones(max(n, 1 << 12), _U), 1
        while m < len(out):
            k = min(m, len(out) - m)
            out[m : m + k] = out[:k] * _U(pow(base, m, 2**64))
            m += k
        _powers[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


class Rolling:
    """Hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray, which: int):
        base = _BASES[which]
        self.up = powers(base, len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[which][data] * powers(pow(base, -1, 2**64), len(data)))])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.up[begin])


def find_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each anchor its text, hash, context's hash, first and last window
    and place (all counted from the start of data)."""
    size, k = len(data), LENGTH - SPREAD + 1
    empty = np.empty(0, np.int64)
    if size < LENGTH:
        return empty, empty, empty, empty, empty, empty
    small, whole = Rolling(data, 0), Rolling(data, 1)
    at = np.arange(size - k + 1)
    hashed = small(at, at + k)
    key = (hashed & ~_POS) | at.astype(_U)
    blocks = np.concatenate([key, np.full(-len(key) % SPREAD, 2**64 - 1, _U)]).reshape(-1, SPREAD)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = size - LENGTH + 1
    place = (np.minimum(right[:n], left[SPREAD - 1 : SPREAD - 1 + n]) & _POS).astype(np.int64)
    starts = np.arange(n)
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + LENGTH <= ends[text]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]]) & inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    shape = (stop - first).astype(_U) * _U(1 << 20) + (place[first] - first).astype(_U)
    context = mix(whole(first, stop + LENGTH) + mix(shape))
    return text[first], hashed[place[first]].view(np.int64), context.view(np.int64), first, stop, place[first]


_ANCHOR = "id long, text long, anchor long, context long, n int, first int, last int, place int"
_NAMES = [x.split()[0] for x in _ANCHOR.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def _rows(ids: np.ndarray, texts: np.ndarray, parts: list[np.ndarray], offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchor rows of some texts. Of equal contexts of one text the first stands for all, with their
    number, and rows without an anchor give the ranges where the others are."""
    ends = np.cumsum([len(p) for p in parts])
    text, anchor, context, first, last, place = find_anchors(np.concatenate(parts) if parts else np.empty(0, np.uint8), ends)
    if not len(text):
        return
    shift = (offsets - np.concatenate([[0], ends[:-1]]))[text]  # to places in the whole text
    first, last, place = first + shift, last + shift, place + shift
    order = np.lexsort((first, context, anchor, text))
    same = np.concatenate([[False], (text[order][1:] == text[order][:-1]) & (anchor[order][1:] == anchor[order][:-1]) & (context[order][1:] == context[order][:-1])])
    lead = np.flatnonzero(~same)
    n = np.diff(np.concatenate([lead, [len(order)]]))
    pick = order[lead]
    own = (ids[text[pick]], texts[text[pick]], anchor[pick], context[pick], n, first[pick], last[pick], place[pick])
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, _KINDS, strict=True)], _NAMES)
    again = np.sort(order[np.repeat(n > 1, n)])
    if len(again):
        t, a, b = text[again], first[again], last[again]
        cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] > b[:-1] + LENGTH)]))
        top = np.maximum.reduceat(b, cut)
        gone = pa.nulls(len(cut), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[t[cut]], pa.int64()), pa.array(texts[t[cut]], pa.int64()), gone, gone, pa.array(np.full(len(cut), 2), pa.int32()), pa.array(a[cut], pa.int32()), pa.array(top, pa.int32()), pa.array(a[cut], pa.int32())], _NAMES)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, most=TOGETHER):
        ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_id"))
        raws = [np.frombuffer(r, np.uint8) for r in raw_texts(batch)]
        own = [(i, r, o) for i, x in enumerate(raws) for o in range(0, max(1, len(x) - LENGTH + 1), PIECE - LENGTH) for r in [x[o : o + PIECE - 1]] if len(r) >= LENGTH]
        held, size = [], 0
        for one in [*own, None]:
            if held and (one is None or size + len(one[1]) > PIECE):
                at = np.array([i for i, _, _ in held])
                yield from _rows(ids[at], texts[at], [r for _, r, _ in held], np.array([o for _, _, o in held]))
                held, size = [], 0
            if one is not None:
                held.append(one)
                size += len(one[1])


def window_hashes(contexts: list[bytes], places: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For contexts aligned at their anchors: two hashes of the window that begins r bytes before the
    anchor, for r from 0 to SPREAD - 1, and whether the context has it."""
    wide = SPREAD - 1 + LENGTH
    data = np.zeros((len(contexts), wide), np.uint8)
    for row, c, p in zip(data, contexts, places, strict=True):
        row[SPREAD - 1 - p : SPREAD - 1 - p + len(c)] = np.frombuffer(c, np.uint8)
    begin, r, out = SPREAD - 1 - np.arange(SPREAD), np.arange(SPREAD), []
    for base, values in zip(_BASES, _VALUES, strict=True):
        sums = np.concatenate([np.zeros((len(data), 1), _U), np.cumsum(values[data] * powers(pow(base, -1, 2**64), wide), axis=1)], axis=1)
        out.append(mix((sums[:, begin + LENGTH] - sums[:, begin]) * powers(base, SPREAD)[begin]))
    return out, (r <= places[:, None]) & (r > places[:, None] - counts[:, None])


def common_windows(contexts: list[bytes], places: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For contexts sorted by group and aligned at their anchors: whether the window that begins r bytes
    before the anchor, for r from 0 to SPREAD - 1, is in another context of the group too.

    Columns are inserted from the last to the first, one symbol of each context a round. A round keeps the
    order of the suffixes that begin in its column (the rows of the collection's Burrows-Wheeler
    transform) and the common prefix of each with the one before it: both follow from those of the last
    round, by a stable sort on the new symbol and the least common prefix between neighbours that stay
    neighbours. A window is repeated if its suffix shares LENGTH bytes with a neighbour. Nothing is
    compared by hash, and memory is a byte for each symbol and two numbers for each context."""
    m, wide = len(contexts), SPREAD - 1 + LENGTH
    data = np.full((m, wide), 256, np.int16)  # 256: the context has no byte there, and shares none
    for row, c, p in zip(data, contexts, places, strict=True):
        row[SPREAD - 1 - p : SPREAD - 1 - p + len(c)] = np.frombuffer(c, np.uint8)
    columns = np.ascontiguousarray(data.T)
    out = np.zeros((m, SPREAD), bool)
    order, base, shared = np.arange(m), groups * 257, np.zeros(m + 1, np.int64)
    for c in range(wide - 1, -1, -1):
        symbol = columns[c][order]
        key = base[order] + symbol
        new = np.argsort(key, kind="stable")
        sorted_key = key[new]
        same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (symbol[new[1:]] != 256))
        after = np.zeros(m + 1, np.int64)
        if len(same):
            between = np.stack([new[same] + 1, new[same + 1] + 1], axis=1).ravel()
            after[same + 1] = 1 + np.minimum.reduceat(shared, between)[::2]
        order, shared = order[new], after
        if c < SPREAD:
            hit = np.flatnonzero(shared[:m] >= LENGTH)
            out[order[hit], SPREAD - 1 - c] = out[order[hit - 1], SPREAD - 1 - c] = True
    return out


_RANGE = "id long, text long, begin long, end long"


def _ranges(rows: list[tuple], again: np.ndarray) -> list[tuple]:
    """(id, text, begin, end) of the bytes under repeated windows, of contexts found once."""
    out = []
    for (_, n, _, i, t, first, place), mask in zip(rows, again, strict=True):
        if n == 1 and mask.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            # r falls as the window's start rises
            out += [(i, t, first + place - (b - 1), first + place - a + LENGTH) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts come sorted by cell; whole cells (of CROWD at most) are compared together."""
    held: list[tuple] = []
    names, kinds = ["id", "text", "begin", "end"], [pa.int64()] * 4

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            groups = np.cumsum([0, *(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False))])
            found = _ranges(rows, common_windows([r[2] for r in rows], np.array([r[6] for r in rows]), groups))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
            if len(held) >= TOGETHER_CONTEXTS and row[0] != held[-1][0]:
                yield from settle(held)
                held = []
            held.append(row)
    yield from settle(held)


#: A context or a part of one: its bytes, where they begin in the text, and how far from there the anchor is.
_CONTEXT = "cell long, n long, bytes binary, id long, text long, first int, place int"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
_CONTEXT_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _contexts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _CONTEXT_KINDS, strict=True)], _CONTEXT_NAMES)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of contexts whose windows begin lo to lo + RANGE - 1 bytes before the anchor, in the cell of the
    bytes that all these windows have. Cells that meet by chance are compared together and stay exact."""
    for batch in batches:
        rows = []
        for cell, n, raw, i, t, first, place in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
            least = place - (len(raw) - LENGTH)
            for lo in range(0, SPREAD, RANGE):
                a, b = max(lo, least), min(lo + RANGE - 1, place)
                if a <= b:
                    core = raw[place - lo : place - lo - RANGE + 1 + LENGTH]
                    key = xxhash.xxh64_intdigest(cell.to_bytes(8, "big", signed=True) + lo.to_bytes(2, "big") + core) - 2**63
                    rows.append((key, n, raw[place - b : place - a + LENGTH], i, t, first + place - b, b))
        yield from _contexts(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the contexts of crowded cells."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            contexts, places, first = part.column("bytes").to_pylist(), part.column("place").to_numpy(), part.column("first").to_numpy()
            hashes, has = window_hashes(contexts, places, np.array([len(c) - LENGTH + 1 for c in contexts]))
            row, r = np.nonzero(has)
            cols = [part.column(c).take(pa.array(row)) for c in ("cell", "n", "id", "text")]
            own = [pa.array(h[row, r].view(np.int64)) for h in hashes]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r, pa.int32()), *own, pa.array((first + places)[row] - r, pa.int64())], ["cell", "n", "id", "text", "r", "h", "h2", "begin"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, from the texts that hold them."""
    for batch in sliced(batches, "doc_text"):
        rows = []
        for raw, i, t, wanted in zip(raw_texts(batch, "doc_text"), *(batch.column(c).to_pylist() for c in ("id", "text", "wanted")), strict=True):
            rows += [(w["anchor"], w["n"], raw[w["first"] : w["last"] + LENGTH], i, t, w["first"], w["place"] - w["first"]) for w in wanted]
        yield from _contexts(rows)


def _crowded(contexts: DataFrame) -> DataFrame:
    return written(contexts.groupBy("cell").count().filter(F.col("count") > CROWD).select("cell"), "crowded")


def _compared(contexts: DataFrame, crowd: DataFrame) -> DataFrame:
    return contexts.join(crowd, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, _RANGE)


def _rims(contexts: DataFrame) -> DataFrame:
    """The repeated ranges of contexts whose cell is their anchor."""
    crowd = _crowded(contexts)
    out = _compared(contexts, crowd)
    if crowd.isEmpty():
        return out
    dealt = written(contexts.join(crowd, "cell").mapInArrow(_deal, _CONTEXT), "cells")
    crowd = _crowded(dealt)
    out = out.unionByName(_compared(dealt, crowd))
    if crowd.isEmpty():
        return out
    windows = dealt.join(crowd, "cell").mapInArrow(_windows, "cell long, n long, id long, text long, r int, h long, h2 long, begin long")
    key = ["cell", "r", "h", "h2"]
    shared = written(windows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(key), "shared-windows")
    many = windows.filter("n = 1").join(shared, key)
    return out.unionByName(many.select("id", "text", "begin", (F.col("begin") + LENGTH).alias("end")))


def _own_keys() -> list[Column]:
    """id and text_id: two hashes of a row's id and text, 128 bits. Rows that agree in both are the same text."""
    of = (F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return [F.xxhash64(*of).alias("id"), F.xxhash64(F.lit("second"), *of).alias("text_id")]


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(id, text, begin, end) from texts (id, text_id, text): bytes under repeated windows."""

    found = written(texts.mapInArrow(_anchors, _ANCHOR), "anchors")
    ranges = lambda df: df.select("id", "text", F.col("first").cast("long").alias("begin"), (F.col("last") + LENGTH).cast("long").alias("end"))
    local = ranges(found.filter("anchor IS NULL"))
    rows = found.filter("anchor IS NOT NULL")

    groups = rows.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("context").alias("least"), F.max("context").alias("most")).filter("total > 1")
    groups = written(groups.select("anchor", (F.col("least") != F.col("most")).alias("many")), "repeated-anchors")
    members = written(rows.join(groups, "anchor"), "members")
    alone = ranges(members.filter("NOT many"))

    # one of each context, with the number of all
    member = F.struct("id", "text", "first", "last", "place")
    kinds = members.filter("many").groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(member).alias("m")).select("anchor", "context", "n", "m.*")
    kinds = written(kinds, "contexts")
    twice = written(kinds.filter("n > 1").select("anchor", "context"), "repeated-contexts")
    often = ranges(members.filter("many").join(twice, ["anchor", "context"]))

    wanted = kinds.groupBy("id", "text").agg(F.collect_list(F.struct("anchor", "n", "first", "last", "place")).alias("wanted"))
    own = texts.select(F.col("id").alias("own_id"), F.col("text_id").alias("own_text"), F.col("text").alias("doc_text")).dropDuplicates(["own_id", "own_text"])
    cut = wanted.join(own, (F.col("id") == F.col("own_id")) & (F.col("text") == F.col("own_text"))).select("id", "text", "wanted", "doc_text")
    cut = written(cut.mapInArrow(_cut_contexts, _CONTEXT), "context-bytes")
    return local.unionByName(alone).unionByName(often).unionByName(_rims(cut))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for raw, ranges in zip(raw_texts(batch), batch.column("ranges").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for r in sorted((x["begin"], x["end"]) for x in ranges or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, at = [], 0
            for begin, end in merged:
                kept.append(raw[at:begin])
                at = end
            rows.append((len(raw), sum(e - b for b, e in merged), len(merged), b"".join([*kept, raw[at:]]), [x for m in merged for x in m]))
        n, removed, spans, kept, flat = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([len(k.translate(None, _NOT_START)) for k in kept], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "kept_chars", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), kept_sha256, kept_chars (first bytes of
    characters among them), spans (begin, end, ...)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_own_keys(), "text")
    found = repeated_ranges(texts.select("id", "text_id", "text")).distinct()
    ranges = found.groupBy(F.col("id").alias("range_id"), F.col("text").alias("range_text")).agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = texts.join(ranges, (F.col("id") == F.col("range_id")) & (F.col("text_id") == F.col("range_text")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, kept_chars long, spans array<long>")


def repeat_digest(docs: DataFrame) -> DataFrame:
    """The digest of remove_repeats(), with the bytes and the characters (first bytes of such) that stay."""
    kept = F.length("kept").cast("long")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept.alias("n_kept"), "kept_chars", (F.col("n_removed") > 0).alias("has_repeats"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM d)),
again AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
begun AS (SELECT doc_id, i, CASE WHEN i <= 400 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begun) GROUP BY doc_id, k),
ends AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, n + 1, n + 1 FROM d)),
kept AS (SELECT e.doc_id, count(*) - 1 AS n_spans, string_agg(CASE WHEN before + 1 < a THEN hex(b[before + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS x FROM ends e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, (n - strlen(x) / 2)::BIGINT AS n_removed, n_spans, sha256(unhex(x)) AS kept_sha256, (strlen(x) / 2)::BIGINT AS n_kept,
       len(list_filter(regexp_extract_all(x, '..'), lambda y: y < '80' OR y >= 'C0'))::BIGINT AS kept_chars, n > strlen(x) / 2 AS has_repeats
FROM d JOIN kept k ON k.doc_id = d.doc_id
"""
