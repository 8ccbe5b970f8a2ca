"""Benchmark decontamination by a positional inverted index of the corpus.

The corpus is cut into shards. Of each shard the index stores one row: its documents, and for every
term that the benchmark uses the sorted list of its token positions. A search reads only that table.
For each window of a benchmark item it takes the posting list of the window's rarest term over the
whole corpus, shifts it by the term's offset to get possible starts, and intersects these with the
shifted lists of the window's other terms, rarest first. What is left are exact phrase matches; starts
whose rarest term stands at its place and whose second and third rarest lie within `slop` words of theirs,
in the same document, are proximity matches. Nothing is shuffled but one count for each term, so no source,
passage or term makes a task larger than others.

What is broadcast is bounded: the words of INDEX_BYTES of benchmark text at a time for building an index (a
dictionary of at most about sixteen times that, if no word comes twice), and the windows of BLOCK_BYTES of text (at
most about fifteen times that as arrays) for a search of it. A larger
benchmark takes several searches of one index, and beyond INDEX_BYTES several indexes; results meet by a key
that each row of the corpus has. Equal rows of the benchmark are one, a long item is cut into ranges of words that overlap
by a window less one, and blocks are filled by bytes: none has more than BLOCK_BYTES and one such range. Broadcasts of
earlier blocks are dropped.

Defined results: null and empty texts have no words and are never hit. Items without words have no
window. Rows with a null doc_id are documents like others; a repeated doc_id gives a row each time.
Repeated items count once by item_id; a null item_id reads as an empty string. An empty table gives no rows, an
empty benchmark no hits. Terms of equal frequency are taken in their order in the window. Other columns are
ignored, and pass through in decontaminate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.llm.common import id_key, raw_texts, sliced, small_batches, text_key, without_rows, written

WINDOW = 13
#: Bytes of benchmark text that are searched for at once, and that an index has the terms of.
BLOCK_BYTES, INDEX_BYTES = 4 << 20, 16 << 20
#: Tokens in a shard (a longer document is a shard of its own) and candidates looked at together.
SHARD_TOKENS, CANDIDATES = 1_000_000, 400_000

#: Bytes to lower case; all that is not a letter, a digit or part of a non-ASCII character to a space.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

INDEX = "row_keys array<bigint>, doc_ids array<bigint>, hashes array<binary>, n_words array<bigint>, terms array<int>, counts array<int>, positions array<int>"
FOUND = "row_key long, doc_id long, text_hash binary, n_words long, hits array<struct<begin: bigint, end: bigint>>, items array<string>, near_items array<string>"


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Windows:
    """The distinct windows of a block of items, as arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, vocabulary: dict[bytes, int]):
        """vocabulary: numbers of words; those of the items that it lacks are added."""
        self.window, self.names = window, sorted({item for item, _ in items})
        number, rows, lengths, of = {x: i for i, x in enumerate(self.names)}, [], [], []
        for item, raw in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(raw)], np.int32)
            if not len(ids):
                continue
            if len(ids) < window:
                own = np.concatenate([ids, np.full(window - len(ids), -1, np.int32)])[None]
            else:
                own = np.lib.stride_tricks.sliding_window_view(ids, window)
            rows.append(own)
            lengths.append(np.full(len(own), min(len(ids), window), np.int8))
            of.append(np.full(len(own), number[item], np.int32))
        term = np.ascontiguousarray(np.concatenate(rows)) if rows else np.empty((0, window), np.int32)
        packed = term.view(np.dtype((np.void, 4 * window))).ravel()
        _, first, group = np.unique(packed, return_index=True, return_inverse=True)
        self.term, self.length = term[first], np.concatenate([*lengths, np.empty(0, np.int8)])[first]
        pairs = np.unique(np.stack([group.ravel().astype(np.int64), np.concatenate([*of, np.empty(0, np.int32)]).astype(np.int64)]), axis=1)
        #: The items of window i are item[item_at[i] : item_at[i + 1]], as places in names.
        self.item, self.item_at = pairs[1].astype(np.int32), np.searchsorted(pairs[0], np.arange(len(first) + 1)).astype(np.int32)

    def order(self, n: np.ndarray) -> None:
        """Rarest terms first; n: the tokens of each term in the whole corpus."""
        counts = np.concatenate([n, [2**62]])
        self.offset = np.argsort(counts[self.term], axis=1, kind="stable").astype(np.int8)  # -1 is the last and most frequent
        first = np.take_along_axis(self.term, self.offset[:, :1].astype(np.int64), 1)[:, 0]
        self.by_first = np.argsort(first, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(first[self.by_first], np.arange(len(n) + 1)).astype(np.int32)

    def size(self) -> int:
        """Bytes of the arrays."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def items_of(self, windows: list[int]) -> set[str]:
        return {self.names[i] for w in windows for i in self.item[self.item_at[w] : self.item_at[w + 1]].tolist()}


def _shards(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    get = {w: i for i, w in enumerate(sent.value.split(b" "))}.get

    def row(keys: list, ids: list, hashes: list, lengths: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        t = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
        at = np.flatnonzero(t >= 0).astype(np.int32)
        at = at[np.argsort(t[at], kind="stable")]
        terms, counts = np.unique(t[at], return_counts=True)
        kinds = (("row_keys", keys, pa.int64()), ("doc_ids", ids, pa.int64()), ("hashes", hashes, pa.binary()), ("n_words", lengths, pa.int64()), ("terms", terms, pa.int32()), ("counts", counts, pa.int32()), ("positions", at, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for _, x, k in kinds], [n for n, _, _ in kinds])

    for batch in sliced(batches):
        keys, ids, hashes, lengths, tokens, held = [], [], [], [], [], 0
        for key, doc_id, text_hash, raw in zip(*(batch.column(c).to_pylist() for c in ("row_key", "doc_id", "text_hash")), raw_texts(batch), strict=True):
            found = words(raw)
            if held and held + len(found) > SHARD_TOKENS:
                yield row(keys, ids, hashes, lengths, tokens)
                keys, ids, hashes, lengths, tokens, held = [], [], [], [], [], 0
            keys.append(key)
            ids.append(doc_id)
            hashes.append(text_hash)
            lengths.append(len(found))
            tokens.append(np.fromiter((get(w, -1) for w in found), np.int32, len(found)))
            held += len(found)
        if ids:
            yield row(keys, ids, hashes, lengths, tokens)


class Shard:
    """A row of the index, searched."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.lengths, self.ends = n_words, np.cumsum(n_words)
        self.size = int(self.ends[-1]) if len(n_words) else 0
        self.terms, self.counts, self.positions = terms.astype(np.int64), counts.astype(np.int64), positions.astype(np.int64)
        self.lists = np.concatenate([[0], np.cumsum(self.counts)])
        #: Every posting as one number, in order: a list is a range of it.
        self.keys = np.repeat(self.terms, self.counts) * (self.size + 1) + self.positions

    def runs(self, on: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
        """For each document its runs of positions that are on, counted from its start."""
        first = np.zeros(self.size + 1, bool)
        first[self.ends[lengths > 0] - lengths[lengths > 0]] = True
        first[-1] = True
        begin = np.flatnonzero(on & (first[:-1] | ~np.concatenate([[False], on[:-1]])[: len(on)]))
        end = np.flatnonzero(on & (first[1:] | ~np.concatenate([on[1:], [False]])[: len(on)])) + 1
        doc = np.searchsorted(self.ends, begin, side="right")
        before = self.ends[doc] - lengths[doc] if len(doc) else np.empty(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(begin - before, pa.int64()), pa.array(end - before, pa.int64())], ["begin", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(lengths) + 1)), pa.int32()), pairs)

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the list of the term holds the position."""
        key = term * (self.size + 1) + at
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[i] == key

    def within(self, term: np.ndarray, at: np.ndarray, slop: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the list of the term holds a position at most slop away, of those from begin to end."""
        least, most = np.maximum(at - slop, begin), np.minimum(at + slop, end - 1)
        key = term * (self.size + 1)
        i = np.minimum(np.searchsorted(self.keys, key + least), len(self.keys) - 1)
        return (self.keys[i] >= key + least) & (self.keys[i] <= key + most)

    def candidates(self, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) from the postings of every window's rarest term, in pieces."""
        for term, n, lo in zip(self.terms, self.counts, self.lists, strict=False):
            of = w.by_first[w.starts[term] : w.starts[term + 1]]
            if not len(of):
                continue
            step = max(1, CANDIDATES // len(of))
            for i in range(lo, lo + n, step):
                at = self.positions[i : min(i + step, lo + n)]
                yield np.tile(of, len(at)), np.repeat(at, len(of)) - np.tile(w.offset[of, 0].astype(np.int64), len(at))

    def search(self, w: Windows, slop: int) -> tuple[list, list]:
        """Exact and proximity matches as (window, start)."""
        exact, near, held = [], [], []
        waiting = 0

        def intersect(win: np.ndarray, start: np.ndarray) -> None:
            doc = np.minimum(np.searchsorted(self.ends, start, side="right"), len(self.ends) - 1)
            end = self.ends[doc]
            begin = end - self.lengths[doc]
            fits = (start >= 0) & (start + w.length[win] <= end)
            close = np.full(len(win), slop > 0)
            alive = fits.copy()
            for k in range(1, w.window):
                off = w.offset[win, k].astype(np.int64)
                term = w.term[win, off].astype(np.int64)
                if k <= 2 and slop:
                    close &= (w.length[win] > k) & ((term >= 0) & self.within(np.maximum(term, 0), start + off, slop, begin, end))
                todo = np.flatnonzero(alive & (k < w.length[win]))
                if not len(todo) and (k > 2 or not slop):
                    break
                alive[todo] = self.has(term[todo], start[todo] + off[todo])
                if k == 2 and slop:  # an exact match is one of these too; its items are left out in the end
                    near.append((win[close & fits], start[close & fits]))
                if k >= 2:  # few are left
                    win, start, begin, end, fits, close, alive = (x[alive] for x in (win, start, begin, end, fits, close, alive))
            exact.append((win[alive], start[alive]))

        for win, start in self.candidates(w):
            held.append((win, start))
            waiting += len(win)
            if waiting >= CANDIDATES // 4:
                intersect(*map(np.concatenate, zip(*held, strict=True)))
                held, waiting = [], 0
        if held:
            intersect(*map(np.concatenate, zip(*held, strict=True)))
        return exact, near


def _search(batches: Iterator[pa.RecordBatch], sent: Broadcast, slop: int) -> Iterator[pa.RecordBatch]:
    w: Windows = sent.value
    names = ["row_key", "doc_id", "text_hash", "n_words", "hits", "items", "near_items"]
    for batch in batches:
        for i in range(batch.num_rows):
            keys, ids, hashes, n_words, terms, counts, positions = (batch.column(c)[i].values for c in ("row_keys", "doc_ids", "hashes", "n_words", "terms", "counts", "positions"))
            lengths = n_words.to_numpy(zero_copy_only=False)
            shard = Shard(lengths, *(x.to_numpy(zero_copy_only=False) for x in (terms, counts, positions)))
            exact, near = shard.search(w, slop) if len(terms) else ([], [])
            cover = np.zeros(shard.size + 1, np.int64)
            items: list[list[set[str]]] = [[set() for _ in lengths] for _ in range(2)]
            for kind, found in enumerate((exact, near)):
                for win, start in found:
                    if not kind:
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + w.length[win], -1)
                    pairs = np.unique(np.stack([np.searchsorted(shard.ends, start, side="right"), win]), axis=1)
                    for doc in np.unique(pairs[0]).tolist():
                        items[kind][doc] |= w.items_of(pairs[1][pairs[0] == doc].tolist())
            lists = (pa.array([sorted(x) for x in part], pa.list_(pa.string())) for part in (items[0], [b - a for a, b in zip(*items, strict=True)]))
            yield pa.RecordBatch.from_arrays([keys, ids, hashes, n_words, shard.runs(np.cumsum(cover[:-1]) > 0, lengths), *lists], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text_hash, text. Keys tell rows apart; they stay the same only once they are written."""
    return docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), "text")


def build_index(keyed: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The stored index of the corpus for the terms of a benchmark, numbered from 0 in order."""
    sent = keyed.sparkSession.sparkContext.broadcast(b" ".join(vocabulary))
    index = written(keyed.mapInArrow(lambda it: _shards(it, sent), INDEX), "postings")
    sent.destroy()
    return index


def _term_counts(index: DataFrame, n: int) -> np.ndarray:
    """The tokens of each of n terms; a number for each word of INDEX_BYTES at most comes to the driver."""
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n")).toArrow()
    out = np.zeros(n, np.int64)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out


def _ranges(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items of more than `most` bytes as ranges of their words, of about so many bytes, each with the words that a window that
    begins in it reaches; so every window of an item is in one of them."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = words(text.encode()) if len(text) > most // 4 and len(text.encode()) > most else []
            if len(own) <= window:
                rows.append((item, text))
                continue
            begin, held = 0, 0
            for i in range(len(own) - window + 1):
                held += len(own[i]) + 1
                if held >= most or i == len(own) - window:
                    rows.append((item, b" ".join(own[begin : i + window]).decode("utf-8", "replace")))
                    begin, held = i + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["item", "text"])


def _items(items: DataFrame, window: int) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """item, text and the block (two numbers) of each distinct row; the blocks, and how many of them share an index. Rows are
    dealt to as many groups as their bytes need, and a group's rows to blocks in order, until each is full."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    most, full = max(1, BLOCK_BYTES // 8), BLOCK_BYTES  # as they are now; the tasks import these anew
    rows = rows.mapInArrow(lambda it: _ranges(it, window, most), "item string, text string")
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // full) or 1
    if n == 1:
        return rows.select("item", "text", F.lit(0).alias("group"), F.lit(0).alias("part")), [(0, 0)], 1
    before = F.coalesce(F.sum(F.octet_length("text")).over(W.partitionBy("group").orderBy("h", "item", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = rows.withColumn("h", F.xxhash64("item", "text")).withColumn("group", F.pmod("h", F.lit(n)).cast("int"))
    dealt = dealt.withColumn("part", F.floor(before / full).cast("int")).drop("h")
    # written in order, so that each block is read from its own part of the table
    dealt = written(dealt.repartitionByRange("group", "part").sortWithinPartitions("group", "part"), "benchmark")
    blocks = sorted((r.group, r.part) for r in dealt.select("group", "part").distinct().collect())  # two numbers for each block
    return dealt, blocks, max(1, INDEX_BYTES // full)


def _texts(rows: DataFrame, block: tuple[int, int]) -> list[tuple[str, bytes]]:
    own = rows.filter((F.col("group") == block[0]) & (F.col("part") == block[1]))
    return [(r.item, r.text.encode()) for r in own.select("item", "text").toLocalIterator()]


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """doc_id, text_hash, n_words, hits, items, near_items: for each document the runs of words under any exact
    occurrence of a benchmark window, the items with such, and those with a proximity match only."""
    if not 0 < window < 128:
        raise ValueError("windows have 1 to 127 words")
    small_batches(docs.sparkSession)
    rows, all_blocks, together = _items(items, window)
    n = len(all_blocks)
    keyed = _keyed(docs) if n <= together else written(_keyed(docs), "keyed-texts")
    parts = []
    for begin in range(0, n, together):
        vocabulary: dict[bytes, int] = {}
        blocks = all_blocks[begin : begin + together]
        for b in blocks:
            for _, raw in _texts(rows, b):
                for x in words(raw):
                    vocabulary.setdefault(x, len(vocabulary))
        index = build_index(keyed, vocabulary)
        counts = _term_counts(index, len(vocabulary))
        for b in blocks:
            w = Windows(_texts(rows, b), window, vocabulary)
            w.order(counts)
            sent = docs.sparkSession.sparkContext.broadcast(w)
            found = index.mapInArrow(lambda it, sent=sent: _search(it, sent, slop), FOUND)
            if n == 1:
                return found.drop("row_key")
            # a row for each document; of the other blocks, rows with matches
            parts.append(written(found if not parts else found.filter((F.size("hits") > 0) | (F.size("near_items") > 0)), "matches"))
            sent.destroy()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  a list for each block
    near = F.array_except("near_items", "items").alias("near_items")  # an item's windows are in one block, but its name can be in several
    same = (F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words"))
    return out.groupBy("row_key").agg(*same, *(union(c).alias(c) for c in ("hits", "items", "near_items"))).select("doc_id", "text_hash", "n_words", "hits", "items", near)


def _covered(hits: Column) -> Column:
    """Words under runs that are sorted by their begin and may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["begin"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(hits, start, step)["n"]


def _judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_matches(docs, items).withColumn("n_hit", _covered(F.col("hits")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of find_matches() with the verdict: a hit, and hits at least a twentieth of the words."""
    return _judged(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated; all columns stay. A row goes by its own text, whatever shares its id."""
    bad = _judged(docs, items).filter("contaminated").select(id_key().alias("id"), F.col("text_hash").alias("hash")).distinct()
    return without_rows(docs, written(bad, "contaminated"), {"id": id_key(), "hash": text_key()})


def _words_sql(table: str, columns: str) -> str:
    return rf"SELECT {columns}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table}"


ORACLE_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}),
b AS ({_words_sql("benchmark", "item_id::VARCHAR AS item")}),
win AS (
    SELECT DISTINCT item, l, ws[i:i + l - 1] AS w, array_to_string(ws[i:i + l - 1], ' ') AS k
    FROM (SELECT item, ws, least(len(ws), {WINDOW}) AS l, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
),
found AS (
    SELECT doc_id, i, x.l, item
    FROM (SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win))) x
    JOIN win ON x.l = win.l AND x.k = win.k
),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
tok AS (SELECT doc_id, p, len(ws) AS n, ws[p] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
often AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
ranked AS (
    SELECT item, k, l, o, x.t, row_number() OVER (PARTITION BY item, k ORDER BY coalesce(often.n, 0), o) AS r
    FROM (SELECT item, k, l, o, w[o + 1] AS t FROM (SELECT item, k, l, w, unnest(range(0, l)) AS o FROM win WHERE l >= 3)) x LEFT JOIN often ON often.t = x.t
),
starts AS (
    SELECT a.item, a.k, a.l, doc_id, p - a.o AS s FROM ranked a JOIN tok ON tok.t = a.t WHERE r = 1 AND p - a.o >= 1 AND p - a.o + a.l - 1 <= tok.n
),
second AS (SELECT DISTINCT s.item, s.k, s.doc_id, s.s FROM starts s JOIN ranked x ON x.item = s.item AND x.k = s.k AND x.r = 2 JOIN tok ON tok.doc_id = s.doc_id AND tok.t = x.t AND abs(tok.p - s.s - x.o) <= 2),
third AS (SELECT DISTINCT s.item, s.doc_id FROM second s JOIN ranked x ON x.item = s.item AND x.k = s.k AND x.r = 3 JOIN tok ON tok.doc_id = s.doc_id AND tok.t = x.t AND abs(tok.p - s.s - x.o) <= 2),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, item FROM third EXCEPT SELECT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN near n ON n.doc_id = d.doc_id
"""
