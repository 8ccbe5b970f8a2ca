"""Phrase collocations by prefix-free parsing: phrases of two to LONGEST words that occur together oftener than their
parts would.

The parse. A text is a sequence of words, with a sign where a piece ends. A window of OVERLAP symbols whose hash
is a multiple of TRIGGER is a boundary, wherever it occurs, so repeated passages are cut alike. A chunk reaches from one
boundary to the end of the next one's window: chunks overlap by OVERLAP symbols, one less than the longest phrase.
Distinct chunks and how often each occurs are the dictionary, written once; texts aren't read again. A phrase is counted in
the chunk in which it begins before the closing window, so each occurrence counts once; a chunk's phrases count as often
as the chunk occurs. Stretches of MOST symbols without a boundary are cut, so that no row grows with its text.

The levels. Words are counted first. Of longer phrases only those are counted whose first and last part of one word less
can be frequent: a phrase isn't more frequent than its parts. Frequent parts are marked in a bit table of a
fixed size (FILTER_BITS), sent to the tasks; other phrases may share a bit, which costs work and changes no
result. Phrases are counted in numbers within a batch, by Spark's partial sums within a task, and shuffled then.

Scores are whole numbers, computed as decimals of 38 digits. The best of a language are picked in parts first, so that a
language that holds most candidates isn't sorted by one task.

A null text is empty, a null language is `und`. doc_id isn't read: repeated rows count as often as they stand there. Ties go by
score, count and phrase (in order of UTF-8 bytes), so ranks are unique. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.llm.common import raw_texts, sliced, small_batches, written

LONGEST, OVERLAP = 4, 3
#: One window in so many is a boundary; symbols without one before a cut.
TRIGGER, MOST = 16, 4096
#: Symbols that are parsed, and bytes of chunks that are counted, at once.
BATCH, COUNT_BYTES = 500_000, 8 << 20
FILTER_BITS, BLOCK_BITS = 1 << 26, 1 << 16
PARTS = 256
PIECE_END = "\n"

#: The byte for the end of a piece while texts are cut; no byte of UTF-8.
_END = 255
_TABLE = bytes(_END if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def symbols(raw: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case, with a sign for every end of a piece."""
    return raw.translate(_TABLE).replace(b"\xff", b" \xff ").split()


def hashed(words: pa.Array) -> np.ndarray:
    """64 bits of the UTF-8 bytes of each word: a polynomial of the bytes, mixed."""
    words = words.cast(pa.large_binary())
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1] if at else np.zeros(1, np.int64)
    size = np.diff(at)
    if not at[-1] - at[0]:
        return np.zeros(len(size), np.uint64)
    power = np.cumprod(np.full(int(size.max()), _ODD, np.uint64))
    term = np.frombuffer(data, np.uint8)[at[0] : at[-1]] + np.uint64(1)
    term *= power[np.arange(len(term)) - np.repeat(at[:-1] - at[0], size)]
    some = size > 0  # an empty word has no sum of its own
    out = np.zeros(len(size), np.uint64)
    out[some] = np.add.reduceat(term, (at[:-1] - at[0])[some])
    return mixed(out)


def mixed(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A hash of several hashes in order."""
    out = first * _MIX
    for h in more:
        out = (out ^ h) * _MIX
    return out ^ out >> np.uint64(32)


def boundaries(flat: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that end at `ends` of the flat symbols: at every text, and at every window that is a
    trigger and lies within its text, with cuts in between if these are far apart."""
    return _boundaries(pa.array(flat, pa.binary()).dictionary_encode(), ends)


def _boundaries(words: pa.DictionaryArray, ends: np.ndarray) -> np.ndarray:
    h = hashed(words.dictionary)[words.indices.to_numpy()]
    n = len(h) - OVERLAP + 1
    if n > 0:
        found = np.flatnonzero(mixed(*(h[i : n + i] for i in range(OVERLAP))) % np.uint64(TRIGGER) == 0)
        found = found[found + OVERLAP <= ends[np.searchsorted(ends, found, side="right")]]
    else:
        found = np.empty(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    at = np.unique(np.concatenate([found, starts[starts < ends]]).astype(np.int64))
    gaps = np.diff(np.append(at, len(words)))
    if len(gaps) and gaps.max() > MOST:
        more = np.concatenate([np.arange(a + MOST, a + g - OVERLAP, MOST) for a, g in zip(at[gaps > MOST], gaps[gaps > MOST], strict=True)])
        at = np.union1d(at, more)
    return at


def _parsed(flat: list[bytes], ends: list[int], langs: list[str]) -> pa.RecordBatch:
    """The distinct chunks of some texts: lang, chunk (symbols with spaces between), closed (whether a boundary ends it), how
    many words begin before its closing window, and n."""
    bounds = np.array(ends, np.int64)
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    at = _boundaries(coded, bounds)
    text = np.searchsorted(bounds, at, side="right")
    stop = bounds[text]
    follow = np.append(at[1:], len(flat))
    closed = follow < stop
    until = np.where(closed, follow + OVERLAP, stop)
    own = coded.indices.to_numpy()
    # a chunk is a slice of all symbols with spaces between; words that begin before its closing window are those up to the next chunk
    whole = b" ".join(flat).replace(b"\xff", PIECE_END.encode())
    place = np.concatenate([[0], np.cumsum(pc.binary_length(coded.dictionary).to_numpy()[own].astype(np.int64) + 1)])
    before = np.concatenate([[0], np.cumsum(pc.not_equal(coded.dictionary, b"\xff").to_numpy(zero_copy_only=False)[own])])
    words = before[np.where(closed, follow, stop)] - before[at]
    count = Counter((langs[t], whole[a:b], c, w) for t, a, b, c, w in zip(text.tolist(), place[at].tolist(), (place[until] - 1).tolist(), closed.tolist(), words.tolist(), strict=True))
    lang, chunk, shut, words = zip(*count, strict=True) if count else ((), (), (), ())
    texts = pa.array(chunk, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), texts, pa.array(shut, pa.bool_()), pa.array(words, pa.int64()), pa.array(count.values(), pa.int64())], ["lang", "chunk", "closed", "words", "n"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flat, ends, langs = [], [], []
    for batch in sliced(batches):
        for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch), strict=True):
            own = symbols(raw)
            if own:
                flat += own
                ends.append(len(flat))
                langs.append("und" if lang is None else lang)
            if len(flat) >= BATCH:
                yield _parsed(flat, ends, langs)
                flat, ends, langs = [], [], []
    if flat:
        yield _parsed(flat, ends, langs)


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary (lang, chunk, closed, words, n) of docs (text, lang): distinct chunks and how often they occur."""
    small_batches(docs.sparkSession)
    rows = docs.select("lang", "text").mapInArrow(_chunks, "lang string, chunk string, closed boolean, words long, n long")
    return rows.groupBy("lang", "chunk", "closed").agg(F.first("words").alias("words"), F.sum("n").alias("n"))


class _Flat:
    """The symbols of some chunks as numbers, one after the other."""

    def __init__(self, batch: pa.RecordBatch):
        cut = pc.split_pattern(batch.column("chunk"), " ")
        words = cut.flatten().dictionary_encode()
        size = np.diff(cut.offsets.to_numpy())
        langs = batch.column("lang").dictionary_encode()
        own = words.indices.to_numpy().astype(np.int64)
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
        # a word of two languages is two words
        key, most = lang * len(words.dictionary) + own, len(langs.dictionary) * len(words.dictionary)
        if most <= 4 * len(key):  # a table of all pairs of a language and a word
            there = np.zeros(most, bool)
            there[key] = True
            self.id, self.key = (np.cumsum(there) - 1)[key], np.flatnonzero(there)
        else:
            self.id, self.key = pd.factorize(key)
        self.words, self.langs = words.dictionary.take(pa.array(self.key % len(words.dictionary))), langs.dictionary.take(pa.array(self.key // len(words.dictionary)))
        self.n = np.repeat(batch.column("n").to_numpy(), size)
        end = np.repeat(np.cumsum(size), size)
        at = np.arange(len(own))
        self.left = end - at  # symbols from here to the end of the chunk
        self.core = self.left > np.repeat(np.where(batch.column("closed").to_numpy(zero_copy_only=False), OVERLAP, 0), size)
        sign = words.dictionary.index(PIECE_END).as_py()
        self.word = own != sign
        self.coded = langs.dictionary, words.dictionary

    def hash(self) -> np.ndarray:
        """A hash of each word with its language."""
        langs, words = map(hashed, self.coded)
        return mixed(langs[self.key // len(words)], words[self.key % len(words)])[self.id]

    def texts(self, ids: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
        """(languages, phrases) of k words that begin at these places of the flat symbols."""
        parts = [self.words.take(pa.array(self.id[ids + i])) for i in range(k)]
        return self.langs.take(pa.array(self.id[ids])), pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]

    def distinct(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct phrase of k words that begins at one of these, for each place the number of its phrase)."""
        key, most = self.id[places], len(self.key)
        for i in range(1, k):
            if most * len(self.key) >= 1 << 63:  # as many words as fit are numbered at once
                key, found = pd.factorize(key)
                most = len(found)
            key, most = key * len(self.key) + self.id[places + i], most * len(self.key)
        if k > 1:
            key = pd.factorize(key)[0]
        one = np.full(int(key.max(initial=-1)) + 1, -1)
        one[key] = places
        if k == 1:  # words that begin at none of the places have none
            here = one >= 0
            one, key = one[here], (np.cumsum(here) - 1)[key]
        return one, key


def bits_of(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The bits of phrases of one length; as _counted() takes them from the hashes of words."""
    lang = langs.dictionary_encode()
    h = hashed(lang.dictionary)[lang.indices.to_numpy()]
    cut = pc.split_pattern(phrases, " ").flatten().dictionary_encode()
    own = hashed(cut.dictionary)[cut.indices.to_numpy()].reshape(len(phrases), -1)
    return mixed(*(mixed(h, own[:, i]) for i in range(own.shape[1]))) % np.uint64(FILTER_BITS)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have COUNT_BYTES: the more chunks are counted at once, the fewer phrases are repeated."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= COUNT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _counted(batches: Iterator[pa.RecordBatch], k: int, sent) -> Iterator[pa.RecordBatch]:
    """The phrases of k words in distinct chunks, with how often they begin there, where both parts of k - 1 words have
    their bit."""
    for batch in gathered(batches):
        if not batch.num_rows:
            continue
        flat = _Flat(batch)
        may = flat.word.copy()  # where a phrase of k - 1 words can begin that may be frequent
        if k > 1:
            table = sent.value
            for i in range(1, k - 1):
                may[:-i] &= flat.word[i:]
                may[-i:] = False
            may &= flat.left >= k - 1
            places = np.flatnonzero(may)
            h = flat.hash()
            bit = mixed(*(h[places + i] for i in range(k - 1))) % np.uint64(FILTER_BITS)
            may[places] = (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            both = may.copy()
            both[:-1] &= may[1:]
            both[-1:] = False
            may = both & (flat.left >= k)
        places = np.flatnonzero(may & flat.core)
        if not len(places):
            continue
        one, which = flat.distinct(places, k)
        total = np.zeros(len(one), np.int64)
        np.add.at(total, which, flat.n[places])
        lang, phrase = flat.texts(one, k)
        yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(total)], ["lang", "phrase", "n"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        bit = np.unique(bits_of(batch.column("lang"), batch.column("phrase"))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bit // BLOCK_BITS), pa.array(bit % BLOCK_BITS)], ["block", "bit"])


def _packed(table: pa.Table) -> pa.Table:
    bits = np.zeros(BLOCK_BITS, np.uint8)
    bits[table.column("bit").to_numpy()] = 1
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def marks(frequent: DataFrame) -> np.ndarray:
    """The bit table of phrases: FILTER_BITS / 8 bytes, however many there are."""
    bits = frequent.select("lang", "phrase").mapInArrow(_marked, "block long, bit long").distinct()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    size = BLOCK_BITS // 8
    for r in bits.groupBy("block").applyInArrow(_packed, "block long, bits binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def phrase_counts(chunks: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, k, f) of the phrases of up to `longest` words that occur at least `least` times, from a dictionary."""
    spark, out, sent = chunks.sparkSession, None, None
    for k in range(1, longest + 1):
        rows = chunks.mapInArrow(lambda it, k=k, sent=sent: _counted(it, k, sent), "lang string, phrase string, n long")
        found = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found = written(found.select("lang", "phrase", F.lit(k).alias("k"), "f"), f"phrases-{k}")
        if sent is not None:
            sent.destroy()
        out = found if out is None else out.unionByName(found)
        sent = spark.sparkContext.broadcast(marks(found)) if k < longest else None
    return out


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of two words and more: those of the cut with the lowest score, of ties
    that after the fewest words."""
    f = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = frequent.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    sides = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(j.alias("j"), F.array_join(F.slice("ws", F.lit(1), j), " ").alias("head"), F.array_join(F.slice("ws", j + 1, F.col("k") - j), " ").alias("tail")))
    cut = cut.select("lang", "phrase", "k", "a", F.inline(sides))
    both = cut.join(f("head", "l"), ["lang", "head"]).join(f("tail", "r"), ["lang", "tail"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = both.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")


def not_within(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Candidates but those inside a longer one that has at least `share` percent of their count."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))))
    longer = candidates.filter("k > 2").select("lang", "a", "k", F.split("phrase", " ").alias("ws")).select("lang", "a", F.explode(inner).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    big = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n)
    return candidates.join(most, ["lang", "phrase"], "left").filter(F.col("_most").isNull() | (big("_most", 100) < big("a", share))).drop("_most")


def best_of(candidates: DataFrame, most: int) -> DataFrame:
    """The first `most` candidates of each language, with rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = candidates.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = part.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_r") <= most).drop("_r", "_part")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each language, best first. a is the count of the phrase, l and
    r those of its two parts, n that of all words of the language."""
    chunks = written(parse(docs), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n"))
    candidates = written(scored(phrase_counts(chunks, least)), "candidates")
    return best_of(not_within(candidates, share), most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
cut AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM cut),
grams AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM starts) WHERE i + k - 1 <= len(ws)),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM cand),
sides AS (SELECT *, array_to_string(list_slice(ws, 1, j), ' ') AS head, array_to_string(list_slice(ws, j + 1, k), ' ') AS tail FROM cuts),
scores AS (SELECT s.lang, s.k, s.phrase, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score FROM sides s
    JOIN counts x ON x.lang = s.lang AND x.phrase = head JOIN counts y ON y.lang = s.lang AND y.phrase = tail),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (SELECT lang, a, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
