"""Token counts: the exact number of tokens of every prefix of a text, stored once and asked often.

A byte-level BPE model makes exactly one token the last of every byte prefix of a word: the one that forms a
valid pair with the last token of the prefix before it (two tokens are a valid pair if merging their joined bytes
gives them back). So the number of tokens of a prefix is one more than that of the prefix its last token
begins at: a dynamic program over byte positions, that looks back by the longest token at most.

Texts are cut into units, whose prefix counts don't depend on what is around them: a word with the white
space before it. The white space of a prefix that ends in it is one word, that of a longer prefix gives its last
sign to the next word; a unit's counts say both. `steps` has, for every code point of a text, by how much it
changes the count, so that their running sum is the count at every prefix:

    tokens(text[:n]) = base + sum(steps[: n - start])

A special token inside a text is one token, as in the library; a prefix that ends inside it is plain text.

prefix_counts() gives blocks of BLOCK code points, so that no row grows with its text. tokens_at() (how many
tokens has a prefix), longest_prefixes() (how much fits a budget) and truncated() answer from such a table and
never encode again. Counts of a prefix may fall as it grows; the longest prefix of a budget is exact all the same.

A null text is empty and has a block without steps. Rows that share a doc_id, null ids among them, have keys of their
own (`row`). Extra columns are left out of the table. The model file is a parameter; the driver reads it (MAX_MODEL_BYTES
at most). Models that would be counted otherwise than by the library are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import raw_texts, sliced, small_batches, written

MAX_MODEL_BYTES = 64 << 20
#: Code points of a block, and of the blocks that are handed to Spark at once.
BLOCK, BATCH = 8192, 1 << 20
#: Units kept in the newer part of the cache (the older has as many), and pairs whose validity is known.
CACHE, PAIRS = 400_000, 500_000
#: Beginnings of so many bytes are kept with their nodes, STEMS of them.
STEM, STEMS = 6, 100_000
#: Units of more bytes are counted anew each time, in parts of so many bytes.
LONG = 256

# The forms of words in this kind of model, first one first.
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
LETTERS, NUMBERS, OTHERS = r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"

#: A word with a space at most, or white space with the word that follows it.
UNIT = regex.compile(rf"{CONTRACTION}| ?{LETTERS}| ?{NUMBERS}| ?{OTHERS}|\s+(?:(?<! ){CONTRACTION}|{LETTERS}|{NUMBERS}|{OTHERS})?")
_SPACES, _SHORT = regex.compile(r"\s+"), regex.compile(rf"\s*{CONTRACTION}")

FIELDS = "row long, doc_id long, block int, start long, base long, steps array<int>, n_tokens long, n_bytes long, last boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in this kind of model file: printable Latin-1 signs stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refusal(model: dict) -> str | None:
    """Why a tokenizer's file can't be counted here."""
    kind, cut = model.get("model") or {}, model.get("pre_tokenizer") or {}
    if kind.get("type") != "BPE" or any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return "it isn't a plain BPE model"
    if model.get("normalizer") or model.get("truncation"):
        return "it changes or cuts texts"
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return "it cuts texts into other words"
    if any(t.get(k) for t in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return "its special tokens take more than their own signs"
    return None


def at_ends(data: bytes, counts: list[int]) -> list[int]:
    """Of the counts of all bytes those at the ends of code points."""
    return [n for n, after in zip(counts, data[1:] + b"\0", strict=True) if after & 0xC0 != 0x80]


def steps_of(counts: list[int]) -> bytes:
    return array("i", map(sub, counts, [0, *counts])).tobytes()


class Counter:
    """The tokens of a model, and the prefix counts of units."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)
        if why := refusal(model):
            raise ValueError(f"this model can't be used: {why}")
        byte = letters_of_bytes()
        as_bytes = lambda word: bytes(byte[c] for c in word)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in reversed([*enumerate(merges)])}
        special = [t["content"] for t in model.get("added_tokens", [])]
        #: Single bytes, and what a merge makes.
        self.tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in self.rank if len(a + b) > 1]
        self.id = {t: i for i, t in enumerate(self.tokens)}
        self.longest = max(map(len, self.tokens))
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: Whether each merge comes after those that make its two tokens, as in trained models.
        made = {a + b: r for (a, b), r in reversed(self.rank.items())}
        self.ordered = len(made) == len(self.rank) and all(max(made.get(a, -1), made.get(b, -1)) < r for (a, b), r in self.rank.items())
        self.parts = {a + b: (a, b, r) for (a, b), r in reversed(self.rank.items())}
        self.rims: dict[bytes, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.ending: dict[bytes, set[int]] = {}
        for t in self.tokens:
            self.ending.setdefault(t[-3:], set()).add(len(t))
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stems: dict[bytes, tuple[list[int], list[int]]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes by the merges themselves: the earliest merge first, then leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def rim(self, token: bytes) -> tuple[list, list]:
        """What stands at the left and at the right end of a token while it is merged, from a byte on: (token, rank of the
        merge that takes it in)."""
        left, right, end = [(token, len(self.rank))], [(token, len(self.rank))], token
        while len(end) > 1:
            end, _, rank = self.parts[end]
            left.append((end, rank))
        end = token
        while len(end) > 1:
            _, end, rank = self.parts[end]
            right.append((end, rank))
        self.rims[token] = left[::-1], right[::-1]
        return self.rims[token]

    def separate(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the border of two tokens: their own merges, in order of rank, must come before any
        that takes both of their ends. Of equal merges the left one comes first."""
        rank, a, b, i, j = self.rank, (self.rims.get(left) or self.rim(left))[1], (self.rims.get(right) or self.rim(right))[0], 0, 0
        while True:
            (x, next_a), (y, next_b) = a[i], b[j]
            cross = rank.get((x, y))
            if cross is not None and cross < next_a and cross <= next_b:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def valid(self, pair: int) -> bool:
        """Whether merging the bytes of two tokens gives them back."""
        left, right = self.tokens[pair >> 24], self.tokens[pair & 0xFFFFFF]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = found = self.separate(left, right) if self.ordered else self.merged(left + right) == [left, right]
        return found

    def lengths_of(self, tail: bytes) -> tuple[int, ...]:
        """Lengths that a token ending with these bytes can have, longest first."""
        own = {1}.union(*(self.ending.get(tail[-k:], ()) for k in range(1, len(tail) + 1)))
        self.lengths[tail] = found = tuple(sorted(own, reverse=True))
        return found

    def extend(self, data: bytes, ids: list[int], counts: list[int]) -> None:
        """Add the nodes of `data` to those of its beginning: data[:i] ends with the token ids[i] and has counts[i]
        tokens. ids[0] is the token before data, or -1 where a word begins."""
        known, lengths, pairs = self.id, self.lengths, self.pairs
        for i in range(len(ids), len(data) + 1):
            tail = data[i - 3 : i] if i > 2 else data[:i]
            for n in lengths.get(tail) or self.lengths_of(tail):
                if n > i:
                    continue
                own = known.get(data[i - n : i])
                if own is None:
                    continue
                before = ids[i - n]
                if before < 0:
                    break
                pair = before << 24 | own
                ok = pairs.get(pair)
                if ok or (ok is None and self.valid(pair)):
                    break
            else:
                raise ValueError(f"no path to {i} of {data!r}")
            ids.append(own)
            counts.append(counts[i - n] + 1)

    def counts(self, word: str) -> list[int]:
        """The tokens of every prefix of a word, by code points. Of a long word, nodes are kept for the longest
        token only."""
        data = word.encode("utf-8", "replace")
        base, ids, counts, out = 0, [-1], [0], []
        for end in range(LONG, len(data) + LONG, LONG):
            had = len(ids)
            self.extend(data[base:end], ids, counts)
            out += counts[had:]
            base, ids, counts = base + max(0, len(ids) - 1 - self.longest), ids[-self.longest - 1 :], counts[-self.longest - 1 :]
        return out if len(data) == len(word) else at_ends(data, out)

    def words(self, unit: str) -> list[int]:
        """The tokens of every prefix of a unit."""
        space = _SPACES.match(unit)
        n = space.end() if space else 0
        if n == len(unit):
            return self.counts(unit)
        taken = n - 1 if n and unit[n - 1] == " " else n  # a space belongs to the word
        word, out, before = unit[taken:], [], 0
        if n:
            out = self.counts(unit[:n])
            before = out[taken - 1] if taken else 0
            if taken == n > 1:  # in a longer prefix the last sign is a word of its own
                before = out[n - 2] + self.counts(unit[n - 1])[-1]
        own = self.counts(word)
        if _SHORT.fullmatch(unit) and len(word) > 2:  # up to its last sign a contraction is an apostrophe and letters
            own = [own[0], *(own[0] + k for k in self.counts(word[1:-1])), own[-1]]
        return out + [before + k for k in (own[1:] if taken < n else own)]

    def steps(self, unit: str) -> bytes:
        return steps_of(self.words(unit))

    def learn(self, units: set[str]) -> None:
        """Put the steps of units into the cache. Plain words are taken in sorted order: the nodes of a common prefix
        are the same and needn't be made again; those of the first STEM bytes are kept."""
        cache, missing, other = self.cache, [], []
        for u in units:
            if u not in cache:
                found = self.older.get(u)
                if found is not None:
                    cache[u] = found
                elif len(u) <= LONG:
                    (other if u[0] == "'" or u[:2].isspace() or u[0] != " " and u[0].isspace() else missing).append(u)
        if len(cache) + len(missing) + len(other) > CACHE:  # what isn't asked for again until the next time goes
            self.older, self.cache = cache, {u: cache[u] for u in units if u in cache}
            cache = self.cache
        missing.sort()
        before, ids, counts, stems = b"", [-1], [0], self.stems
        for u in missing:
            data, k = u.encode("utf-8", "replace"), STEM
            if data[:STEM] != before[:STEM]:
                stem = stems.get(data[:STEM])
                if stem is None:
                    stem = ids, counts = [-1], [0]
                    self.extend(data[:STEM], ids, counts)
                    if len(stems) >= STEMS:
                        stems.clear()
                    stems[data[:STEM]] = stem
                ids, counts = stem[0].copy(), stem[1].copy()
            else:
                for x, y in zip(before[STEM:], data[STEM:], strict=False):
                    if x != y:
                        break
                    k += 1
                del ids[k + 1 :], counts[k + 1 :]
            self.extend(data, ids, counts)
            before = data
            cache[u] = steps_of(counts[1:] if len(data) == len(u) else at_ends(data, counts[1:]))
        for u in other:
            cache[u] = self.steps(u)

    def plain(self, text: str, units: list[str] | None = None) -> Iterator[np.ndarray]:
        """The steps of a text without special tokens, in parts; of `units` if they are known. Those of texts of up to
        BATCH code points have been learnt, but for long ones."""
        get = self.cache.get
        if len(text) <= BATCH:
            units = units or UNIT.findall(text)
            parts = [*map(get, units)]
            if None in parts:
                parts = [p or self.steps(u) for p, u in zip(parts, units, strict=True)]
            yield np.frombuffer(b"".join(parts), "<i4")
            return
        parts, held = [], 0
        for m in UNIT.finditer(text):
            u = m.group()
            parts.append(get(u) or self.steps(u))
            held += len(u)
            if held >= BATCH:
                yield np.frombuffer(b"".join(parts), "<i4")
                parts, held = [], 0
        yield np.frombuffer(b"".join(parts), "<i4")

    def all_steps(self, text: str, units: list[str] | None = None) -> Iterator[np.ndarray]:
        """The steps of a text (with these units, but for special tokens), in parts."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            # the signs of the special token but its last are plain text of a prefix
            count, whole, n = 0, 0, m.start() - at
            for part in self.plain(text[at : m.end() - 1]):
                whole += int(part[: max(0, n)].sum())
                n -= len(part)
                count += int(part.sum())
                yield part
            yield np.array([whole + 1 - count], "<i4")
            at = m.end()
        yield from self.plain(text[at:]) if at else self.plain(text, units)

    def blocks(self, text: str, units: list[str] | None = None) -> Iterator[np.ndarray]:
        """The steps in blocks of BLOCK code points, the last one shorter (an empty text has an empty one)."""
        if len(text) <= BLOCK:
            yield np.concatenate([*self.all_steps(text, units)])
            return
        held, n = [], 0
        for part in self.all_steps(text, units):
            held.append(part)
            n += len(part)
            if n >= BLOCK:
                whole = np.concatenate(held)
                cut = (n - 1) // BLOCK * BLOCK  # at least one step stays for the last block
                yield from (whole[i : i + BLOCK] for i in range(0, cut, BLOCK))
                held, n = [whole[cut:]], n - cut
        yield np.concatenate(held)


_counters: dict[str, Counter] = {}


def counter_of(raw: bytes) -> Counter:
    """The counter of a worker, made once."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(raw)
    return _counters[key]


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """A model file, by a local path or any that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            raw = f.read(MAX_MODEL_BYTES + 1)
    else:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return raw


def _batch(rows: list[tuple], steps: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in steps])]).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *steps]), pa.int32()))
    row, doc, block, start, base, n, size, last = zip(*rows, strict=True)
    long = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([long(row), long(doc), pa.array(block, pa.int32()), long(start), long(base), values, long(n), long(size), pa.array(last, pa.bool_())], [f.split(" ")[0] for f in FIELDS.split(", ")])


def _counted(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    counter = counter_of(sent.value)
    rows, steps, held = [], [], 0
    for batch in sliced(batches, most=2 << 20):
        raws = raw_texts(batch)
        texts = [r.decode("utf-8", "replace") for r in raws]
        cut = [UNIT.findall(t) if len(t) <= BATCH else [] for t in texts]
        counter.learn(set().union(*cut))
        for key, doc, raw, text, units in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), raws, texts, cut, strict=True):
            start = base = k = 0
            for own in counter.blocks(text, units):
                n = base + int(own.sum())
                rows.append((key, doc, k, start, base, n, len(raw), start + len(own) == len(text)))
                steps.append(own)
                start, base, k, held = start + len(own), n, k + 1, held + len(own)
                if held >= BATCH or len(rows) >= 10_000:
                    yield _batch(rows, steps)
                    rows, steps, held = [], [], 0
    if rows:
        yield _batch(rows, steps)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(row, doc_id, block, start, base, steps, n_tokens, n_bytes, last) of docs (doc_id, text): a row for each block of
    BLOCK code points; n_tokens is the count at its end, n_bytes that of the whole text. One map, no shuffle. Write it
    before asking, since `row` is made anew with every run."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model_bytes(spark, path or default_model()))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return own.mapInArrow(lambda it: _counted(it, sent), FIELDS)


def tokens_at(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (row, n_chars) with n_tokens: the tokens of the first n_chars code points of that row's text. A text
    that is shorter counts as a whole, less than one code point has no token."""
    blocks = counts.select("row", "block", "start", "base", "steps", F.col("last"))
    n = F.greatest(F.col("n_chars").cast("long"), F.lit(0))
    q = asked.select("row", "n_chars").withColumn("_block", F.floor(F.greatest(n - 1, F.lit(0)) / BLOCK).cast("int"))
    ends = counts.filter("last").select("row", F.col("block").alias("_end"), F.col("n_tokens").alias("_all"))
    q = q.join(ends, "row").withColumn("block", F.least("_block", "_end"))
    inside = F.aggregate(F.slice("steps", F.lit(1), F.greatest(n - F.col("start"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    found = q.join(blocks, ["row", "block"]).withColumn("n_tokens", F.when(F.col("_block") > F.col("_end"), F.col("_all")).otherwise(F.col("base") + inside))
    return found.select("row", "n_chars", "n_tokens")


def longest_prefixes(counts: DataFrame, budget: int) -> DataFrame:
    """(row, doc_id, n_chars, n_tokens): the most code points of each text whose tokens fit the budget, and their count."""

    @F.pandas_udf("struct<n_chars: long, n_tokens: long>")
    def fits(start: pd.Series, base: pd.Series, steps: pd.Series) -> pd.DataFrame:
        out = []
        for s, b, own in zip(start, base, steps, strict=True):
            counts = b + np.cumsum(own)
            at = np.flatnonzero(counts <= budget)
            out.append((s + at[-1] + 1, counts[at[-1]]) if len(at) else (0, 0))
        return pd.DataFrame(out, columns=["n_chars", "n_tokens"])

    found = counts.select("row", "doc_id", fits("start", "base", "steps").alias("fit"))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("fit").alias("fit")).select("row", "doc_id", "fit.n_chars", "fit.n_tokens")


def over_budget(counts: DataFrame, budget: int) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens, over_limit) of every text: the count at its last prefix against the budget."""
    return counts.filter("last").select("row", "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"))


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """The documents with texts cut to the longest prefix that fits the budget, in the same columns; nothing is encoded
    twice. Rows stay packed, so that no name of theirs can clash."""
    keyed = written(docs.select(F.struct("*").alias("packed"), F.col("doc_id"), F.col("text")), "texts")
    keyed = keyed.withColumn("_row", F.monotonically_increasing_id())  # of a written table, so that it stays the same
    counts = written(prefix_counts(keyed.select("doc_id", "text"), path), "prefix-counts")
    cut = longest_prefixes(counts, budget).select(F.col("row").alias("_row"), "n_chars")
    text = F.when(F.col("text").isNotNull(), F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int")))
    joined = keyed.join(cut, "_row").select(F.col("packed").withField("text", text).alias("packed"))
    return joined.select("packed.*")


def count_digest(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    counts = written(prefix_counts(docs.select("doc_id", "text"), path), "prefix-counts")
    return over_budget(counts, limit).select("doc_id", "n_bytes", "n_tokens", "over_limit")
