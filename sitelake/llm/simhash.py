"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link if they differ in at most `threshold` = 3. Cut into halves of 32
bits, a linked pair differs in at most one bit in one half. Of a half, 31 bits are covered by the
Hamming code [31, 26]: every word has a codeword within its covering radius of 1, given by its
syndrome. An anchor is such a codeword with the 32nd bit beside it. A fingerprint is replicated, in
each half, to every anchor within covering radius plus threshold, 1 + 1 = 2: its own anchor and up to
16 others. So of any linked pair, both stand at the own anchor of either, and comparing per anchor
finds the link. Only distinct fingerprints are compared, whatever the number of copies.

An anchor with more than CROWD fingerprints is not compared in one task: its fingerprints are dealt to
(anchor, block, bits) for the four 8-bit blocks of the other half. A pair with at most 3 differing bits
agrees in at least one of four blocks, so no link is lost. What is still crowded is dealt once more, by the four
6-bit blocks of the other half's remaining bits. Within a cell the links are reduced to a
spanning forest before they leave the task, so rows grow with the fingerprints and not with the pairs.
Components come from alternating large-star and small-star steps on those forest edges; each step is a
table in the shared folder.

Defined results: a null or empty text has no words and fingerprint 0, which links like any other. A
null doc_id sorts behind all others and is returned as null. A repeated doc_id gives a row each time; of
equal ids the component is that of their texts. An empty table gives no rows. Other columns are ignored, and
pass through in keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import id_key, raw_texts, sliced, small_batches, text_key, without_rows, written

SEED, SHINGLE, THRESHOLD = 42, 3, 3
#: Fingerprints of an anchor that one task compares; those of larger ones are dealt on.
CROWD = 4096
#: Fingerprints compared with all others of their cell at a time.
TILE = 512

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(raws: list[bytes]) -> np.ndarray:
    """The fingerprints of texts, as unsigned 64-bit numbers."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for raw in raws:
        w = raw.translate(LOWER).split()
        n = len(hashes)
        if len(w) >= SHINGLE:
            hashes += [digest(b" ".join(x), SEED) for x in zip(w, w[1:], w[2:], strict=False)]
        elif w:
            hashes.append(digest(b" ".join(w), SEED))
        counts.append(len(hashes) - n)
    out = np.zeros(len(raws), np.uint64)
    h, n = np.array(hashes, np.uint64), np.array(counts, np.int64)
    ends = np.cumsum(n)
    full = np.flatnonzero(n)
    for bit in range(64 if len(h) else 0):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), (ends - n)[full])
        out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, most=2 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fingerprints(raw_texts(batch)).view(np.int64), pa.int64())], ["doc_id", "text_hash", "fp"])


def _nearest() -> np.ndarray:
    """For each syndrome the pairs of bits (as masks) whose columns sum to it: the columns of the Hamming
    code are the numbers 1 to 31, bit i has column i + 1, and 0 stands for no bit."""
    masks = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        pairs = {tuple(sorted((a, a ^ s))) for a in range(32)}
        masks[s] = sorted(sum(1 << (c - 1) for c in p if c) for p in pairs)
    return masks


_PAIRS = _nearest()
#: Parity checks: which of the 31 bits add to each bit of the syndrome.
_CHECKS = [sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)]


def anchors(half: np.ndarray) -> np.ndarray:
    """For each 32-bit word its anchors within distance 2, one row each: 17 columns, some of them equal.

    The 31 bits of a word with syndrome s are at a codeword after flipping one bit (column s), or the two
    of a pair whose columns sum to s; with syndrome 0 it is a codeword itself and no other is within 2.
    With the 32nd bit flipped too, only the nearest codeword is within 2."""
    syndrome = np.zeros(len(half), np.int64)
    for k, check in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(half & np.uint32(check)).astype(np.int64) & 1) << k
    out = half[:, None] ^ _PAIRS[syndrome]
    own = half ^ np.where(syndrome > 0, np.left_shift(np.uint32(1), np.maximum(syndrome - 1, 0).astype(np.uint32)), 0).astype(np.uint32)
    return np.concatenate([out, (own ^ np.uint32(1 << 31))[:, None]], axis=1)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 50_000):
            part = fp[i : i + 50_000].view(np.uint64)
            for k in range(2):
                at = np.sort(anchors((part >> np.uint64(32 * k)).astype(np.uint32)), axis=1)
                new = np.concatenate([np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]], axis=1)
                cell = at[new].astype(np.int64) | k << 32
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.repeat(part, new.sum(axis=1)).view(np.int64), pa.int64())], ["cell", "fp"])


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest found first of its component) that connect what is linked in a cell."""
    fp = np.unique(fp)
    u, rest = fp.view(np.uint64), np.arange(len(fp))
    a, b = [fp[:0]], [fp[:0]]
    if len(u) <= TILE and (np.bitwise_count(u[:, None] ^ u) <= THRESHOLD).sum() == len(u):
        return a[0], b[0]
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = (np.bitwise_count(u[frontier[:TILE], None] ^ u[None, rest]) <= THRESHOLD).any(axis=0)
            new, rest = rest[near], rest[~near]
            a.append(fp[new])
            b.append(np.full(len(new), fp[root]))
            frontier = np.concatenate([frontier[TILE:], new])
    return np.concatenate(a), np.concatenate(b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch is held until the next one begins."""
    row = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])  # noqa: E731
    last, held = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        cell, fp = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for c, h in (("key", last), ("fp", held)))
        if not len(cell):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        last, held = cell[cuts[-1] :], fp[cuts[-1] :]
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        x, y = fp[two], fp[two + 1]
        near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD)
        found = [(x[near], y[near]), *(_forest(fp[i : i + n]) for i, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2], strict=True))]
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        yield row(np.maximum(a, b), np.minimum(a, b))
    a, b = _forest(held)
    yield row(np.maximum(a, b), np.minimum(a, b))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints fps.fp."""
    cells = written(fps.select("fp").distinct().mapInArrow(_replicate, "cell long, fp long"), "anchors")
    full = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("cell"), "crowded")
    small = cells.join(full, "cell", "left_anti").select(F.xxhash64("cell").alias("key"), "fp")
    dealt = _dealt(cells.join(full, "cell"))
    both = small.unionByName(dealt) if dealt is not None else small
    return both.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long").distinct()


def _dealt(cells: DataFrame) -> DataFrame | None:
    """(key, fp) of crowded anchors, dealt by blocks of the other half: a pair that shares such an anchor of one half
    differs by 3 bits in the other half at most."""
    if cells.isEmpty():
        return None
    other = F.when(F.col("cell") < F.lit(1 << 32), F.shiftright("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit((1 << 32) - 1))

    def block(k: int) -> Column:
        rest = other.bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.shiftleft(F.shiftright(other, 8 * k + 8), 8 * k))
        return F.struct(F.xxhash64("cell", F.lit(k), F.shiftright(other, 8 * k).bitwiseAND(255)).alias("key"), rest.alias("rest"))

    first = written(cells.select("fp", F.explode(F.array(*map(block, range(4)))).alias("x")).select("x.key", "fp", "x.rest"), "dealt")
    full = written(first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"), "crowded-blocks")
    again = F.explode(F.array(*(F.xxhash64("key", F.lit(j), F.shiftright("rest", 6 * j).bitwiseAND(63)) for j in range(4))))
    second = first.join(full, "key").select(again.alias("key"), "fp")
    return first.join(full, "key", "left_anti").select("key", "fp").unionByName(second)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller ones and itself) go to its smallest."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a table, so that the join has an exchange on both sides and a node with very many edges can be split
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    own = both.join(least, "a")
    out = own.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else own.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge to smaller ones, with the smallest node of its component."""
    now = written(edges, "edges")
    summed = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()  # noqa: E731
    before = None
    while (state := tuple(summed(now))) != before:
        before = state
        now = written(_star(written(_star(now, True), "large"), False), "small")
    return now


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the text's hash and the root of its group."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), "text")
    fps = written(texts.mapInArrow(_fingerprint_batches, "doc_id long, text_hash binary, fp long"), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min(id_key()).alias("first")), "distinct")
    root = components(links(first))
    of = first.join(root, first.fp == root.a, "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(of.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", "root"), "components")
    # the table's side has its own exchange, so that a fingerprint with very many documents can be split
    return fps.join(named, fps.fp == named._fp).select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: a row for each document with the smallest doc_id that links lead to."""
    return _grouped(docs).drop("text_hash", "root")


def component_digest(docs: DataFrame) -> DataFrame:
    hexed: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group stays, that with the smallest doc_id, then text hash; all columns stay. Of rows
    with one id and text, that with the smallest hash of all columns stays."""
    keys = _grouped(docs).groupBy(id_key().alias("_id"), "text_hash", "root", "component_id").agg(F.count(F.lit(1)).alias("n"))
    keys = written(keys, "keys")
    # groups of null ids alone share a component_id, so the root names the group
    chosen = keys.filter(F.col("_id") == F.col("component_id")).groupBy(F.col("root").alias("_root")).agg(F.min("text_hash").alias("_chosen"))
    stays = (F.col("_id") == F.col("component_id")) & (F.col("text_hash") == F.col("_chosen"))
    judged = keys.join(written(chosen, "chosen"), F.col("root") == F.col("_root")).select(F.col("_id").alias("id"), F.col("text_hash").alias("hash"), "n", stays.alias("stays"))
    own = {"id": id_key(), "hash": text_key()}
    out = without_rows(docs, written(judged.filter("not stays").select("id", "hash"), "copies"), own)
    several = written(judged.filter("stays and n > 1").select("id", "hash"), "repeated")
    if several.isEmpty():
        return out
    packed = docs.select(F.struct("*").alias("row"), *(v.alias(k) for k, v in own.items()))
    one = packed.join(several, ["id", "hash"]).groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return without_rows(out, several, own).unionByName(one.select("row.*"))


def fingerprint(text: str | None) -> int:
    """A fingerprint by the definition; for tests."""
    w = (text or "").encode().translate(LOWER).split()
    s = [b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, SEED) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# --- the same in SQL: XXH64 by its published steps, on numbers that are cut to 64 bits. Fixed values: its primes.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _mul(a: str, k: int) -> str:
    return f"((({a})::UHUGEINT * {k}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT"


def _add(*parts: str) -> str:
    return f"(({' + '.join(f'({p})::UHUGEINT' for p in parts)}) % {2**64}::UHUGEINT)::UBIGINT"


def _rotated(a: str, r: int) -> str:
    return f"list_transform([{a}], lambda x: {_add(_mul('x', 2**r), f'x >> {64 - r}')})[1]"


def _lane(accumulator: str, lane: str) -> str:
    return _mul(_rotated(_add(accumulator, _mul(lane, _PRIMES[1])), 31), _PRIMES[0])


def _number(at: str, size: int) -> str:
    """Bytes of the hex string x from a place on, the last one first, as a number."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT"


def _hash_sql() -> str:
    """CTEs from distinct strings (u.s) to hashed (s, h)."""
    p1, p2, p3, p4, p5 = _PRIMES
    starts = [(SEED + p1 + p2) % 2**64, (SEED + p2) % 2**64, SEED, (SEED - p1) % 2**64]
    sums = [f"list_reduce(list_transform(range(0, n // 32), lambda j: lanes[4 * j + {i + 1}]), lambda v, k: {_lane('v', 'k')}, {start}::UBIGINT) AS v{i}" for i, start in enumerate(starts)]
    whole = _add(*(_rotated(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))))
    for i in range(4):
        whole = _add(_mul(f"xor({whole}, {_lane('0::UBIGINT', f'v{i}')})", p1), f"{p4}")
    by_lane = _add(_mul(_rotated(f"xor(h, {_lane('0::UBIGINT', 'k')})", 27), p1), f"{p4}")
    return f"""
p AS (SELECT s, strlen(s) AS n, hex(encode(s)) AS x FROM u),
l AS (SELECT s, n, x, list_transform(range(0, n // 8), lambda j: {_number("8 * j", 8)}) AS lanes FROM p),
v AS (SELECT *, {", ".join(sums)} FROM l),
h0 AS (SELECT s, n, x, lanes, {_add(f"CASE WHEN n >= 32 THEN {whole} ELSE {(SEED + p5) % 2**64}::UBIGINT END", "n")} AS h FROM v),
h1 AS (SELECT s, n, x, list_reduce(lanes[4 * (n // 32) + 1:], lambda h, k: {by_lane}, h) AS h FROM h0),
h2 AS (SELECT s, n, x, CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rotated(f"xor(h, {_mul(_number('n // 8 * 8', 4), p1)})", 23), p2), f"{p3}")} ELSE h END AS h FROM h1),
h3 AS (SELECT s, list_reduce(list_transform(range(n // 4 * 4, n), lambda j: {_number("j", 1)}), lambda h, b: {_mul(_rotated(f"xor(h, {_mul('b', p5)})", 11), p1)}, h) AS h FROM h2),
h4 AS (SELECT s, {_mul("xor(h, h >> 33)", p2)} AS h FROM h3),
h5 AS (SELECT s, {_mul("xor(h, h >> 29)", p3)} AS h FROM h4),
hashed AS (SELECT s, xor(h, h >> 32) AS h FROM h5)"""


_BITS_SQL = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {2**b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws FROM documents),
shingles AS (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
),
u AS (SELECT DISTINCT s FROM shingles),
{_hash_sql()},
bits AS (SELECT doc_id, {_BITS_SQL} AS fp FROM shingles JOIN hashed USING (s) GROUP BY doc_id),
fps AS (SELECT w.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM w LEFT JOIN bits ON bits.doc_id = w.doc_id),
one AS (SELECT DISTINCT fp FROM fps),
near AS (SELECT a.fp AS a, b.fp AS b FROM one a JOIN one b ON bit_count(xor(a.fp, b.fp)) <= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
named AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN fps ON fp = b GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM fps JOIN named ON a = fp
"""
