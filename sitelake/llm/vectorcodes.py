"""Vector codes: vectors are cut into parts, and each part is coded by the nearest entry of a codebook (product
quantisation by Lloyd rounds in whole numbers), with LAESA pivots.

A few entries of each part's first codebook, far from each other, are its pivots for good. The distances of every
vector's parts to them are computed once and written. Each round the distances of the pivots to the codebook's entries
(a few thousand) are computed by the driver. |d(part, pivot) - d(pivot, entry)| is at most d(part, entry), so the
largest of these differences is a lower bound. Entries are evaluated, in whole numbers, in the order of their
bounds, until the next bound is above the best distance found; ties go to the lower index, so an entry whose bound equals the
best is evaluated. Bounds are rounded down and compared with some slack, so that no rounding can drop the nearest entry.

A round is one map over the written table: its tasks give counts and sums of each entry, which Spark adds up. The
driver holds codebooks only: `entries` vectors, whatever the size of the table.

A component x is floor(SCALE * x), exact at any size: parts whose squared distances could pass 64 bits are computed
with Python's numbers, and sums travel as digits of 62 bits. An error that doesn't fit a long is null. Rows without a
vector, or with a null, NaN or infinite component, are left out. Vectors that are shorter than the longest one, or
whose length is no multiple of the parts, read as if zeros followed. Rows with a null id come last, rows that share an
id by their vectors; each gives a row. Fewer vectors than `entries` make smaller codebooks; an empty table gives no rows.
Labels may be missing (null). Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import id_key, small_batches, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Pivots of a part.
PIVOTS = 6
#: Whole numbers up to this size are computed in 64 bits, if a part has at most WIDE of them.
SMALL, WIDE = 1 << 26, 512
#: Vectors that are compared at once, and components that are subtracted at once.
ROWS, CELLS = 1024, 1 << 20
#: Bits of a digit of a sum.
DIGIT = 62
_SLACK = 2.0**-48


def whole(x: float) -> int:
    """floor(SCALE * x), also where the product passes the largest float."""
    return math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of floats, as 64-bit numbers if they are small and as Python's otherwise."""
    if len(values) == 0 or np.abs(values).max() < SMALL / SCALE:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    return np.array([whole(float(x)) for x in values.ravel()], dtype=object).reshape(values.shape)


def fitting(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in 64 bits if all are small, else as Python's."""
    small = numbers.shape[-1] <= WIDE and (numbers.size == 0 or max(abs(int(numbers.max())), abs(int(numbers.min()))) <= SMALL)
    return numbers.astype(np.int64 if small else object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots as floats; infinite where a float can't hold the square."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    flat = [math.sqrt(x) if x < 1 << 1000 else math.inf for x in d.ravel()]
    return np.array(flat, np.float64).reshape(d.shape)


def pivots_of(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first one, then each time that with the largest distance to those taken."""
    taken, near = [0], squared(book, book[:1])
    while len(taken) < min(n, len(book)):
        at = max(range(len(book)), key=lambda i: (near[i], -i))
        taken.append(at)
        near = np.minimum(near, squared(book, book[at : at + 1]))
    return book[taken]


def nearest(parts: np.ndarray, own: np.ndarray, book: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, squared distance, exact evaluations) of the nearest entry of each part (rows of whole numbers). own: distances
    of the parts to the pivots; between: those of the pivots to the entries."""
    n, k = len(parts), len(book)
    bound = np.zeros((n, k))
    with np.errstate(invalid="ignore"):
        for p in range(own.shape[1]):
            a, b = own[:, p : p + 1], between[p]
            low = np.abs(a - b) - (a + b) * _SLACK
            np.maximum(bound, np.where(low > 0, low, 0.0), out=bound)  # nan, where floats end, bounds nothing
    order = np.argsort(bound, axis=1, kind="stable")
    kind = object if parts.dtype == object or book.dtype == object else np.int64
    index, best, evaluated = np.zeros(n, np.int64), np.zeros(n, kind), np.zeros(n, np.int64)
    active, at, width = np.arange(n), 0, 4
    while at < k and len(active):
        for rows in np.array_split(active, max(1, len(active) * min(width, k - at) * parts.shape[1] // CELLS)):
            which = order[rows, at : at + width]
            d = squared(parts[rows][:, None, :], book[which])
            if at:  # with what was best so far
                which, d = np.column_stack([index[rows], which]), np.column_stack([best[rows], d])
            least = d.min(axis=1)
            index[rows] = np.where(d == least[:, None], which, k).min(axis=1)
            best[rows] = least
            evaluated[rows] += which.shape[1] - (at > 0)
        at, width = at + width, width * 2
        if at < k:
            active = active[bound[active, order[active, at]] <= root(best[active]) * (1 + _SLACK)]
    return index, best, evaluated


def in_digits(v: int) -> Iterator[int]:
    """v in digits of DIGIT bits, lowest first, the last one with the sign."""
    while not -(1 << DIGIT) <= v < 1 << DIGIT:
        yield v & (1 << DIGIT) - 1
        v >>= DIGIT
    yield v


def _padded(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """The vectors as rows of `width` floats, zeros at their ends."""
    column = batch.column(name)
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if batch.num_rows and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((batch.num_rows, width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int, n_parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their whole numbers: rows, parts, components."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own = batch.slice(at, ROWS)
            yield own, whole_numbers(_padded(own, "vector", width)).reshape(own.num_rows, n_parts, width // n_parts)


def _assigned(batches, sent, width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, tuple]]:
    """(rows, part, its whole numbers, nearest()) for each slice and part."""
    books, between = sent.value
    for own, numbers in _parts(batches, width, len(books)):
        n = len(between[0])
        far = own.column("far").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, len(books), n)
        for p, book in enumerate(books):
            part = fitting(numbers[:, p])
            yield own, p, part, nearest(part, far[:, p], book, between[p])


class Codec:
    """Codebooks for a table of vectors; made by fit()."""

    def __init__(self, table: DataFrame, width: int, books: list[np.ndarray], pivots: list[np.ndarray]):
        self.table, self.width, self.books, self.pivots = table, width, books, pivots

    def _sent(self):
        """Codebooks and their distances to the pivots, for the tasks: `entries` vectors and a few numbers for each."""
        between = [root(squared(p[:, None, :], b[None, :, :])) for p, b in zip(self.pivots, self.books, strict=True)]
        return self.table.sparkSession.sparkContext.broadcast((self.books, between))

    def round(self) -> None:
        """Every entry becomes the floor of the mean of its parts; those without parts stay."""
        sent, width = self._sent(), self.width

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value[0]
            total = [[[0] * b.shape[1] for _ in b] for b in books]
            count = [np.zeros(len(b), np.int64) for b in books]
            for _, p, part, (index, _, _) in _assigned(batches, sent, width):
                count[p] += np.bincount(index, minlength=len(books[p]))
                order = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.diff(index[order], prepend=-1))
                for e, own in zip(index[order][first], np.add.reduceat(part[order], first, axis=0), strict=True):
                    total[p][e] = [a + int(b) for a, b in zip(total[p][e], own, strict=True)]
            rows = [(p, e, at, k, d, int(count[p][e])) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist() for at, v in enumerate(total[p][e]) for k, d in enumerate(in_digits(v))]
            names = ("part", "entry", "position", "digit", "value", "n")
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 10_000], strict=True)], names)

        partial = self.table.mapInArrow(sums, "part long, entry long, position long, digit long, value long, n long")
        # a number that has fewer digits in one task has zeros there, so all rows of a task count once: at digit 0
        summed = partial.groupBy("part", "entry", "position", "digit").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"), F.sum("n").alias("n"))
        found: dict[tuple[int, int, int], list[int]] = {}
        for r in summed.collect():  # `entries` vectors, in digits
            v = found.setdefault((r.part, r.entry, r.position), [0, 0])
            v[0] += int(r.value) << DIGIT * r.digit
            v[1] = max(v[1], r.n)
        books = [b.astype(object) for b in self.books]
        for (p, e, at), (value, n) in found.items():
            books[p][e, at] = value // n
        self.books = [fitting(b) for b in books]
        sent.destroy()

    def codes(self) -> DataFrame:
        """(vec_id, label, code, error, n_exact) of the table: code has two hex digits for each part (more, if a codebook has
        over 256 entries), error is the sum of the squared distances, n_exact counts the distances that were evaluated."""
        sent, width, digits = self._sent(), self.width, max(2, len(f"{max(len(self.books[0]) - 1, 0):x}"))
        form = f"%0{digits}x"

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes: list[str] = []
            for own, p, _, (index, best, n) in _assigned(batches, sent, width):
                if p == 0:
                    codes, error, exact = [""] * own.num_rows, [0] * own.num_rows, np.zeros(own.num_rows, np.int64)
                codes = [a + form % b for a, b in zip(codes, index.tolist(), strict=True)]
                error = [a + int(b) for a, b in zip(error, best, strict=True)]
                exact += n
                if p == len(sent.value[0]) - 1:
                    fits = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(codes, pa.string()), fits, pa.array(exact)], ["vec_id", "label", "code", "error", "n_exact"])

        label = self.table.schema["label"].dataType.simpleString()
        return self.table.mapInArrow(coded, f"vec_id long, label {label}, code string, error long, n_exact long")

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimals, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def finite(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~bad)


def fit(vectors: DataFrame, vector: str = "embedding", entries: int = ENTRIES, n_parts: int = PARTS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> Codec | None:
    """Codebooks of vectors (vec_id, vector, label) after so many rounds; none for an empty table."""
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = finite(vectors, vector).select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col(vector).alias("vector"))
    first = [r.vector for r in kept.orderBy(id_key("vec_id"), "vector").select("vector").limit(entries).collect()]  # bounded by `entries`
    if not first:
        return None
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, math.ceil(longest / n_parts)) * n_parts
    start = np.array([[whole(x) for x in v] + [0] * (width - len(v)) for v in first], dtype=object).reshape(len(first), n_parts, -1)
    books = [fitting(start[:, p]) for p in range(n_parts)]
    far_from = [pivots_of(b, pivots) for b in books]
    sent = spark.sparkContext.broadcast(far_from)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, numbers in _parts(batches, width, n_parts):
            far = np.stack([root(squared(fitting(numbers[:, p])[:, None, :], sent.value[p][None, :, :])) for p in range(n_parts)], axis=1)
            each = far.shape[1] * far.shape[2]
            ends = pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * each)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], [*own.schema.names, "far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    codec = Codec(written(kept.mapInArrow(measured, f"{fields}, far array<double>"), "pivot-distances"), width, books, far_from)
    sent.destroy()
    for _ in range(rounds):
        codec.round()
    return codec


def code_digest(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows with the label, nulls together), codebooks_sha256."""
    codec = fit(vectors, vector)
    if codec is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # written, so that the join's sides come straight from an exchange: a label can hold most rows
    codes = written(codec.codes(), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole_sum = F.when(F.count_if(F.col("error").isNull()) == 0, total)
    sums = written(codes.groupBy("label").agg(F.when(whole_sum < F.lit("9223372036854775808").cast("decimal(38,0)"), whole_sum).cast("long").alias("label_error")), "label-errors")
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds as one query: every distance of every part and entry, by whole numbers that doubles hold."""
    out = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM (SELECT *, unnest(range(4)) AS p FROM kept))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)",
    ]
    near = (
        "near{i} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT vec_id, a.p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d"
        " FROM parts a JOIN book{i} b ON a.p = b.p) GROUP BY vec_id, p)"
    )
    book = (
        "book{j} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (SELECT p, e, list(s ORDER BY pos) AS c FROM"
        " (SELECT p, e, pos, floor(sum(v) / count(*)) AS s FROM (SELECT a.p, n.e, unnest(range(len(x))) AS pos, unnest(x) AS v FROM parts a JOIN near{i} n ON n.vec_id = a.vec_id AND n.p = a.p) GROUP BY p, e, pos)"
        " GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"
    )
    for i in range(4):
        out += [near.format(i=i), book.format(i=i, j=i + 1)]
    out += [
        near.format(i=4),
        "digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM book4)",
        "coded AS (SELECT vec_id, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY vec_id)",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded c JOIN kept k ON k.vec_id = c.vec_id, digest"


ORACLE_SQL = _oracle()
