"""Text rules as column expressions: folding, tokens, summaries, hashes, money."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# Fixed value: the form of an amount.
MONEY = r"\b\d{1,3}(?:\.\d{3})*,\d{2}\b"
DECIMAL = "decimal(18,2)"


def _folds() -> tuple[str, str]:
    """Letters with marks and the letters below them, for all that decompose so up to U+1EFF."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and bare.isascii():
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _folds()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, _MARKED, _BARE)).otherwise(low)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c bound as the argument of a lambda, so that it is made once and not for every element of what f makes."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def runs(ordered: Column, key: Callable[[Column], Column], run: Callable[[Column, Column, Column], Column]) -> Column:
    """run(the array, begin, length) for each run of elements with equal keys in a sorted array that isn't empty."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (key(F.get(s, i)) != key(F.get(s, i - 1))))
    length = lambda s, b, i, k: F.coalesce(F.get(b, k + 1), F.size(s)) - i
    return once(ordered, lambda s: once(begins(s), lambda b: F.transform(b, lambda i, k: run(s, i, length(s, b, i, k)))))


def counted(terms: Column) -> Column:
    """The distinct terms of an array with their counts, in order of the terms: the array is sorted, and a run's length is
    the distance of its begin to the next one's. In the row, and in time in proportion to it but for the sort."""
    found = runs(F.sort_array(terms), lambda x: x, lambda s, i, n: F.struct(F.get(s, i).alias("term"), n.cast("long").alias("n")))
    empty = F.array().cast("array<struct<term: string, n: bigint>>")
    return F.when(F.size(terms) > 0, found).otherwise(empty)


def hashed(c: Column) -> Column:
    """sha256: and the hex digest."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def content_hash(title: Column, description: Column, full_text: Column) -> Column:
    return hashed(F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in (title, description, full_text))))


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def summary(c: Column, longest: int = 500, shortest: int = 450) -> Column:
    """The text if it has at most `longest` characters; else its beginning, cut before the last paragraph
    break from `shortest` on, else after the last of .!? from there on, else at `longest`."""
    head, tail = F.substring(c, 1, longest), F.substring(c, shortest + 1, longest - shortest)
    before_break = F.regexp_extract(tail, r"(?s)^(.*)\n\n", 1)
    to_sentence = F.regexp_extract(tail, r"(?s)^.*[.!?]", 0)
    start = F.substring(c, 1, shortest)
    cut = F.when(F.contains(tail, F.lit("\n\n")), F.concat(start, before_break)).when(to_sentence != "", F.concat(start, to_sentence)).otherwise(head)
    return F.when(F.char_length(c) <= longest, c).otherwise(trimmed(cut))


def money_values(c: Column) -> Column:
    """All numbers like 1.234,56 as decimals."""
    found = F.regexp_extract_all(c, F.lit(f"({MONEY})"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast(DECIMAL))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast(DECIMAL), lambda a, x: (a + x).cast(DECIMAL))
