"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

Four base patterns with their checks (domain, octets, Luhn, digit count) always stand. Around them,
generators with wide patterns propose further and overlapping candidates: e-mail addresses with written
out signs, digit groups of any punctuation as telephone numbers, card numbers with other separators,
addresses with signs in place of dots or of eight groups. A candidate is described by its format and its surroundings. Labels come from two
sides. What passes a base pattern's check is a positive, what fails it or sits inside a longer token a
negative, anything else has no label. And each match is rewritten in its place in forms that no base pattern
has (signs written out, no country code, other separators), which are positives, and with digits that fail the
check, which are negatives: so the trees learn from form and context, and are measured, beyond the base patterns.
Candidates are described without the sign that makes them base matches (the +, the @).

The trees (pyspark.ml's GBTClassifier) are fitted on the labelled candidates of all documents; a fifth of these, chosen
by a hash, is held out. Candidates that look alike are one row with their number as its weight, and there are as many bins
as Spark needs to find splits from every row. On what is held out, isotonic regression turns scores into
probabilities, and each kind's threshold is the lowest score whose probability is at least PRECISION (thresholds() takes
it from running sums). Then one pass over all texts finds base spans, scores
the other candidates and adds those that reach the threshold and overlap nothing better.

Defined results: a null or empty text has no spans; with no labelled candidates of both classes nothing
is added; of overlapping additions that with the higher score stays, of equal ones the leftmost, then the kind
listed first, then the shorter; repeated rows and null ids give a row each, an empty table none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sitelake.llm.common import raw_texts, sliced, small_batches, written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
#: A kind with fewer positives held out takes the threshold of all; ranges of scores that are summed apart; rows in a task of the fit.
FEW, RANGES, FIT_ROWS = 30, 1024, 100_000
TREES, DEPTH = 20, 3
CONTEXT = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WIDE = (
    ("email", re.compile(r"(?i)(?<![\w.+-])[\w.%+-]{1,64}(?: ?[\(\[]at[\)\]] ?|@)[a-z0-9-]{1,63}(?:(?:\.| ?[\(\[]dot[\)\]] ?| dot )[a-z0-9-]{1,63}){1,5}")),
    ("email", re.compile(r"(?i)(?<![\w.+-])[\w.%+-]{1,64} at [a-z0-9-]{1,63}(?: dot [a-z0-9-]{1,63}){1,5}")),
    ("email", re.compile(r"(?<![\w.+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){0,5}")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3,7}(?::[0-9]{1,5})?(?![0-9])")),
    ("ip", re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?: ?[\[({](?:\.|dot)[\])}] ?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}(?![\w:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])(?<![0-9][ ./_-])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{3,6}){2,4}(?![ ./_-]?[0-9])")),
    ("phone", re.compile(r"\+?(?<![0-9])\(?[0-9](?:[ ()./ -]{0,3}[0-9]){6,14}(?![0-9])")),
)
_WORDS = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "móvil", "anruf"),
}
_GROUPS = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[^0-9A-Za-z:]+(?:dot[^0-9A-Za-z:]+)?")
_WRITTEN = ((re.compile(r"(?i) ?[\(\[]at[\)\]] ?| at "), "@"), (re.compile(r"(?i) ?[\(\[]dot[\)\]] ?| dot "), "."))
_COUNTRY = re.compile(r"\+[0-9]{1,3}[ .-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUPS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind; each pattern's leftmost matches that
    don't overlap, without those that fail their check."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, end := m.end()))
    if _GROUPS.search(text):
        for m in _IP.finditer(text):
            # int() isn't asked of very long numbers
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that the generators propose."""
    low = text.lower()
    written_at = "at)" in low or "at]" in low
    # a pattern is left out only where a text lacks what each of its matches holds
    may = ("@" in text or written_at, " at " in low and " dot " in low, "@" in text)
    some = bool(_GROUPS.search(text))
    may += (some, some and any(x in low for x in (".]", ".)", ".}", "dot]", "dot)", "dot}")), text.count(":") > 6, "::" in text)
    may += (some,) * (len(_WIDE) - len(may))
    return sorted({(m.start(), KINDS.index(k), m.end()) for (k, p), on in zip(_WIDE, may, strict=True) if on for m in p.finditer(text)})


FEATURES = 22


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a candidate. The + of a number and the signs of an address are left out; separators count alike,
    whatever they are and however many, and of hexadecimal groups only their number, so that what is learnt on some forms holds for
    others."""
    span = text[start:end].lstrip("+")
    area = "(" in span
    if kind == 0:
        for pattern, sign in _WRITTEN:
            span = pattern.sub(sign, span)
    else:
        span = _BETWEEN.sub(" ", span)
    hexes = sum(bool(_GROUPS.search(g)) for g in span.split(":")) if ":" in span else 0
    groups = [] if hexes else _GROUPS.findall(span)
    digits = "".join(groups)
    before, after = text[max(0, start - CONTEXT) : start].rstrip("+").lower(), text[end : end + 1]
    local, _, domain = span.partition("@")
    labels = domain.split(".") if domain else []
    last = before[-1:]
    return [
        *(float(kind == k) for k in range(4)),
        len(digits),
        len(span) if not hexes else 0,
        len(groups),
        len(digits) / len(groups) if groups else 0,
        len(groups[-1]) if groups else 0,
        max((len(g) for g in groups), default=0),
        float(kind == 3 and area),
        float(kind != 0 and " " in span.strip()),
        float(last.isalnum() or last in ("_", "/", "=", "#", '"')) if last else 0.0,
        float(after.isalnum() or after in ("_", "/", "=", '"')) if after else 0.0,
        float(12 <= len(digits) <= 19 and luhn(digits)),
        max((int(g[:6]) for g in groups), default=0) if kind == 1 else 0.0,
        float(sum(w in before for w in _WORDS[KINDS[kind]])),
        len(labels[-1]) if kind == 0 and labels else 0,
        len(local) + 100 * len(labels) if kind == 0 else 0,
        float(hexes > 0),
        float(kind == 1 and ":" not in span and len(groups) == 4 and all(int(g[:6]) <= 255 for g in groups)),
        float(min(hexes, 3)),
    ]


def label(text: str, base: set[tuple[int, int, int]], start: int, kind: int, end: int) -> int | None:
    """1, 0 or no label, by the checks of the base patterns."""
    if (start, kind, end) in base:
        return 1
    span, last, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    if any(k == kind and s < end and start < e for s, k, e in base):
        return None
    inside = (last.isalnum() or last == "_") or (after.isalnum() or after == "_")
    digits = len(_digits(span))
    if kind == 0:
        return 0 if "@" in span else None
    if inside or any(s < end and start < e for s, _, e in base):
        return 0
    if kind == 1:
        return 0 if re.fullmatch(r"[0-9]+(\.[0-9]+)+", span) else None
    if kind == 2:
        return 0 if not luhn(_digits(span)) else None
    return 0 if digits < 9 or digits > 15 or not re.search(r"[ ().-]", span) else None


def _in_fours(d: str, sign: str) -> str:
    return sign.join(d[i : i + 4] for i in range(0, len(d), 4))


def _sixto4(span: str, form: str) -> str:
    """An address of four octets within one of eight groups."""
    a, b, c, d = (int(x) for x in span.split("."))
    return form.format(f"{a:02x}{b:02x}", f"{c:02x}{d:02x}")


#: Forms that no base pattern matches as a whole, by kind: (name, the new form of an address, or of digits).
FORMS = {
    0: (
        ("(at) (dot)", lambda s: s.replace("@", " (at) ").replace(".", " (dot) ")),
        ("[at]", lambda s: s.replace("@", "[at]")),
        ("at dot", lambda s: s.replace("@", " at ").replace(".", " dot ")),
        ("[at] dot", lambda s: s.replace("@", " [at] ").replace(".", " dot ")),
    ),
    1: (
        ("[.]", lambda s: s.replace(".", "[.]")),
        ("(dot)", lambda s: s.replace(".", " (dot) ")),
        ("eight groups", lambda s: _sixto4(s, "2002:{}:{}:0:0:0:0:1")),
        ("two colons", lambda s: _sixto4(s, "2002:{}:{}::1")),
    ),
    2: tuple((repr(x), lambda d, x=x: _in_fours(d, x if len(d) == 16 else "")) for x in (".", "/", "_", "  ", " - ")),
    3: (
        ("(area) 3-4", lambda d: f"({d[:3]}) {d[3:-4]}-{d[-4:]}"),
        ("3-3-4", lambda d: f"{d[:3]}-{d[3:-4]}-{d[-4:]}"),
        ("3.3.4", lambda d: f"{d[:3]}.{d[3:-4]}.{d[-4:]}"),
        ("3 3 4", lambda d: f"{d[:3]} {d[3:-4]} {d[-4:]}"),
    ),
}


def rewritten(text: str, start: int, kind: int, end: int, pick: int, without: str | None = None, only: str | None = None) -> tuple[str, int, int] | None:
    """A match of a base pattern in another form, with its label: one of FORMS, or (one in four) one whose digits fail the check. A
    form can be left out, to measure on it what was learnt without it, or be the only one."""
    span, bad = text[start:end], pick % 4 == 3 and kind > 0
    forms = [f for n, f in FORMS[kind] if n != without and only in (None, n)]
    if not forms:
        return None
    form = forms[pick // 4 % len(forms)]
    if kind == 1:
        if any(len(x) > 3 or (len(x) > 1 and x[0] == "0") for x in span.split(".")):
            return None
        if bad:  # only written out ones can have too large a number
            first, *rest = span.split(".")
            dotted = [f for n, f in FORMS[1][:2] if n != without and only in (None, n)]
            if not dotted:
                return None
            span, form = ".".join([str(256 + (int(first) + pick) % 700), *rest]), dotted[pick // 4 % len(dotted)]
        new = form(span)
    elif kind == 0:
        local, _, domain = span.partition("@")
        new = local + form("@" + domain)
    else:
        d = _digits(span)
        if kind == 2 and bad:
            d = d[:-1] + str((int(d[-1]) + 1 + pick // 4 % 9) % 10)
        elif kind == 3:
            d = d[-5:] if bad else d[-10:] if len(d) > 10 else d
        new = form(d)
    return text[:start] + new + text[end:], start + len(new), 0 if bad else 1


@dataclass
class Scorer:
    """The fitted trees as arrays, with a threshold for each kind. Small: TREES x 2^(DEPTH + 1) numbers."""

    weights: list[float] = field(default_factory=list)
    feature: np.ndarray | None = None
    cut: np.ndarray | None = None
    value: np.ndarray | None = None
    thresholds: tuple[float, ...] = (np.inf,) * 4

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for t, w in enumerate(self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                right = x[rows, np.maximum(f, 0)] > self.cut[t, at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            out += w * self.value[t, at]
        # exp() of an array may differ in its last bit with the array's length, and thresholds are scores
        return np.round(1 / (1 + np.exp(-2 * out)), 9)


def _trees(model) -> Scorer:
    n = 2 ** (DEPTH + 1)
    s = Scorer(list(model.treeWeights), np.full((len(model.trees), n), -1), np.zeros((len(model.trees), n)), np.zeros((len(model.trees), n)))

    def walk(t: int, at: int, node) -> None:
        if node.subtreeDepth() == 0:
            s.value[t, at] = node.prediction()
        else:
            s.feature[t, at], s.cut[t, at] = node.split().featureIndex(), node.split().threshold()
            walk(t, 2 * at + 1, node.leftChild())
            walk(t, 2 * at + 2, node.rightChild())

    for t, tree in enumerate(model.trees):
        walk(t, 0, tree._call_java("rootNode"))
    return s


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct scores and their probabilities: pooled until they never fall."""
    at, first = np.unique(score, return_inverse=True)
    hits, n = np.bincount(first, y), np.bincount(first)
    blocks: list[list[float]] = []
    for h, k in zip(hits, n, strict=True):
        blocks.append([h, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, k2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + k2, blocks[-1][2] + w2]
    return at, np.repeat([h / k for h, k, _ in blocks], [int(w) for _, _, w in blocks])


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return np.inf
    at, p = isotonic(score, y)
    ok = np.flatnonzero(p >= PRECISION)
    return float(at[ok[0]]) if len(ok) else np.inf


def labelled(text: str, without: str | None = None) -> list[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, label) of the candidates of a text that have one, and of rewritten matches."""
    base = set(base_spans(text))
    out = [(text, *c, of) for c in sorted({*base, *candidates(text)}) if (of := label(text, base, *c)) is not None]
    for i, (start, kind, end) in enumerate(sorted(base)):
        if (new := rewritten(text, start, kind, end, zlib.crc32(f"{i} {text[start:end]}".encode()), without)) is not None:
            other, stop, of = new
            around = other[max(0, start - 200) : stop + 200]  # candidates near the match are the same as in the whole text
            shift = max(0, start - 200)
            out += [(other, s + shift, k, e + shift, of) for s, k, e in candidates(around) if k == kind and s + shift <= start and e + shift >= stop and not any(b < e + shift and s + shift < z for b, _, z in base if z <= start)]
    return out


def _labelled(batches: Iterator[pa.RecordBatch], without: str | None = None) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found: Counter = Counter()
        for raw in raw_texts(batch):
            for text, start, kind, end, of in labelled(raw.decode("utf-8", "replace"), without):
                forms = [(start, kind, end)]
                if of and kind == 3 and (m := _COUNTRY.match(text, start)):  # a number without its country is one too
                    forms.append((m.end(), 3, end))
                held = int.from_bytes(hashlib.sha256(f"{start} {kind} {text[start:end]}".encode()).digest()[:6], "big") % 5 == 0
                found.update((tuple(features(text, *f)), float(of), held) for f in forms)
        x, y, held, n = zip(*((*k, n) for k, n in found.items()), strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(held, pa.bool_()), pa.array(n, pa.int64())], ["x", "label", "held", "n"])


def _scored(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("x").flatten()).reshape(-1, FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, :4].argmax(1)), pa.array(scorer.score(x)), pa.array(batch.column("label").to_numpy().astype(np.int64)), batch.column("n")], ["kind", "score", "label", "n"])


def thresholds(scored: DataFrame) -> tuple[float, ...]:
    """For each kind _threshold() of all rows (kind, score, label, n) of it, or of all kinds where it has FEW positives.

    Isotonic probabilities reach PRECISION behind the place where the running sum of label - PRECISION, by score, is
    first at its least. Sums of ranges of scores are made apart, and those of whole ranges (RANGES a kind) put before them."""
    least = round(100 * PRECISION)
    rows = scored.unionByName(scored.withColumn("kind", F.lit(-1).cast("long")))
    sums = rows.groupBy("kind", "score").agg(F.sum(F.col("n") * (100 * F.col("label") - least)).alias("gain"), F.sum(F.col("n") * F.col("label")).alias("hits"))
    sums = written(sums.withColumn("range", F.floor(F.col("score") * RANGES).cast("int")), "scores")
    whole = written(sums.groupBy("kind", "range").agg(F.sum("gain").alias("gain"), F.sum("hits").alias("hits")), "score-ranges")
    before = whole.select("kind", "range", F.coalesce(F.sum("gain").over(W.partitionBy("kind").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    to = F.col("before") + F.sum("gain").over(W.partitionBy("kind", "range").orderBy("score").rowsBetween(W.unboundedPreceding, 0))
    lowest = sums.join(F.broadcast(before), ["kind", "range"]).select("kind", "score", to.alias("to")).groupBy("kind").agg(F.min(F.struct("to", "score")).alias("low"))
    # a sum that never falls below nothing is at its least before the first score
    last = lowest.select("kind", F.when(F.col("low.to") < 0, F.col("low.score")).otherwise(-1.0).alias("last"))
    first = sums.join(F.broadcast(last), "kind").groupBy("kind").agg(F.sum("hits").alias("hits"), F.min(F.when(F.col("score") > F.col("last"), F.col("score"))).alias("first"))
    found = {r.kind: (r.hits, np.inf if r["first"] is None else r["first"]) for r in first.collect()}  # a row a kind
    for_all = found.get(-1, (0, np.inf))[1]
    return tuple(found[k][1] if k in found and found[k][0] >= FEW else for_all for k in range(4))


def fit(docs: DataFrame, without: str | None = None) -> Scorer:
    """Trees and thresholds from all labelled candidates; `without` one of the forms they are rewritten in."""
    alike = docs.select("text").mapInArrow(lambda it: _labelled(it, without), "x array<double>, label double, held boolean, n long").groupBy("x", "label", "held").agg(F.sum("n").alias("n"))
    rows = written(alike.sortWithinPartitions("x", "label"), "candidates")
    n = {r.label: r["count"] for r in rows.filter("NOT held").groupBy("label").count().collect()}
    if set(n) != {0.0, 1.0}:
        return Scorer()
    total = sum(n.values())
    # Spark finds splits in a sample unless the square of the bins reaches the rows
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="n", maxBins=max(32, math.isqrt(total) + 1))
    train = rows.filter("NOT held").coalesce(max(4, -(-total // FIT_ROWS))).select(array_to_vector("x").alias("features"), "label", F.col("n").cast("double").alias("n")).cache()
    try:
        scorer = _trees(trees.fit(train))
    finally:
        train.unpersist()
    scorer.thresholds = thresholds(rows.filter("held").mapInArrow(lambda it: _scored(it, scorer), "kind long, score double, label long, n long"))
    return scorer


def select(text: str, scorer: Scorer) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and those that the trees add."""
    base = base_spans(text)
    if not scorer.weights:
        return base, []
    free = [c for c in candidates(text) if not any(s < c[2] and c[0] < e for s, _, e in base)]
    if not free:
        return base, []
    score = scorer.score(np.array([features(text, *c) for c in free]))
    good = [(-p, c) for p, c in zip(score, free, strict=True) if p >= scorer.thresholds[c[1]]]
    added: list[tuple[int, int, int]] = []
    for _, c in sorted(good):
        if not any(s < c[2] and c[0] < e for s, _, e in added):
            added.append(c)
    return base, sorted(added)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each selected span replaced by its kind in brackets; of overlapping ones, the union
    under the first one's kind."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        counts, digests, spans, redacted = [], [], [], []
        for raw in raw_texts(batch):
            text = raw.decode("utf-8", "replace")
            base, added = select(text, scorer)
            counts.append([sum(k == i for _, k, _ in base) for i in range(4)] + [len(added)])
            digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            spans.append(spans_text(sorted([*base, *added])))
            redacted.append(redact(text, [*base, *added]))
        columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *(pa.array(x, pa.string()) for x in (digests, spans, redacted))], [*_NAMES])


_NAMES = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "redacted")


def find_personal_data(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, n_added, all spans, and the redacted text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    scorer = scorer or fit(docs)
    return docs.mapInArrow(lambda it: _found(it, scorer), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, redacted string")


def span_digest(docs: DataFrame) -> DataFrame:
    """The digest of find_personal_data(), with the number of all spans."""
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return find_personal_data(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", n_spans.alias("n_spans"), F.sha2("redacted", 256).alias("redacted_sha256"))
