"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has a node for each character boundary and an edge for each piece that ends there. The
model is a BPE model: its merges, best score first, make exactly one piece the last of every prefix,
namely the one that forms a valid pair with the last piece of the prefix before it (two pieces are a
valid pair if merging their joined text gives them back). So each node keeps one backpointer, and the
path back from the end of the text is the encoding. Only the last `longest piece` nodes can be the start
of a new edge: the window. When all backpointer paths from the window meet at one boundary, everything
before it is committed and forgotten. Where the vocabulary has no piece across two neighbouring
characters, as before a word's space, all paths meet by construction, so texts are committed there at the
latest. What is between two such places is a stretch: one that fits into the window is committed at its end,
a longer one is streamed by the window. Of a long text the stretches of a part are held at a time. The ids of stretches are kept in a bounded cache, and short
stretches with a common prefix share its nodes. A character that is no piece becomes its UTF-8 byte pieces.

As the library does, a space reads as U+2581, one is put before the text, and empty texts have no ids.
Decoding joins the pieces' bytes and drops that one space. A text with U+2581 itself decodes to a space
there, so `round_trip` compares with the text in which it is a space. Null reads as empty; a null or
repeated doc_id gives a row like any other; encode() keeps extra columns packed, whatever their names.

The model file is a parameter. Models that this doesn't encode as the library does are refused: other types than
BPE, none without byte pieces, with a normalizer that changes texts, or with symbols of the user. The driver reads it and sends its bytes along (MAX_MODEL_BYTES at most).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake.llm.common import raw_texts, sliced, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
#: Stretches kept in the newer part of the cache (the older has as many), and pairs whose validity is known.
CACHE, PAIRS = 300_000, 400_000
SPACE = "▁"
#: Characters of a text whose stretches are held at once.
PART = 1 << 20
_WORD = re.compile(f"(?<![ {SPACE}]) ")
#: A character that is no piece has this bit and its code point for an id, until it becomes bytes.
UNKNOWN, ID_BITS = 1 << 21, 22


def fields(proto: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; nested messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n, shift = 0, 0
        while True:
            b = proto[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(proto):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, proto[at : at + n]
            at += n


def refusal(proto: bytes) -> str | None:
    """Why a model can't be encoded here. Numbers are those of the library's model format."""
    top = dict(x for x in fields(proto) if x[0] in (2, 3))
    trainer, normalizer = (dict(fields(top.get(n, b""))) for n in (2, 3))
    if trainer.get(3, 1) != 2:
        return "it isn't a BPE model"
    if not trainer.get(35):
        return "it has no byte pieces"
    if trainer.get(24):
        return "it puts white space after words"
    if normalizer.get(2):
        return "its normalizer changes characters"
    if normalizer.get(4, 1):
        return "its normalizer removes spaces"
    if not (normalizer.get(3, 1) and normalizer.get(5, 1)):
        return "it doesn't put a space before the text, or keeps spaces as they are"
    if any(dict(fields(x)).get(3) == 4 for n, x in fields(proto) if n == 1):
        return "it has symbols of the user"
    return None


class Model:
    """The pieces of a BPE model with their scores."""

    def __init__(self, proto: bytes):
        import sentencepiece

        if why := refusal(proto):
            raise ValueError(f"this model can't be used: {why}")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece: dict[int, str] = {}
        self.byte_id, self.bytes = [0] * 256, [b""] * sp.vocab_size()
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece], self.piece[i] = i, sp.get_score(i), piece
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.id))
        self.table = np.array(self.bytes, dtype=object)
        across = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: If no piece goes on with a space after something else, words can be cut before their spaces.
        self.cut_before_space = not any(x[1] == SPACE != x[0] for x in across)
        #: White space that is part of no longer piece stands alone.
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.id if len(p) > 1))
        one = f"[{alone}]|" if alone else ""
        self.stretch = re.compile(f"{one}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if self.cut_before_space else r"(?s).+")
        self.pairs: dict[int, bool] = {}
        #: Lengths of the pieces that end with these (at most four) characters, longest first.
        self.ending: dict[str, set[int]] = {}
        for p in self.id:
            self.ending.setdefault(p[-4:], set()).add(len(p))
        self.lengths: dict[str, tuple[int, ...]] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by the merges themselves: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def text_of(self, i: int) -> str:
        return chr(i ^ UNKNOWN) if i & UNKNOWN else self.piece[i]

    def valid(self, pair: int) -> bool:
        """Whether merging the text of two pieces (ids in one number) gives them back."""
        left, right = self.text_of(pair >> ID_BITS), self.text_of(pair & (1 << ID_BITS) - 1)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        # if the two make a piece, they would be merged
        found = self.pairs[pair] = left + right not in self.id and self.merged(left + right) == [left, right]
        return found

    def lengths_of(self, tail: str) -> tuple[int, ...]:
        """Lengths that a piece ending with these characters can have; a single character always can."""
        if len(self.lengths) >= PAIRS:
            self.lengths.clear()
        own = {1}.union(*(self.ending.get(tail[-k:], ()) for k in range(1, len(tail) + 1)))
        self.lengths[tail] = found = tuple(sorted(own, reverse=True))
        return found

    def extend(self, text: str, ids: list[int], sizes: list[int]) -> None:
        """Add the nodes of a stretch to those of its prefix: the last piece of text[:i] has the id ids[i]
        and sizes[i] characters. ids[0] is the piece before the stretch, or -1."""
        known, lengths, pairs = self.id, self.lengths, self.pairs
        for i in range(len(ids), len(text) + 1):
            tail = text[i - 4 : i] if i > 3 else text[:i]
            for n in lengths.get(tail) or self.lengths_of(tail):
                if n > i:
                    continue
                own = known.get(text[i - n : i])
                if own is None:
                    if n > 1:
                        continue
                    own = UNKNOWN | ord(text[i - 1])
                before = ids[i - n]
                if before < 0:
                    break
                pair = before << ID_BITS | own
                ok = pairs.get(pair)
                if ok or (ok is None and self.valid(pair)):
                    break
            else:
                raise ValueError(f"no path to {i} of {text!r}")
            ids.append(own)
            sizes.append(n)

    def path(self, ids: list[int], sizes: list[int], end: int) -> list[int]:
        """The ids on the path back from a node, in order; unknown characters as their bytes."""
        back: list[int] = []
        while end:
            back.append(ids[end])
            end -= sizes[end]
        back.reverse()
        if max(back, default=0) >= UNKNOWN:
            back = [x for i in back for x in ([self.byte_id[b] for b in chr(i ^ UNKNOWN).encode()] if i & UNKNOWN else [i])]
        return back

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a stretch of any length, in parts, each as soon as it is certain."""
        base, ids, sizes, step = 0, [-1], [0], self.longest
        for end in range(step, len(text) + step, step):
            part = text[base:end]
            self.extend(part, ids, sizes)
            # where do the paths from the window meet?
            nodes = set(range(max(0, len(part) - self.longest + 1), len(part) + 1)) if end < len(text) else {len(part)}
            while len(nodes) > 1:
                top = max(nodes)
                nodes.discard(top)
                nodes.add(top - sizes[top])
            meet = nodes.pop()
            if meet:
                yield self.path(ids, sizes, meet)
                base, ids, sizes = base + meet, ids[meet:], sizes[meet:]

    def learn(self, stretches: set[str]) -> None:
        """Put the ids of stretches into the cache. They are taken in sorted order: of those within the window
        the nodes of a common prefix are the same and needn't be made again. Longer ones are streamed; those of
        more than four windows aren't kept."""
        cache, missing = self.cache, []
        for s in stretches:
            if s not in cache:
                found = self.older.get(s)
                if found is not None:
                    cache[s] = found
                elif len(s) <= 4 * self.longest:
                    missing.append(s)
        missing.sort()
        if len(cache) + len(missing) > CACHE:  # what isn't asked for again until the next time goes
            self.older, self.cache = cache, {s: cache[s] for s in stretches if s in cache}
        before, ids, sizes = "", [-1], [0]
        for text in missing:
            if len(text) > self.longest:
                self.cache[text] = self.ids_of(text)
                continue
            k = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                k += 1
            del ids[k + 1 :], sizes[k + 1 :]
            self.extend(text, ids, sizes)
            before, self.cache[text] = text, tuple(self.path(ids, sizes, len(text)))

    def ids_of(self, stretch: str) -> tuple[int, ...]:
        """The ids of a stretch longer than the window, streamed."""
        return tuple(i for part in self.stream(stretch) for i in part)

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of about PART characters, cut before spaces where words begin, so that no stretch is cut. Only a
        stretch that is longer makes a longer part."""
        at = 0
        while self.cut_before_space and len(text) - at > PART:
            m = _WORD.search(text, at + PART)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def stretches(self, part: str, first: bool) -> list[str]:
        return self.stretch.findall((SPACE if first else "") + part.replace(" ", SPACE)) if part else []

    def ids_in(self, cut: list[str]) -> np.ndarray:
        get, ids = self.cache.get, []
        for stretch in cut:
            ids += get(stretch) or self.ids_of(stretch)
        return np.array(ids, np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts. Those of long ones are made part by part: besides the text and its ids, only a part's stretches
        are held."""
        short = [self.stretches(t, True) if len(t) <= PART else [] for t in texts]
        self.learn(set().union(*short))
        out = [self.ids_in(own) if len(t) <= PART else None for t, own in zip(texts, short, strict=True)]
        del short
        for i, t in enumerate(texts):
            if out[i] is None:
                found = []
                for k, part in enumerate(self.parts(t)):
                    cut = self.stretches(part, k == 0)
                    self.learn(set(cut))
                    found.append(self.ids_in(cut))
                out[i] = np.concatenate(found)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join(b"".join(self.table[ids[i : i + PART]]) for i in range(0, len(ids), PART))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_models: dict[str, Model] = {}


def model_of(proto: bytes) -> Model:
    """The model of a worker, read once."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _models:
        _models[key] = Model(proto)
    return _models[key]


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """A model file, by a local path or any that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            proto = f.read(MAX_MODEL_BYTES + 1)
    else:
        proto = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if len(proto) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return proto


def _encoded(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = model_of(sent.value)
    for batch in sliced(batches, most=2 << 20):
        texts = [raw.decode("utf-8", "replace") for raw in raw_texts(batch)]
        rows = model.encode_all(texts)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        decoded = [model.decode(x) for x in rows]
        same = [x == t.replace(SPACE, " ") for x, t in zip(decoded, texts, strict=True)]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))
        digest = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in rows]
        new = [ids, pa.array(np.diff(ends), pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
        rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *new], [*(batch.schema.names[i] for i in rest), "ids", "n_ids", "ids_sha256", "decoded", "round_trip"])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc, ids, n_ids, ids_sha256 of the ids as little-endian 32-bit numbers, decoded, round_trip): doc has the columns of
    docs but text, packed, so that no name of theirs can clash."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, path))
    packed = docs.select(F.struct("*").alias("doc"), "text")
    packed = packed.withColumn("doc", F.col("doc").dropFields("text") if len(docs.columns) > 1 else F.struct(F.lit(None).cast("void").alias("none")))
    found = T.StructType([packed.schema["doc"], *T._parse_datatype_string("ids array<int>, n_ids long, ids_sha256 string, decoded string, round_trip boolean")])
    return packed.mapInArrow(lambda it: _encoded(it, sent), found)


def encoding_digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256, decoded_sha256, round_trip."""
    out = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    return out.select("doc.doc_id", "n_ids", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
