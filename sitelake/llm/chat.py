"""Chat formatting by incremental black-box rendering.

A template is any function from turns [(role, text), ...] to a string. For each turn the prefix that
ends with it is rendered and compared with the rendering of the prefix before it: if the shorter one is
a prefix of the longer, what was added is the turn's piece; if not, the template rewrites history, which
is recorded with the turn. Where the text lies inside its piece is found in the same way, by rendering
the turn with a one-character probe in place of its text: what stands before and after the probe frames
the text. The loss mask covers the text of assistant turns.

Prefixes are whole: each turn is rendered with all turns before it, which takes time with the square of a
conversation's turns. A template that says of itself that a turn's piece doesn't depend on turns further back
(`by_turn = True`, as `bracket_template` does) is rendered with WINDOW turns instead, in time in proportion to
the turns. Beyond WINDOW turns its pieces are held against renderings of the whole conversation, at doubling
lengths and at the end; if they differ, the turns since the last agreement and all later ones are rendered
with whole prefixes. A task holds the turns of one conversation.
Conversations are dealt by id, sorted by turn inside the task (role and text break ties) and streamed; the
output is a row for each turn, and its pieces in order are the formatted conversation.

The template here (`bracket_template`) marks turns in brackets and escapes `\\`, `[` and `<` in texts and
roles, in roles `]` too, so that no text holds a control string and parsing gives back what was formatted.

Defined results: null texts and roles are empty; a null conv_id is one conversation; rows that are equal
give a turn each; rows of a conversation with the id -1 and the turns of the probe that conversation_digest()
adds are one conversation, by turn; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import small_batches

WINDOW = 64
PROBE = "\ue000"
Turns = list[tuple[str, str]]

_ESCAPES = {"\\": "\\\\", "[": "\\(", "<": "\\{", "]": "\\)"}
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"\\[\\({)]")
_PIECE = re.compile(r"(?:<s>)?\[([^\[\]]*)\] ([^\[<]*) \[/\1\](?:</s>)?")


def escape(text: str, signs: str = r"[\\\[<]") -> str:
    return re.sub(signs, lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPES[m.group()], text)


def bracket_template(turns: Turns) -> str:
    out = []
    for role, text in turns:
        mark = escape(role, r"[\\\[<\]]")
        out.append(f"[{mark}] {escape(text)} [/{mark}]" + "</s>" * (role == "assistant"))
    return "<s>" + "".join(out)


bracket_template.by_turn = True


def read_pieces(formatted: str) -> Turns:
    """The turns of what bracket_template() gave."""
    return [(unescape(r), unescape(t)) for r, t in _PIECE.findall(formatted)]


def _added(before: str, after: str) -> tuple[str, bool]:
    """What a rendering adds to the one before it, and whether it left that as it was."""
    if after.startswith(before):
        return after[len(before) :], False
    same = next((i for i, (a, b) in enumerate(zip(before, after, strict=False)) if a != b), min(len(before), len(after)))
    return after[same:], True


def render_turn(render: Callable[[Turns], str], prefix: Turns, role: str, text: str) -> tuple[str, int, int, bool]:
    """A turn's piece, where its text begins and ends in it, and whether history was rewritten."""
    before = render(prefix) if prefix else ""
    piece, rewrites = _added(before, render([*prefix, (role, text)]))
    probed, _ = _added(before, render([*prefix, (role, PROBE)]))
    head, _, tail = probed.partition(PROBE)
    begin, end = len(head), len(piece) - len(tail)
    if PROBE not in probed or not (piece.startswith(head) and piece.endswith(tail) and begin <= end):
        return piece, 0, 0, True
    return piece, begin, end, rewrites


class _Conversation:
    """The turns of a conversation so far, and the rows that aren't yet held against a whole rendering."""

    def __init__(self, render: Callable[[Turns], str]):
        self.render, self.turns, self.held, self.formatted = render, [], [], ""
        self.whole, self.check_at = not getattr(render, "by_turn", False), 2 * WINDOW

    def _row(self, n: int, first: int) -> tuple:
        role, text = self.turns[n]
        piece, begin, end, rewrites = render_turn(self.render, self.turns[first:n], role, text)
        return (n, role, piece, begin, end, role == "assistant", rewrites)

    def add(self, role: str, text: str) -> list[tuple]:
        """The rows that are settled with this turn."""
        n = len(self.turns)
        self.turns.append((role, text))
        if self.whole or n < WINDOW:
            return [self._row(n, 0)]
        if n == WINDOW:
            self.formatted = self.render(self.turns[:n])
        self.held.append(self._row(n, n + 1 - WINDOW))
        return self.settle() if n + 1 == self.check_at else []

    def settle(self) -> list[tuple]:
        """The held rows, rendered anew if they don't add up to the whole conversation."""
        rows, self.held = self.held, []
        if not rows:
            return rows
        self.check_at *= 2
        formatted = self.render(self.turns)
        if any(x[-1] for x in rows) or formatted != "".join([self.formatted, *(x[2] for x in rows)]):
            self.whole = True
            return [self._row(x[0], 0) for x in rows]
        self.formatted = formatted
        return rows


_TURN = "conv_id long, turn_no long, role string, piece string, begin long, end long, in_loss boolean, rewrites boolean"


def _formatted(batches: Iterator[pa.RecordBatch], render: Callable[[Turns], str]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in _TURN.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    last, now = object(), _Conversation(render)
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != last:
                rows += [(last, *x) for x in now.settle()]
                last, now = conv, _Conversation(render)
            rows += [(conv, *x) for x in now.add(role or "", text or "")]
        if rows:
            yield of(rows)
    if rows := [(last, *x) for x in now.settle()]:
        yield of(rows)


def format_turns(turns: DataFrame, render: Callable[[Turns], str] = bracket_template) -> DataFrame:
    """A row for each turn: conv_id, turn_no, role, piece, begin and end of the text in it, in_loss and
    rewrites. Rows of a conversation stay together and in order, for readers that stream them."""
    small_batches(turns.sparkSession)
    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = cols.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda it: _formatted(it, render), _TURN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the pieces back; state for one conversation at a time, as running hashes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
    last, state, rows = object(), None, []

    def close() -> None:
        if state:
            rows.append((last, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewrites"]))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows.clear()
        return out

    for batch in batches:
        for conv, piece, begin, end, in_loss, rewrites in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "begin", "end", "in_loss", "rewrites")), strict=True):
            if conv != last:
                close()
                last, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "rewrites": 0}
            for role, text in read_pieces(piece):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            if in_loss:
                text = unescape(piece[begin:end])
                state["loss_chars"] += len(text)
                state["loss"].update(text.encode())
            state["chars"] += len(piece)
            state["rewrites"] += rewrites
        if len(rows) >= 5000:
            yield batch_of()
    close()
    if rows:
        yield batch_of()


def conversation_digest(turns: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the formatted pieces, conversation -1 included."""
    probe = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"
    return format_turns(cols.unionByName(extra)).mapInArrow(_digests, schema)


ORACLE_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) x
),
e AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) AS chars,
           2 * (length(role) + length(regexp_replace(role, '[^\\\[<\]]', '', 'g'))) + 7 + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END AS marks
    FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars + marks))::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites
FROM e GROUP BY conv_id
"""
