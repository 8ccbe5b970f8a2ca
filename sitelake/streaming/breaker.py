"""A failure breaker over a stream of fetch outcomes, with state for each host."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSED, OPEN, HALF_OPEN, ABORTED = "closed", "open", "half_open", "aborted"


@dataclass(frozen=True)
class Breaker:
    most_failures: int = 5
    pause: timedelta = timedelta(minutes=10)
    most_after_pause: int = 3


State = tuple[str, int, int, float]
START: State = (CLOSED, 0, 0, 0.0)


def step(state: State, at: datetime, failed: bool, cfg: Breaker) -> tuple[State, list[tuple[str, str]]]:
    """The next state (name, failures, failures after the pause, opened at) and the transitions made. An
    open breaker ignores outcomes until its pause is over; an aborted one stays so."""
    name, failures, after, opened = state
    moves: list[tuple[str, str]] = []
    now = at.timestamp()
    if name == OPEN and now - opened >= cfg.pause.total_seconds():
        moves.append((OPEN, HALF_OPEN))
        name = HALF_OPEN
    if name in (OPEN, ABORTED):
        return (name, failures, after, opened), moves
    if not failed:
        if name == HALF_OPEN:
            moves.append((HALF_OPEN, CLOSED))
        return START, moves
    if name == CLOSED:
        failures += 1
        if failures >= cfg.most_failures:
            moves.append((CLOSED, OPEN))
            return (OPEN, failures, 0, now), moves
        return (CLOSED, failures, after, opened), moves
    after += 1
    if after >= cfg.most_after_pause:
        moves.append((HALF_OPEN, ABORTED))
        name = ABORTED
    return (name, failures, after, opened), moves


_OUT = "host string, ts timestamp, from_state string, to_state string"
_STATE = "name string, failures int, after int, opened double"


def _replay(host: str, state: State, rows: Iterable[tuple], cfg: Breaker) -> tuple[State, list[tuple]]:
    out = []
    for at, failed in rows:
        state, moves = step(state, at, failed, cfg)
        out += [(host, at, a, b) for a, b in moves]
    return state, out


def failure_breaker_stream(log: DataFrame, cfg: Breaker = Breaker()) -> DataFrame:
    """Transitions (host, ts, from_state, to_state) of a stream (host, ts, seq, failed). Within a batch a host's rows are taken in
    order of ts and seq, held as one frame; rows that arrive in a later batch are taken after those before, whatever their time.
    A host without open failures needs no state; any other one keeps it for good, since an open or aborted breaker has to be
    remembered however long its host is quiet."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", "seq"])
        last, out = _replay(key[0], state.get if state.exists else START, zip(rows.ts, rows.failed, strict=True), cfg)
        if last != START:
            state.update(last)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["host", "ts", "from_state", "to_state"])

    known = log.withColumn("failed", F.coalesce("failed", F.lit(False)))
    return known.groupBy("host").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")


def failure_breaker_batch(log: DataFrame, cfg: Breaker = Breaker()) -> DataFrame:
    """The same over a table: rows are dealt by host, sorted in the task and streamed through step()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, START
        for batch in batches:
            out = []
            for h, at, failed in zip(batch.host, batch.ts, batch.failed, strict=True):
                if h != host:
                    host, state = h, START
                state, moves = step(state, at, failed, cfg)
                out += [(h, at, a, b) for a, b in moves]
            yield pd.DataFrame(out, columns=["host", "ts", "from_state", "to_state"])

    dealt = log.select("host", "ts", "seq", F.coalesce("failed", F.lit(False)).alias("failed")).repartition("host").sortWithinPartitions("host", "ts", "seq")
    return dealt.mapInPandas(run, _OUT)
