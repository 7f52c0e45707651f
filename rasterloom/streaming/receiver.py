"""A receiver of packets as a stateful stream: what can be played so far, gaps, order, and a reset to the checkpoint.

State of a stream is a few numbers: the next sequence number, what has been seen, the intervals that can be played. A packet out
of sequence is refused and changes nothing (a gap is not waited for); a sender that goes back to the missing number is accepted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream_id long, seq long, kind string, status string, next_seq long, playable long"
STATE = "next_seq long, declared long, checkpoint boolean, last_t long, intervals long, ended boolean"
FRESH = (0, 0, False, 0, 0, False)


def feed(state: tuple, seq: int, kind: str, t: int | None) -> tuple[tuple, str]:
    """The state after a packet, and applied or why not."""
    nxt, declared, checkpoint, last, intervals, ended = state
    if kind == "reset":
        # back to the checkpoint: the next packet is the one after it
        return ((2 + declared, declared, True, 0, 0, False), "applied") if checkpoint else (state, "no checkpoint")
    if seq != nxt:
        return state, "gap" if seq > nxt else "repeated"
    if ended:
        return state, "packet after the end"
    if (seq == 0) != (kind == "header"):
        return state, "header not first"
    if kind in ("object", "palette"):
        if checkpoint:
            return state, "declaration after checkpoint"
        declared += 1
    elif kind == "checkpoint":
        if checkpoint:
            return state, "second checkpoint"
        checkpoint = True
    elif kind == "interval":
        if not checkpoint:
            return state, "interval before checkpoint"
        if t is None or t <= last:
            return state, "time does not rise"
        last, intervals = t, intervals + 1
    elif kind == "integrity":
        ended = True
    elif kind != "header":
        return state, "unknown kind"
    return (nxt + 1, declared, checkpoint, last, intervals, ended), "applied"


def _run(key, rows: Iterable[tuple], state: tuple) -> tuple[list[tuple], tuple]:
    out = []
    for seq, kind, t in rows:
        state, status = feed(state, seq, kind, t)
        out.append((key, seq, kind, status, state[0], 1 + state[4] if state[2] else 0))
    return out, state


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("arrival", kind="stable")
    return [(int(s), k, None if pd.isna(t) else int(t)) for s, k, t in zip(pdf["seq"], pdf["kind"], pdf["t"])]


COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def received(packets: DataFrame) -> DataFrame:
    """packets (stream_id, arrival, seq, kind, t) as they arrive, in a stream. Rows of one micro-batch are taken by arrival."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else FRESH
        out, now = _run(int(key[0]), _rows(pd.concat(list(batches))), now)
        state.update(now)
        yield pd.DataFrame(out, columns=COLUMNS)

    return packets.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def received_batch(packets: DataFrame) -> DataFrame:
    """The same over a whole table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_run(int(pdf["stream_id"].iloc[0]), _rows(pdf), FRESH)[0], columns=COLUMNS)

    return packets.groupBy("stream_id").applyInPandas(run, OUT)
