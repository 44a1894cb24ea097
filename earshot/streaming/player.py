"""Listening time as keyed state of the player-event stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from earshot.operators.player import QUALIFIED_SECONDS

OUTPUT = "play_id string, ts_ms long, listen_ms long, qualified_ms long"
STATE = "total long, opened long, qualified long, last long"
RANK = {"reset": 0, "pause": 1, "play": 2, "snapshot": 2}


def fold_events(
    state: tuple[int, int, int, int], kinds: np.ndarray, ts: np.ndarray, limit: int
) -> tuple[tuple[int, int, int, int], int]:
    """The timer after a batch of events in time order, and what it reads then.

    The state is (total, opened or -1, qualified or -1, time of the newest event). An event that
    comes late counts as one at the newest moment seen: no span is ever negative.
    """
    total, opened, qualified, last = state
    ts = np.maximum.accumulate(np.maximum(ts, last))
    moves = kinds != "snapshot"
    if opened >= 0:  # the open timer goes on as if its play came first
        kind, at = np.r_[["play"], kinds[moves]], np.r_[opened, ts[moves]]
    else:
        kind, at = np.r_[["pause"], kinds[moves]], np.r_[ts[0], ts[moves]]
    until = np.r_[at[1:], ts[-1]]
    plays = kind == "play"
    span = np.where(plays, until - at, 0)
    # A span counts when a pause closes it; a reset clears what came before.
    closed = np.where(np.r_[kind[1:] == "pause", False], span, 0)
    before = total + np.r_[0, np.cumsum(closed)[:-1]]
    resets = kind == "reset"
    clear = np.maximum.accumulate(np.where(resets, before, 0))
    timer = before - np.where(np.logical_or.accumulate(resets), clear, 0)
    if qualified < 0:
        reached = np.flatnonzero(plays & (timer + span >= limit))
        if len(reached):
            i = reached[0]
            qualified = int(at[i] + max(limit - timer[i], 0))
    held = 0 if resets[-1] else int(timer[-1])
    opened = int(at[-1]) if plays[-1] else -1
    return (held, opened, qualified, int(ts[-1])), held + (int(span[-1]) if plays[-1] else 0)


def listen_stream(
    events: DataFrame, seconds: float = QUALIFIED_SECONDS, idle_ms: int = 86_400_000
) -> DataFrame:
    """Stream of each play's timer, and when it qualified, after every micro-batch.

    The state is four numbers per play; a play without events for ``idle_ms`` is freed.
    """
    limit = int(seconds * 1000)

    def update(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks))
        rows = rows.assign(_rank=rows["kind"].map(RANK)).sort_values(["ts_ms", "_rank"])
        timer = state.get if state.exists else (0, -1, -1, 0)
        timer, reading = fold_events(
            timer, rows["kind"].to_numpy(str), rows["ts_ms"].to_numpy(np.int64), limit
        )
        state.update(timer)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            {
                "play_id": [key[0]],
                "ts_ms": [timer[3]],
                "listen_ms": [reading],
                "qualified_ms": pd.array([None if timer[2] < 0 else timer[2]], dtype="Int64"),
            }
        )

    return events.groupBy("play_id").applyInPandasWithState(
        update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
