"""The short-term taste vector as keyed state of the play stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from earshot.operators.sessions import DECAY, SESSION_GAP_MS

OUTPUT = "user_id string, last_ts long, vector array<double>"
#: A group's users side by side; ``vectors`` holds theirs as doubles, one after the other.
STATE = "users array<string>, last_ts array<long>, seen array<long>, vectors binary"
#: Groups that users are dealt to. Calling Python costs milliseconds a group, a user some microseconds.
GROUPS = 2_048


def fold_plays(
    vector: np.ndarray | None, last_ts: int, ts: np.ndarray, songs: np.ndarray, decay: float, gap: int
) -> tuple[np.ndarray, int]:
    """Move a taste vector through plays in time order.

    After a pause of at least ``gap`` the next play starts over. Only the last run of
    plays matters, so earlier ones are skipped and the rest is one weighted sum. A play that comes
    late counts as one at the newest moment seen; one at least ``gap`` older than that belongs to
    a session that is over, and is left out.
    """
    if vector is not None:
        fits = ts > last_ts - gap
        ts, songs = np.maximum(ts[fits], last_ts), songs[fits]
        if not len(ts):
            return vector, last_ts
    quiet = np.diff(ts, prepend=last_ts if vector is not None else ts[0] - gap)
    breaks = np.flatnonzero(quiet >= gap)
    start = breaks[-1] if len(breaks) else 0
    run = songs[start:].astype(np.float64)
    faded = decay ** np.arange(len(run) - 1, -1, -1, dtype=np.float64)
    weights = faded * (1.0 - decay)
    if len(breaks):
        weights[0] = faded[0]
        return weights @ run, int(ts[-1])
    return vector * decay ** len(run) + weights @ run, int(ts[-1])


def latest_vectors(updates: DataFrame) -> DataFrame:
    """``(user_id, short_vector, last_ts)`` of each user from the stream's kept micro-batches.

    ``updates`` has the stream's rows with the ``batch_id`` they were written under.
    """
    last = F.max_by(F.struct("last_ts", "vector"), "batch_id").alias("_last")
    return updates.groupBy("user_id").agg(last).select(
        "user_id", F.col("_last.vector").alias("short_vector"), "_last.last_ts"
    )


def short_term_stream(
    plays: DataFrame,
    items: DataFrame,
    decay: float = DECAY,
    ttl_ms: int = SESSION_GAP_MS,
    idle_ms: int = 86_400_000,
    groups: int = GROUPS,
) -> DataFrame:
    """Stream of each user's vector after every micro-batch with plays of theirs.

    Expiry follows event time, as in the batch form: a play at least ``ttl_ms`` after the
    last one starts over. The processing time ``idle_ms`` only frees the state of users
    who are gone; it is longer, so that a replay slower than real time loses nothing. The state is one
    vector per user. Users share ``groups`` groups by their hash; a micro-batch rewrites the groups that
    it has plays for, so many users want more groups (a checkpoint keeps to its number). What a task holds
    of a group or a busy user is their part of one micro-batch, whose size the source's admission limit
    sets (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``).
    """
    vectors = items.select(F.col("id").alias("track_id"), "embedding")
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group")
    known = plays.select(group, "user_id", "track_id", "timestamp").join(vectors, "track_id")

    def update(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [
            (
                c["user_id"].to_numpy(),
                c["timestamp"].to_numpy(),
                c["track_id"].to_numpy().astype(str),
                np.stack(c["embedding"].to_numpy()).astype(np.float32),
            )
            for c in chunks
            if len(c)
        ]
        names, ts, tracks, songs = (np.concatenate(p) for p in zip(*parts, strict=True))
        owner, users = pd.factorize(names, use_na_sentinel=False)
        order = np.lexsort((tracks, ts, owner))
        ts, songs = ts[order], songs[order]
        cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(users)))]
        now, kept = state.getCurrentProcessingTimeMs(), {}
        if state.exists:
            known_users, times, seen, stored = state.get
            held = np.frombuffer(bytes(stored), np.float64).reshape(len(known_users), -1)
            kept = {u: x for u, *x in zip(known_users, times, seen, held, strict=True) if x[1] > now - idle_ms}
        moved = [None if pd.isna(u) else u for u in users]
        for user, a, b in zip(moved, cuts[:-1], cuts[1:], strict=True):
            last_ts, _, vector = kept.get(user, (0, 0, None))
            vector, last_ts = fold_plays(vector, last_ts, ts[a:b], songs[a:b], decay, ttl_ms)
            kept[user] = last_ts, now, vector
        times, seen, held = zip(*kept.values(), strict=True)
        whole = bytearray(np.stack(held).astype(np.float64).tobytes())
        state.update((list(kept), [int(x) for x in times], [int(x) for x in seen], whole))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            {"user_id": moved, "last_ts": [kept[u][0] for u in moved], "vector": [kept[u][2] for u in moved]}
        )

    return known.groupBy("group").applyInPandasWithState(
        update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
