"""Sessions kept from run to run: ended ones as they end, and each user's last one as state.

A run reads the lake from the moment where the last run stopped, and the state, and nothing older.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import sessions
from earshot.sources import commits
from earshot.sources.lake import read_lake
from earshot.sources.tables import current_version, log_folder, read_entry

_ENDED = "user_id string, session_no bigint, last_ts bigint, n_plays bigint, vector array<double>"


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def advance(
    spark: SparkSession,
    lake: str,
    root: str,
    items: DataFrame,
    upto_ms: int,
    base: int | None = None,
    decay: float = sessions.DECAY,
    gap_ms: int = sessions.SESSION_GAP_MS,
    dim: int | None = None,
) -> int:
    """Publish the sessions up to ``upto_ms``, which must not lie before where the last run stopped.

    Only the lake's folders of the days in between are read. A version names its state and the
    ended sessions of all runs that led to it, so a run that dies changes nothing, and one that is
    repeated up to the same moment reads no plays. Plays that come after a run has passed their
    time are in no session; going on from an older version, ``base``, takes them up: that run and
    the ones after it are then made anew. A later writer's version makes a run without ``base``
    fail with ``Conflict``.
    """
    newest = current_version(spark, root)
    known = read_entry(spark, root, newest if base is None else base)
    since = known.get("upto")
    if since is not None and upto_ms < since:
        raise ValueError(f"sessions under {root} already go up to {since}")
    log = read_lake(spark, lake).filter(F.col("timestamp") < upto_ms)
    if since is not None:
        log = log.filter(F.col("timestamp") >= since).filter(F.col("date_str") >= F.lit(_day(since)))
    log = log.filter(F.col("date_str") <= F.lit(_day(upto_ms)))
    state = _read(spark, sessions.SESSION_STATE, [known["state"]] if known else [])
    folded = sessions.fold_sessions(state, log, items, upto_ms, decay, gap_ms, dim=dim)
    folder = f"{root}/run-{uuid.uuid4().hex}"
    # Sessions are written once: the folders of the ended ones are what a version names.
    folded.write.partitionBy("last", "new_end").parquet(f"{folder}/folded")
    done = spark.read.schema(f"{sessions.SESSION_STATE}, last boolean, new_end boolean").parquet(f"{folder}/folded")
    sessions.next_state(done).write.parquet(f"{folder}/state")
    over = [f"{folder}/folded/last={last}/new_end=true" for last in ("false", "true")]
    over = [path for path in over if commits.listed(spark, path)]
    entry = {
        "upto": upto_ms, "state": f"{folder}/state", "marks": {},
        "ended": [*known.get("ended", []), *over],
    }
    if not commits.commit(spark, log_folder(root), newest + 1, entry):
        raise commits.Conflict(f"{root}: version {newest + 1} came from another writer")
    return newest + 1


def _day(ms: int):
    return datetime.fromtimestamp(ms / 1000, UTC).date()


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Each user's last session; the vector is there while it is open."""
    known = read_entry(spark, root, version)
    return _read(spark, sessions.SESSION_STATE, [known["state"]] if known else [])


def read_sessions(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All sessions up to the version's moment, as `short_term_vectors` gives them in one pass."""
    known = read_entry(spark, root, version)
    ended = _read(spark, _ENDED, known.get("ended", []))
    still = read_state(spark, root, version).filter(~F.col("ended")).drop("ended")
    return ended.unionByName(still)
