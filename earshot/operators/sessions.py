"""Listening sessions and the short-term taste vector of each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.time import HOUR_MS
from earshot.functions.vector import vec_blend_guard
from earshot.operators import slices
from earshot.schemas import ITEM_DIM

SESSION_GAP_MS = HOUR_MS
DECAY = 0.7
WEIGHT_LONG = 0.7
SESSION_STATE = (
    "user_id string, session_no bigint, last_ts bigint, n_plays bigint, vector array<double>, ended boolean"
)


def _session_slices(
    plays: DataFrame, gap_ms: int, slice_ms: int | None, kept: DataFrame | None = None
) -> tuple:
    """Rows with their slice, and per user and slice the session it belongs to.

    Slices are no wider than the gap, so a session never breaks inside one: breaks show
    between consecutive slices, in the summary. With ``kept(user_id, session_no, last_ts)``, each
    user's last session so far, numbers go on from it and ``_goes_on`` marks the session itself.
    """
    width = min(gap_ms, slices.SLICE_MS) if slice_ms is None else slice_ms
    if width > gap_ms:
        raise ValueError("slice_ms must not exceed gap_ms")
    rows = slices.with_slice(plays, "timestamp", width)
    summary = slices.summarise(
        rows,
        "user_id",
        {
            "_first": F.min("timestamp"),
            "_last": F.max("timestamp"),
            "_n": F.sum("_times") if "_times" in plays.columns else F.count(F.lit(1)),
        },
    )
    order = slices.by_slice("user_id")
    earlier, number = F.lag("_last").over(order), F.lit(0)
    if kept is not None:
        known = kept.select("user_id", F.col("session_no").alias("_no"), F.col("last_ts").alias("_kept"))
        summary = summary.join(known, "user_id", "left")
        earlier, number = F.coalesce(earlier, "_kept"), F.coalesce("_no", F.lit(0))
    quiet = F.col("_first") - earlier
    starts = F.when(quiet.isNull() | (quiet >= gap_ms), 1).otherwise(0)
    summary = summary.withColumn("_starts", starts).withColumn(
        "session_no", number + F.sum("_starts").over(slices.upto(order))
    )
    goes_on = F.lit(False) if kept is None else F.coalesce(F.col("session_no") == F.col("_no"), F.lit(False))
    return rows, summary.withColumn("_goes_on", goes_on)


def sessionize(
    plays: DataFrame, gap_ms: int = SESSION_GAP_MS, slice_ms: int | None = None
) -> DataFrame:
    """Number each user's sessions: a pause of at least ``gap_ms`` starts a new one."""
    rows, summary = _session_slices(plays, gap_ms, slice_ms)
    return slices.attach(rows, summary, "user_id", ["session_no"]).drop("_slice")


def ema_weight(n: Column, k: Column, times: Column, decay: float, begins: Column | bool = True) -> Column:
    """Weight of the ``k``-th to ``k + times - 1``-th of ``n`` plays in a moving average: a geometric
    sum, and more for the first where it ``begins`` the average."""
    run = F.pow(F.lit(decay), n - k - times + 1) * (1 - F.pow(F.lit(decay), times))
    first = (k == 1) & (begins if isinstance(begins, Column) else F.lit(begins))
    return run + F.when(first, F.pow(F.lit(decay), n)).otherwise(0.0)


def play_weights(
    plays: DataFrame,
    decay: float = DECAY,
    gap_ms: int = SESSION_GAP_MS,
    slice_ms: int | None = None,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Total moving-average weight per user, session and track, with the last play time.

    A session that goes on from ``kept`` has the weights of its new plays only. A play's weight depends on how many plays of its session follow it: those in its own
    slice, counted there, plus those in later slices, summed in the summary. Plays of one song at
    one moment are one row from the start, however often an import repeats them.
    """
    plays = plays.groupBy("user_id", "timestamp", "track_id").agg(F.count(F.lit(1)).alias("_times"))
    rows, summary = _session_slices(plays, gap_ms, slice_ms, kept)
    session = slices.by_slice("user_id", "session_no")
    earlier = F.coalesce(F.sum("_n").over(slices.before(session)), F.lit(0))
    whole = slices.all_slices("user_id", "session_no")
    summary = summary.withColumns(
        {
            "_earlier": earlier,
            "_size": F.sum("_n").over(whole),
            "_ended": F.max("_last").over(whole),
        }
    )
    rows = slices.attach(rows, summary, "user_id", ["session_no", "_earlier", "_size", "_ended", "_goes_on"])
    here = slices.in_slice("user_id", "timestamp", "track_id")
    before = F.coalesce(F.sum("_times").over(slices.before(here)), F.lit(0))
    position = F.col("_earlier") + before + 1
    weight = ema_weight(F.col("_size"), position, F.col("_times"), decay, ~F.col("_goes_on"))
    return (
        rows.withColumn("_w", weight)
        .groupBy("user_id", "session_no", "track_id")
        .agg(
            F.sum("_w").alias("weight"),
            F.max("_ended").alias("last_ts"),
            F.max("_size").alias("n_plays"),
        )
    )


def short_term_vectors(
    plays: DataFrame,
    items: DataFrame,
    decay: float = DECAY,
    gap_ms: int = SESSION_GAP_MS,
    slice_ms: int | None = None,
    alive_at_ms: int | None = None,
    dim: int | None = None,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Moving average of the vectors of the songs played, per user and session.

    The first play sets the vector, each later one moves it by ``1 - decay``. Plays of
    songs without a vector count for nothing, not even to keep a session alive. The
    average is a weighted sum, one partial sum per component: no user's plays are
    gathered as a list. With ``alive_at_ms`` only the sessions whose last play is younger
    than ``gap_ms`` then are computed. The vectors are ``dim`` long, by default as long as the
    table's first; one of another length fails the job. ``kept`` is what `fold_sessions` hands over.
    """
    if dim is None:
        first = items.select(F.size("embedding").alias("n")).first()
        dim = first["n"] if first else ITEM_DIM
    ids = items.select(F.col("id").alias("track_id"))
    known = plays.select("user_id", "track_id", "timestamp").join(ids, "track_id", "left_semi")
    weights = play_weights(known, decay, gap_ms, slice_ms, kept)
    if alive_at_ms is not None:
        age = F.lit(alive_at_ms) - F.col("last_ts")
        weights = weights.filter((age >= 0) & (age < gap_ms))
    wrong = F.raise_error(F.lit(f"vector not of length {dim}")).cast(items.schema["embedding"].dataType)
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong)
    vectors = items.select(F.col("id").alias("track_id"), checked.alias("_v"))
    parts = [F.expr(f"sum(weight * get(_v, {i})) AS _{i}") for i in range(dim)]
    return (
        weights.join(vectors, "track_id")
        .groupBy("user_id", "session_no")
        .agg(*parts, F.max("last_ts").alias("last_ts"), F.max("n_plays").alias("n_plays"))
        .select(
            "user_id",
            "session_no",
            "last_ts",
            "n_plays",
            F.array(*[f"_{i}" for i in range(dim)]).alias("vector"),
        )
    )


def fold_sessions(
    state: DataFrame,
    plays: DataFrame,
    items: DataFrame,
    upto_ms: int,
    decay: float = DECAY,
    gap_ms: int = SESSION_GAP_MS,
    slice_ms: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Sessions after some more plays: what they were, moved on by the plays alone.

    ``state`` has one row per user, the last session (columns of ``SESSION_STATE``); ``plays`` are
    those from the moment up to which the state goes, before ``upto_ms``. Returns the rows of
    ``state`` and of all sessions begun since: ``last`` marks a user's newest, which is the next
    state, ``ended`` a session that no later play can join, ``new_end`` one that was open before.
    An average is linear in its past, so a session that goes on is its old vector, faded once for
    each new play, plus the weighted sum of these.
    """
    fresh = short_term_vectors(plays, items, decay, gap_ms, slice_ms, dim=dim, kept=state)
    old = state.select(
        "user_id", "session_no", F.col("last_ts").alias("_ts"), F.col("n_plays").alias("_n"),
        F.col("vector").alias("_v"), F.col("ended").alias("_over"),
    )
    both = fresh.withColumnRenamed("n_plays", "_new").join(old, ["user_id", "session_no"], "full_outer")
    fade = F.pow(F.lit(decay), F.coalesce("_new", F.lit(0)))
    moved = F.zip_with("_v", "vector", lambda was, more: was * fade + more)
    vector = F.when(F.col("_v").isNotNull() & F.col("vector").isNotNull(), moved)
    merged = both.select(
        "user_id", "session_no",
        F.greatest("last_ts", "_ts").alias("last_ts"),
        (F.coalesce("_new", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_plays"),
        vector.otherwise(F.coalesce("vector", "_v")).alias("vector"),
        F.coalesce("_over", F.lit(False)).alias("_over"),
    )
    # A row per session of the stretch; a user has at most one per gap.
    newest = F.max("session_no").over(Window.partitionBy("user_id"))
    last = F.col("session_no") == newest
    ended = ~last | (F.col("last_ts") + gap_ms <= upto_ms)
    return merged.withColumns(
        {"last": last, "ended": ended, "new_end": ended & ~F.col("_over")}
    ).drop("_over")


def next_state(folded: DataFrame) -> DataFrame:
    """Each user's last session; one that has ended keeps its number and time, not its vector."""
    vector = F.when(~F.col("ended"), F.col("vector")).alias("vector")
    return folded.filter("last").select("user_id", "session_no", "last_ts", "n_plays", vector, "ended")


def active_short_term(
    plays: DataFrame,
    items: DataFrame,
    as_of_ms: int,
    decay: float = DECAY,
    ttl_ms: int = SESSION_GAP_MS,
    dim: int | None = None,
) -> DataFrame:
    """Each user's short-term vector at a moment, if they have one that is still alive."""
    past = plays.filter(F.col("timestamp") <= as_of_ms)
    alive = short_term_vectors(past, items, decay, ttl_ms, alive_at_ms=as_of_ms, dim=dim)
    return alive.select("user_id", F.col("vector").alias("short_vector"))


def session_vectors(
    long: DataFrame, short: DataFrame, weight_long: float = WEIGHT_LONG
) -> DataFrame:
    """One search vector per user from ``long_vector`` and ``short_vector``.

    ``has_long`` tells whether a long-term vector took part; users with neither vector
    are in no input and so in no output.
    """
    both = long.select("user_id", "long_vector").join(
        short.select("user_id", "short_vector"), "user_id", "full_outer"
    )
    blended = vec_blend_guard(F.col("long_vector"), F.col("short_vector"), weight_long)
    return both.select(
        "user_id",
        F.col("long_vector").isNotNull().alias("has_long"),
        blended.alias("vector"),
    ).filter(F.col("vector").isNotNull())
