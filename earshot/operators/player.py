"""Listening time of a play, from its play / pause / reset / snapshot events.

A play event opens the timer at its own time; a second one moves the opening, so the
span before it is lost. A pause adds the open span and closes. A reset clears both. A
snapshot only reads the timer, including the open span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators import slices

KEY = "play_id"
QUALIFIED_SECONDS = 30


def _spans(events: DataFrame, slice_ms: int) -> DataFrame:
    """Transitions with the time the timer's current state ends, per play and slice.

    ``_until`` is the next transition, or for the last one the snapshot that reads it.
    ``_closed`` is the span a play event adds to the total.
    """
    rank = F.when(F.col("kind") == "reset", 0).when(F.col("kind") == "pause", 1).otherwise(2)
    # The same event at the same moment again changes nothing.
    once = events.select(KEY, "ts_ms", "kind").distinct()
    rows = slices.with_slice(once, "ts_ms", slice_ms)
    rows = rows.withColumn("_rank", rank)
    moves = F.col("kind") != "snapshot"
    step = F.struct("ts_ms", "_rank", "kind")
    summary = slices.summarise(
        rows,
        KEY,
        {
            "_first": F.min(F.when(moves, step)),
            "_seen": F.max(F.when(~moves, F.col("ts_ms"))),
            "_cleared": F.max(F.when(F.col("kind") == "reset", F.col("ts_ms"))),
        },
    )
    order = slices.by_slice(KEY)
    whole = slices.all_slices(KEY)
    summary = summary.select(
        KEY,
        "_slice",
        F.first("_first", ignorenulls=True).over(slices.after(order)).alias("_after"),
        F.max("_seen").over(whole).alias("_seen"),
        F.max("_cleared").over(whole).alias("_cleared"),
    )
    here = slices.in_slice(KEY, "ts_ms", "_rank")
    following = F.coalesce(F.lead(step).over(here), F.col("_after"))
    read = F.when(F.col("_seen") >= F.col("ts_ms"), F.col("_seen"))
    is_play = F.col("kind") == "play"
    adds = is_play & (F.col("_next").isNull() | (F.col("_next.kind") == "pause"))
    return (
        slices.attach(rows.filter(moves), summary, KEY, ["_after", "_seen", "_cleared"])
        .withColumn("_next", following)
        .withColumn("_until", F.coalesce(F.col("_next.ts_ms"), read))
        .withColumn(
            "_closed",
            F.when(adds, F.coalesce(F.col("_until") - F.col("ts_ms"), F.lit(0))).otherwise(
                F.lit(0)
            ),
        )
    )


def listen_time(events: DataFrame, slice_ms: int = slices.SLICE_MS) -> DataFrame:
    """Milliseconds on the timer after each play's last event."""
    spans = _spans(events, slice_ms)
    counts = F.col("_cleared").isNull() | (F.col("ts_ms") >= F.col("_cleared"))
    timed = spans.groupBy(KEY).agg(
        F.sum(F.when(counts, F.col("_closed")).otherwise(F.lit(0))).alias("listen_ms")
    )
    silent = events.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_events"))
    return silent.join(timed, KEY, "left").select(
        KEY, "n_events", F.coalesce(F.col("listen_ms"), F.lit(0)).cast("bigint").alias("listen_ms")
    )


def qualified_listens(
    events: DataFrame, seconds: float = QUALIFIED_SECONDS, slice_ms: int = slices.SLICE_MS
) -> DataFrame:
    """The first moment each play's timer reaches ``seconds``; at most one per play.

    The timer before a row is the sum of closed spans since the last reset. Both the
    running sum and its value at the last reset only grow, so each carries over from
    slice to slice as one number.
    """
    limit = int(seconds * 1000)
    spans = _spans(events, slice_ms)
    here = slices.in_slice(KEY, "ts_ms", "_rank")
    inside = F.coalesce(F.sum("_closed").over(slices.before(here)), F.lit(0))
    rows = spans.withColumn("_inside", inside).withColumn(
        "_reset_inside",
        F.max(F.when(F.col("kind") == "reset", F.col("_inside"))).over(slices.upto(here)),
    )
    summary = slices.summarise(
        rows, KEY, {"_sum": F.sum("_closed"), "_reset": F.max("_reset_inside")}
    )
    order = slices.by_slice(KEY)
    summary = summary.withColumn(
        "_before", F.coalesce(F.sum("_sum").over(slices.before(order)), F.lit(0))
    ).withColumn(
        "_reset_before",
        F.coalesce(
            F.max(F.col("_before") + F.col("_reset")).over(slices.before(order)), F.lit(0)
        ),
    )
    cleared = F.greatest(
        F.col("_reset_before"),
        F.coalesce(F.col("_before") + F.col("_reset_inside"), F.lit(0)),
    )
    timer = F.col("_before") + F.col("_inside") - cleared
    reached = (F.col("kind") == "play") & (
        timer + F.col("_until") - F.col("ts_ms") >= limit
    )
    moment = F.col("ts_ms") + F.greatest(F.lit(limit) - timer, F.lit(0))
    return (
        slices.attach(rows, summary, KEY, ["_before", "_reset_before"])
        .filter(reached)
        .groupBy(KEY)
        .agg(F.min(moment).cast("bigint").alias("qualified_ms"))
    )
