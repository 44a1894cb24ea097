"""Play counts: totals, trailing windows, trending songs, incremental counting."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.events import implicit_score, last_days, plays, since_mark
from earshot.operators.merge import merge_inc

COUNTERS = ("plays_7d", "plays_cumulative")


def play_counts(df: DataFrame) -> DataFrame:
    """Plays per track; partial counts are formed before the shuffle."""
    return plays(df).groupBy("track_id").agg(F.count(F.lit(1)).alias("plays"))


def max_ts(df: DataFrame) -> DataFrame:
    return df.agg(F.max("timestamp").alias("last_timestamp"))


def run_stats(df: DataFrame) -> DataFrame:
    """Rows, and distinct users, tracks and user-track pairs."""
    pairs = df.groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    users = pairs.groupBy("user_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")
    )
    tracks = df.select("track_id").distinct().agg(F.count(F.lit(1)).alias("tracks"))
    return users.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("n_pairs"),
        F.count(F.lit(1)).alias("n_users"),
    ).withColumn("n_tracks", tracks.scalar())


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def ratings(df: DataFrame) -> DataFrame:
    """Summed implicit score per user and track."""
    return (
        implicit_score(df)
        .groupBy("user_id", "track_id")
        .agg(F.sum("score").cast("float").alias("rating"))
    )


def trending_7d(lake: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Plays per track over the trailing window (``days`` full days plus the current)."""
    return play_counts(last_days(lake, as_of, days))


def resync_trending(songs: DataFrame, trending: DataFrame) -> DataFrame:
    """Set ``plays_7d`` from the trailing counts; a song without plays gets 0."""
    counts = trending.select(F.col("track_id").alias("_id"), F.col("plays").alias("_plays"))
    fresh = F.coalesce(F.col("_plays"), F.lit(0)).cast("int")
    return (
        songs.join(counts, "_id", "full_outer")
        .withColumn("plays_7d", fresh)
        .select(*songs.columns)
    )


def daily_trailing_plays(df: DataFrame, days: int = 7) -> DataFrame:
    """Per track and day, that day's plays and the trailing sum up to it.

    Events collapse to one row per track and day first, so the window of even the most
    played track holds only as many rows as there are days.
    """
    daily = (
        plays(df)
        .groupBy("track_id", F.col("date_str").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("plays"))
    )
    span = (
        Window.partitionBy("track_id").orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    )
    return daily.withColumn("trailing_plays", F.sum("plays").over(span))


def top_trending(songs: DataFrame, n: int) -> DataFrame:
    """The ``n`` songs most played in the last days; a missing count is 0."""
    return (
        songs.withColumn("plays_7d", F.coalesce(F.col("plays_7d"), F.lit(0)))
        .orderBy(F.desc("plays_7d"), F.asc("_id"))
        .limit(n)
    )


def incremental_counts(lake: DataFrame, mark_ms: int) -> tuple[DataFrame, DataFrame]:
    """``(counts, mark)`` of everything after the mark.

    Only plays are counted, but every action moves the mark. With nothing new both
    come back empty. An event older than the mark that arrives late is not seen; use
    the streaming form when that matters.
    """
    fresh = since_mark(lake, mark_ms)
    mark = max_ts(fresh).filter(F.col("last_timestamp").isNotNull())
    return play_counts(fresh), mark


def add_counts(songs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add fresh play counts to both song counters, creating songs not yet known."""
    deltas = counts.select(
        F.col("track_id").alias("_id"), *[F.col("plays").alias(c) for c in COUNTERS]
    )
    return merge_inc(songs, deltas, "_id", COUNTERS)


