"""Play events: parsing, validation, windows of days, scores, replay and rebasing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.scores import action_score, play_class
from earshot.functions.text import nonempty
from earshot.functions.time import event_date, event_time
from earshot.schemas import ACTIONS, DEFAULT_DURATION, PLAY_ACTIONS, PLAY_LOG, SOURCES

LAG_60_DAYS_MS = 5_184_000_000


def parse_events(df: DataFrame, payload: str = "value") -> DataFrame:
    """Turn JSON payloads into event columns; the raw payload stays for quarantine.

    Fields are read as text, so that a badly typed one can be reported, not lost.
    """
    fields = ", ".join(f"`{f.name}` string" for f in PLAY_LOG.fields) + ", _malformed string"
    raw = F.col(payload).cast("string")
    parsed = F.from_json(raw, fields, {"columnNameOfCorruptRecord": "_malformed"})
    # As a generator the parser runs once per payload, not once per field that is read.
    events = df.select(raw.alias("payload"), F.inline_outer(F.array(parsed)))
    return events.withColumn("_malformed", F.col("_malformed").isNotNull())


def encode_events(df: DataFrame) -> DataFrame:
    """One JSON payload per event; durations are whole seconds on the wire."""
    whole = {c: F.col(c).cast("bigint") for c in ("duration", "total_duration")}
    cols = [whole.get(f.name, F.col(f.name)).alias(f.name) for f in PLAY_LOG.fields]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def check_events(df: DataFrame, arrival_ms: int | Column) -> DataFrame:
    """Parsed events with typed fields, defaults, and the ``reason`` of those to reject."""
    if "_malformed" not in df.columns:
        df = df.withColumn("_malformed", F.lit(False))
    arrival = arrival_ms if isinstance(arrival_ms, Column) else F.lit(arrival_ms)
    stamp = F.col("timestamp").try_cast("bigint")

    def seconds(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("int"), F.lit(0)).cast("double")

    def unreadable(name: str) -> Column:
        return F.col(name).isNotNull() & F.col(name).try_cast("int").isNull()

    reason = (
        F.when(F.col("_malformed"), "malformed")
        .when(F.col("user_id").isNull(), "user_id missing")
        .when(F.col("track_id").isNull(), "track_id missing")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action unknown")
        .when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "source unknown")
        .when(unreadable("duration"), "duration unreadable")
        .when(unreadable("total_duration"), "total_duration unreadable")
        .when(F.col("timestamp").isNotNull() & stamp.isNull(), "timestamp unreadable")
    )
    return df.withColumns(
        {
            "reason": reason,
            "user_id": F.col("user_id").cast("string"),
            "track_id": F.col("track_id").cast("string"),
            "timestamp": F.coalesce(F.nullif(stamp, F.lit(0).cast("bigint")), arrival).cast("bigint"),
            "duration": seconds("duration"),
            "total_duration": seconds("total_duration"),
        }
    )


def validate_events(df: DataFrame, arrival_ms: int | Column) -> tuple[DataFrame, DataFrame]:
    """Split events into ``(valid, rejected)``; rejected rows carry a ``reason``.

    Ids are required, action and source must be known, durations are whole seconds
    with default 0, and a timestamp that is missing or 0 becomes the arrival time.
    """
    checked = check_events(df, arrival_ms).drop("_malformed")
    valid = checked.filter(F.col("reason").isNull()).select(*PLAY_LOG.fieldNames())
    return valid, checked.filter(F.col("reason").isNotNull())


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "event_time": event_time(F.col("timestamp")),
            "date_str": event_date(F.col("timestamp")),
        }
    )


def plays(df: DataFrame) -> DataFrame:
    return df.filter(F.col("action").isin(*PLAY_ACTIONS))


def last_days(df: DataFrame, as_of: date, days: int, until: date | None = None) -> DataFrame:
    """Rows dated in the ``days`` full days before ``as_of`` and on any later day.

    The comparison is against a date literal, so it prunes lake partitions. ``until``
    closes the window for a rerun over a past date.
    """
    day = F.col("date_str").cast("date")
    kept = df.filter(day >= F.date_sub(F.lit(as_of), days))
    return kept if until is None else kept.filter(day <= F.lit(until))


def since_mark(df: DataFrame, mark_ms: int) -> DataFrame:
    """Rows strictly newer than the high-water mark; also prunes older partitions."""
    first_day = event_date(F.lit(mark_ms).cast("bigint")).cast("date")
    return df.filter(F.col("date_str").cast("date") >= first_day).filter(
        F.col("timestamp") > mark_ms
    )


def implicit_score(df: DataFrame) -> DataFrame:
    """Add ``score`` and keep the events that count."""
    return df.withColumn("score", action_score(F.col("action"))).filter(F.col("score") > 0)


def classify_play(df: DataFrame) -> DataFrame:
    """Finished plays (``seconds, total, ended``) to event actions; too short ones drop."""
    seconds, total = F.col("seconds"), F.col("total")
    return (
        df.withColumn("action", play_class(seconds, total, F.col("ended")))
        .filter(F.col("action").isNotNull())
        .withColumns(
            {
                "duration": F.floor(seconds).cast("bigint"),
                "total_duration": F.floor(total).cast("bigint"),
            }
        )
    )


def rebase_time(df: DataFrame, as_of_ms: int, lag_ms: int = LAG_60_DAYS_MS) -> DataFrame:
    """Shift history so that its first event lands at ``as_of_ms - lag_ms``, gaps kept."""
    first = df.agg(F.min("timestamp")).scalar()
    return df.withColumn("timestamp", F.col("timestamp") + F.lit(as_of_ms - lag_ms) - first)


def replay_events(df: DataFrame) -> DataFrame:
    """Fill what a stored event may lack before it is sent again."""
    have = set(df.columns)

    def or_default(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    def whole(name: str) -> Column:
        return or_default(name, DEFAULT_DURATION).cast("bigint")

    return df.select(
        nonempty(F.col("user_id")).alias("user_id"),
        nonempty(F.col("track_id")).alias("track_id"),
        F.col("timestamp"),
        or_default("action", "complete").alias("action"),
        or_default("source", "simulation").alias("source"),
        whole("duration").alias("duration"),
        whole("total_duration").alias("total_duration"),
    ).filter(F.col("user_id").isNotNull() & F.col("track_id").isNotNull())
