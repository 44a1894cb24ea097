"""Song and user master tables: extraction, cleaning, enrichment, profiles."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import (
    avatar_url,
    new_id,
    nonempty,
    short_username,
    strip_ws,
    truncate,
)
from earshot.functions.time import iso_to_ms
from earshot.schemas import (
    DEFAULT_DURATION,
    ENRICHMENT,
    PLAY_LOG,
    SONG_SUMMARY,
    SONGS,
    USER_SUMMARY,
    USERS,
    conform,
)

# Fixed value: the video every extracted song points to until a real one is known.
PLACEHOLDER_VIDEO = "JfVos4VSpmA"

MIN_CHARS = 50
# The input limit of the sentence model; no default, its callers name it.
MAX_CHARS = 5000


def song_summary(songs: DataFrame) -> DataFrame:
    return songs.select(*SONG_SUMMARY)


def user_summary(users: DataFrame) -> DataFrame:
    return users.select(*USER_SUMMARY)


def list_users(users: DataFrame, n: int) -> DataFrame:
    return user_summary(users).orderBy("_id").limit(n)


def resolve_id(df: DataFrame, *candidates: str) -> DataFrame:
    """Set ``_id`` from the first non-empty candidate column; rows without one drop."""
    have = [c for c in candidates if c in df.columns]
    picked = F.coalesce(*[nonempty(F.col(c)) for c in have])
    rest = [c for c in df.columns if c not in candidates]
    return df.select(picked.alias("_id"), *rest).filter(F.col("_id").isNotNull())


def stamp(df: DataFrame, col: str, as_of: date | datetime) -> DataFrame:
    """Add a run's date or time; always an argument, never the clock."""
    return df.withColumn(col, F.lit(as_of))


def extract_songs(history: DataFrame) -> DataFrame:
    """One song per track id of the listening history, in the song schema.

    Of several spellings the alphabetically first is kept, a missing one last.
    """
    names = ("track_name", "artist_id", "artist_name")
    source = history.select(
        F.col("musicbrainz_track_id").alias("_id"),
        "track_name",
        F.col("musicbrainz_artist_id").alias("artist_id"),
        "artist_name",
    )
    ordered = F.struct(
        *[c for n in names for c in (F.col(n).isNull().alias(f"_no_{n}"), F.col(n).alias(n))]
    )
    songs = source.groupBy("_id").agg(F.min(ordered).alias("s")).select("_id", "s.*")
    return conform(
        songs,
        SONGS,
        image_url=avatar_url(F.col("track_name"), "cover"),
        url=PLACEHOLDER_VIDEO,
        plays_7d=0,
        plays_cumulative=0,
        duration=DEFAULT_DURATION,
    )


def extract_users(logs: DataFrame, as_of: date) -> DataFrame:
    """One new profile per user seen in the logs."""
    ids = logs.select(F.col("user_id").cast("string").alias("_id")).distinct()
    named = ids.withColumn("username", short_username(F.col("_id")))
    picture = avatar_url(F.col("username"), "avatar")
    return conform(named, USERS, signup_date=as_of, image_url=picture)


def new_profiles(names: DataFrame, as_of: date) -> DataFrame:
    """Profiles for entered names: trimmed, non-empty, with a fresh id and no vector.

    The ids are random: write the result once, before anything else reads it.
    """
    entered = names.select(strip_ws(F.col("name")).alias("username"))
    kept = entered.filter(F.col("username") != "")
    return conform(kept, USERS, _id=new_id(), signup_date=as_of)


def attach_duration(history: DataFrame, songs: DataFrame) -> DataFrame:
    """History rows in the play-log schema, with the song's length as both durations.

    Rows of unknown songs and rows whose time cannot be read drop. The join is left to
    the optimizer: a small song table is broadcast by its size, a hot track of a large
    one is split by adaptive execution.
    """
    lengths = songs.select(
        F.col("_id").alias("track_id"),
        F.coalesce(F.col("duration"), F.lit(DEFAULT_DURATION)).alias("_len"),
    )
    rows = history.select(
        F.col("user_id"),
        F.col("musicbrainz_track_id").alias("track_id"),
        iso_to_ms(F.col("timestamp")).alias("timestamp"),
    ).filter(F.col("timestamp").isNotNull())
    return conform(
        rows.join(lengths, "track_id"),
        PLAY_LOG,
        action="complete",
        source="simulation",
        duration=F.col("_len"),
        total_duration=F.col("_len"),
    )


def clean_songs(songs: DataFrame) -> DataFrame:
    """The export form: fallback names, default length, counters as text, no nulls in text."""
    have = set(songs.columns)

    def first_of(*names: str) -> Column:
        found = [nonempty(F.col(n)) for n in names if n in have]
        return F.coalesce(*found, F.lit(""))

    length = F.col("duration").cast("double")
    blank = length.isNull() | (length == 0)
    duration = F.when(blank, F.lit("300")).otherwise(F.col("duration").cast("string"))
    return songs.select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"),
        first_of("track_name", "title").alias("track_name"),
        first_of("artist_name", "artist").alias("artist_name"),
        first_of("artist_id").alias("artist_id"),
        first_of("image_url").alias("image_url"),
        first_of("url").alias("url"),
        F.coalesce(F.col("plays_7d").cast("string"), F.lit("0")).alias("plays_7d"),
        F.coalesce(F.col("plays_cumulative").cast("string"), F.lit("0")).alias(
            "plays_cumulative"
        ),
        duration.alias("duration"),
        F.col("release_date"),
        first_of("lrclib_plain_lyrics").alias("lrclib_plain_lyrics"),
        first_of("lrclib_synced_lyrics").alias("lrclib_synced_lyrics"),
    )


def with_lyrics(songs: DataFrame) -> DataFrame:
    return songs.filter(F.col("lrclib_plain_lyrics") != "")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def missing_lyrics(songs: DataFrame) -> DataFrame:
    """Songs that were looked up and have no lyrics."""
    none = F.coalesce(F.col("lrclib_plain_lyrics"), F.lit("")) == ""
    return songs.filter(_flag("lrclib_fetched") & (_flag("lrclib_not_found") | none))


def enrichment_pending(songs: DataFrame, cap: int | None = None) -> DataFrame:
    """Songs still to be looked up, most played first, at most ``cap`` of them."""
    todo = songs.filter(~_flag("lrclib_fetched") | ~_flag("release_date_checked"))
    plays = F.coalesce(F.col("plays_cumulative"), F.lit(0))
    ordered = todo.orderBy(plays.desc(), F.col("_id").asc())
    return ordered if cap is None else ordered.limit(cap)


def gate_text(
    df: DataFrame, col: str, min_chars: int = MIN_CHARS, max_chars: int | None = None
) -> DataFrame:
    """Keep texts of at least ``min_chars`` characters without outer white space.

    ``max_chars`` is the input limit of the model that reads the text; None keeps whole
    texts. The cut counts from the unstripped start.
    """
    kept = df.filter(F.length(strip_ws(F.col(col))) >= min_chars)
    if max_chars is None:
        return kept
    return kept.withColumn(col, truncate(F.col(col), max_chars))


def merge_lyrics(songs: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enter look-up results into the songs; returns ``(songs, report)``.

    ``fetched`` holds ranked results per song, or one row with nulls when there were
    none. The first result counts; without plain lyrics the song is marked not found and
    nothing else of it changes.
    """
    result = F.struct("plain_lyrics", "synced_lyrics", "lrclib_id", "duration", "release_date")
    ranked = F.struct(F.coalesce(F.col("rank"), F.lit(0)).alias("o"), result.alias("r"))
    best = (
        fetched.groupBy("_id")
        .agg(F.min(ranked).alias("b"))
        .select("_id", F.col("b.r").alias("r"))
        .withColumn("_found", F.coalesce(F.col("r.plain_lyrics"), F.lit("")) != "")
    )
    length = F.coalesce(F.nullif(F.col("r.duration"), F.lit(0.0)), F.lit(DEFAULT_DURATION))
    when_found = {
        "lrclib_id": F.col("r.lrclib_id"),
        "lrclib_plain_lyrics": F.col("r.plain_lyrics"),
        "lrclib_synced_lyrics": F.col("r.synced_lyrics"),
        "duration": length,
        "release_date": F.col("r.release_date"),
        "release_date_checked": F.lit(True),
    }
    kinds = {f.name: f.dataType for f in [*songs.schema.fields, *ENRICHMENT.fields]}
    looked_up, found = F.col("_found").isNotNull(), F.col("_found")
    out = []
    for name, kind in kinds.items():
        old = F.col(name) if name in songs.columns else F.lit(None).cast(kind)
        if name == "lrclib_fetched":
            col = F.when(looked_up, True).otherwise(old)
        elif name == "lrclib_not_found":
            col = F.when(looked_up, ~found).otherwise(old)
        elif name in when_found:
            col = F.when(found, when_found[name].cast(kind)).otherwise(old)
        else:
            col = old
        out.append(col.alias(name))
    merged = songs.join(best, "_id", "left").select(*out)
    return merged, enrichment_report(best.select(F.col("_found").alias("found")))


def enrichment_report(outcomes: DataFrame) -> DataFrame:
    """Found, not found and success rate in percent of ``outcomes(found)``."""
    found = F.count_if(F.col("found"))
    total = F.count(F.col("found"))
    rate = F.round(F.try_divide(found * F.lit(100.0), total), 1)
    return outcomes.agg(
        total.alias("processed"),
        found.alias("found"),
        (total - found).alias("not_found"),
        rate.alias("success_rate"),
    )
