"""The named jobs. Dates, seeds and paths are arguments; nothing reads the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from earshot.operators.catalogue import (
    attach_duration,
    clean_songs,
    extract_users,
    missing_lyrics,
)
from earshot.operators.content import Encoder, HashingEncoder, embed_text
from earshot.operators.counts import (
    add_counts,
    incremental_counts,
    resync_trending,
    trending_7d,
)
from earshot.operators.feed import (
    FEED,
    PLAYLIST,
    feed_state,
    hand_out,
    home_feed,
    mark_served,
    next_songs,
    refills,
)
from earshot.operators.merge import cascade_delete, merge_set, profile_table
from earshot.operators.ranking import hydrate, topk_per
from earshot.operators.search import Postings, search_songs
from earshot.operators.training import (
    Params,
    Trained,
    export_item_factors,
    export_user_factors,
    train,
)
from earshot.schemas import CONTENT_DIM, SONG_SUMMARY
from earshot.session import cut
from earshot.sources.keyed import is_keyed, read_keyed, update_keyed
from earshot.sources.lake import sort_history
from earshot.sources.master import SONG_IDS, read_master_jsonl
from earshot.sources.tables import (
    TRIES,
    Conflict,
    append_delta,
    append_vectors,
    current_version,
    delta_mark,
    publish,
    read_deltas,
    read_marks,
    read_table,
    update,
    write_vectors,
)
from earshot.streaming.counts import read_counts
from earshot.streaming.ingest import ingest_stream, read_event_stream

INCREMENTAL_JOB, STREAM_JOB = "incremental_counts", "stream_counts"


def prepare_history(
    raw: DataFrame, songs: DataFrame, as_of: date
) -> tuple[DataFrame, DataFrame]:
    """``(play log in time order, new user profiles)`` of raw listening history."""
    log = attach_duration(raw, songs)
    return sort_history(log), extract_users(log, as_of)


def sync_master(
    target: DataFrame,
    jsonl_path: str,
    schema: StructType,
    ids: tuple[str, ...] = SONG_IDS,
    skip_null: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(table, profile, rejected)`` after loading a JSON-lines file into ``target``.

    ``skip_null`` names columns a null must not clear, such as trained vectors.
    """
    good, rejected = read_master_jsonl(target.sparkSession, jsonl_path, schema, ids)
    cols = [f for f in schema.fieldNames() if f != "_id"]
    table = merge_set(target, good, "_id", cols, skip_null)
    return table, profile_table(table), rejected


def run_ingest(
    spark: SparkSession,
    src: dict[str, str],
    path: str,
    quarantine: str,
    ckpt: str,
    fmt: str = "kafka",
    trigger: dict | None = None,
) -> StreamingQuery:
    payloads = read_event_stream(spark, fmt, **src)
    return ingest_stream(payloads, path, quarantine, ckpt, trigger)


def run_incremental(lake: DataFrame, counts_root: str) -> int | None:
    """Keep the play counts of everything after the mark; returns the new mark.

    Counts and mark are committed by one log row, so a run that dies counts nothing and its
    repetition counts once. The song table is not rewritten: `song_counters` adds the deltas when
    it is read, `fold_counts` now and then.
    """
    spark = lake.sparkSession
    mark = delta_mark(spark, counts_root, INCREMENTAL_JOB)
    _, newest = incremental_counts(lake, mark)
    found = newest.first()
    if found is None:
        return None
    # Fix the end of the range, so that events landing meanwhile wait for the next run.
    end = found["last_timestamp"]
    counts, _ = incremental_counts(lake.filter(F.col("timestamp") <= end), mark)
    append_delta(counts, counts_root, INCREMENTAL_JOB, mark, end)
    return end


def song_counters(spark: SparkSession, songs_root: str, counts_root: str) -> DataFrame:
    """The song table with all counts that it does not hold yet."""
    songs = read_table(spark, songs_root)
    folded = read_marks(spark, songs_root).get(INCREMENTAL_JOB, 0)
    deltas = read_deltas(spark, counts_root, INCREMENTAL_JOB, folded)
    return songs if deltas is None else add_counts(songs, deltas)


def fold_counts(spark: SparkSession, songs_root: str, counts_root: str) -> int:
    """Publish the song table with the kept counts added; the version says how far it goes.

    If another writer comes first, its version is read again, with its marks.
    """
    for _ in range(TRIES):
        base = current_version(spark, songs_root)
        folded = read_marks(spark, songs_root, base).get(INCREMENTAL_JOB, 0)
        deltas = read_deltas(spark, counts_root, INCREMENTAL_JOB, folded)
        end = delta_mark(spark, counts_root, INCREMENTAL_JOB)
        try:
            return _fold(spark, songs_root, base, deltas, {INCREMENTAL_JOB: end})
        except Conflict:
            continue
    raise Conflict(songs_root)


def fold_stream_counts(spark: SparkSession, songs_root: str, deltas: str, upto: int) -> int:
    """Publish the song table with the stream's batches up to ``upto`` added, each once."""
    for _ in range(TRIES):
        base = current_version(spark, songs_root)
        done = read_marks(spark, songs_root, base).get(STREAM_JOB, -1)
        counts = read_counts(spark, deltas, done, upto)
        try:
            return _fold(spark, songs_root, base, counts, {STREAM_JOB: max(done, upto)})
        except Conflict:
            continue
    raise Conflict(songs_root)


def _fold(
    spark: SparkSession, root: str, base: int, counts: DataFrame | None, marks: dict[str, int]
) -> int:
    """Add counts to version ``base``: of a keyed table only to the buckets that they hit."""
    if is_keyed(spark, root, base):
        deltas = spark.createDataFrame([], "track_id string, plays long") if counts is None else counts
        deltas = deltas.withColumn("_id", F.col("track_id"))
        return update_keyed(deltas, root, add_counts, marks, base)
    songs = read_table(spark, root, base)
    return publish(songs if counts is None else add_counts(songs, counts), root, marks=marks, base=base)


def resync_keyed(trending: DataFrame, songs_root: str) -> int:
    """Set ``plays_7d`` of a keyed song table from the trailing counts; as `resync_trending`, but only
    the buckets with a song whose count differs are rewritten."""
    spark = trending.sparkSession
    now = trending.select(F.col("track_id").alias("_id"), F.col("plays").cast("int").alias("_plays"))
    held = read_keyed(spark, songs_root).select("_id", F.col("plays_7d").alias("_old"), F.lit(1).alias("_had"))
    both = held.join(now, "_id", "full_outer")
    plays = F.coalesce("_plays", F.lit(0))
    differs = F.col("_had").isNull() | ~F.col("_old").eqNullSafe(plays)
    changes = both.filter(differs).select("_id", plays.alias("plays_7d"))
    return update_keyed(changes, songs_root, lambda rows, new: merge_set(rows, new, "_id", ["plays_7d"]))


@dataclass(frozen=True)
class Roots:
    """Where the published tables live."""

    songs: str
    users: str
    item_vectors: str
    content_vectors: str


def run_nightly(
    lake: DataFrame,
    roots: Roots,
    as_of: datetime,
    params: Params = Params(),
    seed: int = 0,
    blocks: int | None = None,
    trending: DataFrame | None = None,
) -> Trained:
    """Reset the trailing counts, then train and publish all vectors.

    The counts are ``trending`` (as `day_counts.read_trailing` keeps them) or are taken from the lake.
    """
    spark = lake.sparkSession
    day = as_of.date()
    trending = trending_7d(lake, day) if trending is None else trending
    if is_keyed(spark, roots.songs):
        resync_keyed(trending, roots.songs)
    else:
        update(spark, roots.songs, lambda songs: resync_trending(songs, trending))
    trained = train(lake, day, params, seed, blocks=blocks)
    users = export_user_factors(trained, read_table(spark, roots.users), as_of)
    publish(users, roots.users)
    write_vectors(export_item_factors(trained), roots.item_vectors, params.rank)
    return trained


def build_content(
    songs: DataFrame,
    vectors: DataFrame,
    encoder: Encoder = HashingEncoder(),
    dim: int = CONTENT_DIM,
) -> DataFrame:
    """The content-vector table with the songs added that had none; all are ``dim`` long."""
    return append_vectors(embed_text(songs, vectors, encoder), vectors, dim)


def clean_catalogue(
    songs: DataFrame, items: DataFrame, content: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(songs, items, content, export)`` without songs whose lyrics were not found."""
    gone = missing_lyrics(songs).select("_id")
    kept, kept_items, kept_content = cascade_delete(
        gone, (songs, "_id"), (items, "id"), (content, "id")
    )
    return kept, kept_items, kept_content, clean_songs(kept)


@dataclass(frozen=True)
class Tables:
    """What serving reads."""

    songs: DataFrame
    items: DataFrame
    content: DataFrame
    vectors: DataFrame
    feed_served: DataFrame
    playlist_served: DataFrame
    postings: Postings


@dataclass(frozen=True)
class Served:
    """Answers to a table of requests, and the session tables afterwards."""

    feeds: DataFrame
    following: DataFrame
    found: DataFrame
    feed_served: DataFrame
    playlist_served: DataFrame


def serve_batch(
    requests: DataFrame, tables: Tables, limit: int, seed: int, now_ms: int
) -> Served:
    """Answer every request: feed pages, next-song pages and search pages, with song data.

    ``requests(query_id, kind, user_id, current_song_id, text)`` with kind feed, next or
    search. Queues that run low are refilled first, by quota; then each feed and next request is
    handed the next ``limit`` ids of its user's queue. ``feed_served`` and ``playlist_served``
    hold ``(user_id, id, position, queued, served_at)`` of the live sessions, before and after. A
    user's playlist is refilled for the first of their requests in the batch.
    """
    requests, vectors = cut(requests), cut(tables.vectors)
    songs = cut(tables.songs.select(*dict.fromkeys([*SONG_SUMMARY, "plays_7d"])))
    feeds = requests.filter(F.col("kind") == "feed").select("query_id", "user_id")
    served, others = _of_users(tables.feed_served, feeds)
    wanted = refills(feeds.select("user_id").distinct(), feed_state(served), FEED)
    fresh = home_feed(wanted, vectors, tables.items, songs, served, seed)
    state = cut(mark_served(served, fresh, now_ms))
    shown, feed_after = hand_out(state, feeds, songs, limit, FEED)
    feed_after = feed_after.unionByName(_without_new(others, now_ms))

    plays = requests.filter(F.col("kind") == "next")
    first = topk_per(
        plays.select("query_id", "user_id", "current_song_id"), ["user_id"], [F.asc("query_id")], 1
    ).drop("rank")
    served, others = _of_users(tables.playlist_served, plays)
    room = refills(first.select("user_id"), feed_state(served), PLAYLIST)
    after = next_songs(
        first.join(room, "user_id"),
        vectors,
        tables.items,
        tables.content,
        songs,
        served,
        seed,
    )
    batch = after.join(first.select("query_id", "user_id"), "query_id")
    state = cut(mark_served(served, batch.select("user_id", "id", "rank"), now_ms))
    asks = plays.select("query_id", "user_id")
    following, playlist_after = hand_out(state, asks, songs, limit, PLAYLIST)
    playlist_after = playlist_after.unionByName(_without_new(others, now_ms))

    texts = requests.filter(F.col("kind") == "search").select("query_id", "text")
    found = search_songs(tables.postings, texts, limit)
    return Served(shown, following, hydrate(found, songs), feed_after, playlist_after)


def _of_users(served: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The session table of those who ask, which is worked on, and that of all others."""
    users = asks.select("user_id").distinct()
    return cut(served.join(users, "user_id", "left_semi")), served.join(users, "user_id", "left_anti")


def _without_new(served: DataFrame, now_ms: int) -> DataFrame:
    """Queues that get nothing, as they are after a batch."""
    none = served.select("user_id", "id", F.lit(0).alias("rank")).limit(0)
    return mark_served(served, none, now_ms)
