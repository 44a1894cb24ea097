"""One callable per operator: ``(spark, sf_dir) -> DataFrame`` over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from earshot import schemas
from earshot.functions import text, time, vector
from earshot.operators import (
    approx,
    catalogue,
    content,
    counts,
    events,
    feed,
    half_step,
    indexing,
    merge,
    player,
    ranking,
    search,
    sessions,
    topk,
    training,
)
from earshot.plans import jobs
from earshot.session import cut, ensure_checkpoint_dir
from earshot.sources import day_counts, keyed, lake, master, session_log, tables
from earshot.streaming import counts as stream_counts
from earshot.streaming import ingest
from earshot.streaming import player as stream_player
from earshot.streaming import short_term
from suite.fixtures import AS_OF, AS_OF_MS, MARK_MS, SEED, Fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FEED_PATTERNS = {"any": "ring|WIDGET", "start": "^small", "brand": r"brand#1\d"}


def register(run: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(Fixtures(spark, sf_dir))
    return run


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def vector_sums(vec: str) -> list[Column]:
    """A vector as three numbers: its sum, its square and its position-weighted sum."""
    at = F.transform(F.col(vec), lambda x, i: x.cast("double") * (i + 1))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))

    return [
        r6(total(F.col(vec))).alias("v_sum"),
        r6(vector.vec_ip(F.col(vec), F.col(vec))).alias("v_square"),
        r6(total(at)).alias("v_moment"),
    ]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- counts -------------------------------------------------------------------------


@register
def trending_7d(fx):
    """The trending chart: trailing plays of every song that has some, with its names."""
    plays = counts.trending_7d(fx.play_log(), AS_OF)
    names = fx.names().select(F.col("_id").alias("track_id"), "track_name", "artist_name")
    return plays.join(names, "track_id")


@register
def top_trending(fx):
    top = counts.top_trending(fx.counted_songs(), 50)
    return top.select("_id", "track_name", F.col("plays_7d").cast("bigint").alias("plays_7d"))


@register
def play_counts(fx):
    return counts.play_counts(fx.play_log())


@register
def max_event_ts(fx):
    return counts.max_ts(fx.play_log())


@register
def run_stats(fx):
    return counts.run_stats(fx.play_log())


@register
def play_ratings(fx):
    return counts.ratings(fx.play_log()).withColumn("rating", F.col("rating").cast("double"))


@register
def daily_trailing_plays(fx):
    return counts.daily_trailing_plays(fx.play_log())


@register
def incremental_counts(fx):
    fresh, mark = counts.incremental_counts(fx.play_log(), MARK_MS)
    return fresh.withColumn("last_timestamp", mark.scalar())


@register
def add_counts(fx):
    fresh, _ = counts.incremental_counts(fx.play_log(), MARK_MS)
    known = fx.counted_songs()
    return counts.add_counts(known, fresh).select(
        "_id", F.col("plays_7d").cast("bigint").alias("plays_7d"), "plays_cumulative"
    )


# ---- events -------------------------------------------------------------------------


@register
def event_dates(fx):
    dated = events.with_event_date(fx.play_log().drop("date_str"))
    return dated.select(
        "user_id", "timestamp", "date_str", F.unix_millis("event_time").alias("event_ms")
    )


@register
def plays(fx):
    return events.plays(fx.play_log()).drop("date_str")


@register
def implicit_score(fx):
    return events.implicit_score(fx.play_log()).select("user_id", "track_id", "timestamp", "score")


@register
def since_mark(fx):
    return events.since_mark(fx.play_log(), MARK_MS).select("user_id", "track_id", "timestamp")


def payloads(raw: DataFrame) -> DataFrame:
    """Events as JSON payloads, some of them broken in ways producers break them."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "purchase", "complete")
        .when(kind == "view", "listen")
        .when(kind == "signup", "signup")
        .otherwise("skip")
    )
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    event = F.struct(
        F.col("user_id"),
        F.when(F.col("value") >= 1.0, F.get_json_object("props", "$.k")).alias("track_id"),
        F.when(kind == "view", F.lit(0)).otherwise(ms).alias("timestamp"),
        action.alias("action"),
        F.lit("real_user").alias("source"),
        F.when(kind == "click", F.floor("value").cast("string"))
        .when(kind == "error", F.lit("soon"))
        .alias("duration"),
        F.lit(300).alias("total_duration"),
    )
    whole = F.to_json(event)
    return raw.select(F.when(F.col("value") > 100.0, F.lit("garbage")).otherwise(whole).alias("value"))


@register
def validate_events(fx):
    parsed = events.parse_events(payloads(fx.raw("events")))
    valid, rejected = events.validate_events(parsed, AS_OF_MS)
    cols = [*valid.columns, "reason"]
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected.select(*cols)
    )


@register
def encode_events(fx):
    """Events to payloads and back: durations come back as whole seconds."""
    sent = events.encode_events(fx.play_log())
    valid, _ = events.validate_events(events.parse_events(sent), AS_OF_MS)
    return valid


@register
def classify_play(fx):
    finished = fx.raw("events").select(
        "event_id",
        F.col("value").alias("seconds"),
        F.lit(300.0).alias("total"),
        (F.col("event_type") == "purchase").alias("ended"),
    )
    return events.classify_play(finished).select(
        "event_id", "action", "duration", "total_duration"
    )


@register
def rebase_time(fx):
    return events.rebase_time(fx.play_log(), AS_OF_MS).select("user_id", "track_id", "timestamp")


@register
def replay_events(fx):
    return events.replay_events(fx.play_log().drop("source"))


# ---- sessions and players -----------------------------------------------------------


@register
def sessionize(fx):
    return sessions.sessionize(fx.play_log()).select(
        "user_id", "track_id", "timestamp", "session_no"
    )


@register
def short_term_vectors(fx):
    out = sessions.short_term_vectors(fx.play_log(), fx.items())
    return out.select("user_id", "session_no", "last_ts", "n_plays", *vector_sums("vector"))


@register
def session_vectors(fx):
    return fx.vectors().select("user_id", "has_long", *vector_sums("vector"))


@register
def listen_time(fx):
    return player.listen_time(fx.player_events())


@register
def qualified_listens(fx):
    return player.qualified_listens(fx.player_events())


# ---- song and user tables -----------------------------------------------------------


@register
def attach_duration(fx):
    return catalogue.attach_duration(fx.history(), fx.names())


@register
def sort_history(fx):
    log = catalogue.attach_duration(fx.history(), fx.names())
    return lake.sort_history(log).select("user_id", "track_id", "timestamp")


@register
def extract_users(fx):
    return catalogue.extract_users(fx.play_log(), AS_OF).drop("latent_vector")


@register
def extract_songs(fx):
    songs = catalogue.extract_songs(fx.history())
    return songs.select(
        "_id", "track_name", "artist_id", "artist_name", "image_url", "url", "duration"
    )


@register
def new_profiles(fx):
    names = fx.raw("nation").select(F.concat(F.lit("\t "), F.col("n_name"), F.lit(" ")).alias("name"))
    return catalogue.new_profiles(names, AS_OF).select(
        "username", "signup_date", F.length("_id").alias("id_length")
    )


@register
def resolve_id(fx):
    raw = fx.raw("orders").select(
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey").cast("string"))
        .when(F.col("o_orderstatus") == "F", F.lit(""))
        .alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("_id"),
        "o_totalprice",
    )
    return catalogue.resolve_id(raw, "id", "_id")


@register
def clean_songs(fx):
    return catalogue.clean_songs(fx.songs())


@register
def song_summary(fx):
    return catalogue.song_summary(fx.names()).drop("plays_7d")


@register
def list_users(fx):
    return catalogue.list_users(fx.users(), 100)


@register
def enrichment_pending(fx):
    known = counts.add_counts(fx.songs(), fx.totals())
    return catalogue.enrichment_pending(known).select("_id", "plays_cumulative")


@register
def merge_lyrics(fx):
    merged, _ = catalogue.merge_lyrics(fx.songs(), fx.fetched_lyrics())
    return merged.select(
        "_id",
        "duration",
        "release_date",
        F.md5("lrclib_plain_lyrics").alias("lyrics_md5"),
        "lrclib_synced_lyrics",
        "lrclib_id",
        "lrclib_fetched",
        "lrclib_not_found",
        "release_date_checked",
    )


@register
def enrichment_report(fx):
    _, report = catalogue.merge_lyrics(fx.songs(), fx.fetched_lyrics())
    return report


@register
def gate_text(fx):
    docs = fx.raw("documents").select("doc_id", "text")
    gated = catalogue.gate_text(docs, "text", max_chars=catalogue.MAX_CHARS)
    return gated.select("doc_id", F.length("text").alias("n_kept"), F.md5("text").alias("text_md5"))


@register
def with_lyrics(fx):
    return catalogue.with_lyrics(fx.songs()).select("_id", F.md5("lrclib_plain_lyrics").alias("m"))


@register
def missing_lyrics_delete(fx):
    gone = catalogue.missing_lyrics(fx.songs()).select("_id")
    songs, items, _ = merge.cascade_delete(
        gone, (fx.names(), "_id"), (fx.items(), "id"), (fx.content(), "id")
    )
    return songs.select("_id", F.lit("song").alias("kind")).unionByName(
        items.select(F.col("id").alias("_id"), F.lit("vector").alias("kind"))
    )


@register
def avatar_url(fx):
    named = fx.raw("part").select("p_partkey", F.concat("p_name", F.lit(" ~*/&+%é")).alias("n"))
    return named.select(
        "p_partkey",
        text.avatar_url(F.col("n")).alias("avatar"),
        text.avatar_url(F.col("n"), "cover").alias("cover"),
        text.short_username(F.col("p_partkey")).alias("username"),
    )


@register
def durations(fx):
    """Both duration forms: ``m:ss`` of a length, and such text back to milliseconds."""
    shown = fx.raw("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        text.fmt_duration(F.col("l_quantity") * 7.5).alias("shown"),
    )
    return shown.withColumn("ms", time.duration_to_ms(F.col("shown")))


@register
def iso_to_ms(fx):
    return fx.history().select(
        "user_id", "timestamp", time.iso_to_ms(F.col("timestamp")).alias("ms")
    )


# ---- merges and look-ups ------------------------------------------------------------


@register
def merge_set_users(fx):
    """The last order of each customer updates name and date; new keys are created."""
    updates = fx.raw("orders").select(
        (F.col("o_custkey") + 100).cast("string").alias("_id"),
        F.col("o_orderpriority").alias("username"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("signup_date"),
        "o_orderkey",
    )
    merged = merge.merge_set(
        fx.users(), updates, "_id", ["username", "signup_date"], ["signup_date"], F.col("o_orderkey")
    )
    return merged.select("_id", "username", "signup_date", "image_url")


@register
def merge_inc_counts(fx):
    """Line quantities by part added in two runs equal one full sum."""
    lines = fx.raw("lineitem").select(
        F.col("l_partkey").cast("string").alias("_id"),
        F.col("l_quantity").cast("int").alias("plays_7d"),
        F.lit(1).cast("bigint").alias("plays_cumulative"),
        "l_shipdate",
    )
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")
    once = merge.merge_inc(fx.names(), lines.filter(early), "_id", counts.COUNTERS)
    twice = merge.merge_inc(once, lines.filter(~early), "_id", counts.COUNTERS)
    return twice.select("_id", F.col("plays_7d").cast("bigint").alias("plays_7d"), "plays_cumulative")


@register
def missing_vectors(fx):
    return merge.missing_vectors(fx.names(), fx.items()).select("_id")


@register
def append_vectors(fx):
    new = fx.raw("part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.array_repeat(F.col("p_size").cast("float"), 64).alias("embedding"),
    )
    return tables.append_vectors(new, fx.items(), 64).select(
        "id", F.size("embedding").alias("dim"), *vector_sums("embedding")
    )


@register
def keep_known(fx):
    log = fx.play_log().select("user_id", F.col("track_id").alias("id"), "timestamp")
    return merge.keep_known(log, fx.items(), "id")


@register
def lookup_songs(fx):
    wanted = fx.play_log().select("track_id").distinct()
    return merge.lookup(fx.names(), wanted).select("_id", "track_name")


@register
def profile_table(fx):
    return merge.profile_table(fx.songs())


@register
def preview(fx):
    return merge.preview(fx.users().select("_id", "username"), 5)


# ---- vectors and ranking ------------------------------------------------------------


@register
def vec_unit(fx):
    scaled = fx.items().select("id", vector.vec_unit(F.col("embedding")).alias("u"))
    return scaled.select("id", *vector_sums("u"))


@register
def vec_lincomb(fx):
    e = F.col("embedding")
    mixed = fx.items().select("id", vector.vec_lincomb(e, 0.7, F.reverse(e), 0.3).alias("m"))
    return mixed.select("id", *vector_sums("m"))


def long_topk(fx: Fixtures) -> DataFrame:
    asks = fx.long_vectors().select(
        F.col("user_id").alias("query_id"), F.col("long_vector").alias("vector")
    )
    seen = fx.served().select(F.col("user_id").alias("query_id"), "id")
    return topk.topk_ip(asks, fx.items(), 20, seen)


@register
def topk_ip(fx):
    return long_topk(fx).withColumn("score", r6("score"))


def clustered(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Vectors pulled to one of 16 directions, by their id."""
    own = F.pmod(F.col(key).cast("bigint"), F.lit(16))
    pulled = F.transform(F.col(vec), lambda x, i: x + F.when(i == own, 2.0).otherwise(0.0))
    return df.withColumn(vec, pulled.cast("array<float>"))


@register
def approx_recall(fx):
    """Recall of the stored approximate index, with lists opened as tuned on the other half of the queries."""
    asks = fx.long_vectors().select(F.col("user_id").alias("query_id"), F.col("long_vector").alias("vector"))
    out = None
    for name, queries, items in (
        ("given", asks, fx.items()),
        ("clustered", clustered(asks, "query_id", "vector"), clustered(fx.items(), "id", "embedding")),
    ):
        root = scratch(fx.spark, "index")
        approx.build_index(items, root)
        index = approx.read_index(fx.spark, root)
        exact = cut(topk.topk_ip(queries, items, 10).select("query_id", "id"))
        half = F.pmod(F.col("query_id").cast("bigint"), F.lit(2)) == 0
        probes = approx.tune_probes(queries, index, exact.filter(half))
        found = approx.topk_approx(queries.filter(~half), items, index, 10, probes)
        wanted = exact.filter(~half).join(found.select("query_id", "id", "rank"), ["query_id", "id"], "left")
        recall = wanted.agg(
            F.count_distinct("query_id").alias("n_queries"),
            (F.count("rank") >= F.lit(0.9) * F.count(F.lit(1))).alias("reached"),
        )
        row = recall.select(F.lit(name).alias("vectors"), "n_queries", "reached")
        out = row if out is None else out.unionByName(row)
    return out


@register
def exclude_seen(fx):
    log = fx.play_log().select("user_id", F.col("track_id").alias("id"), "timestamp")
    old = events.last_days(fx.play_log(), AS_OF, 7).select("user_id", F.col("track_id").alias("id"))
    return ranking.exclude_seen(log, old, ["user_id", "id"])


@register
def minmax_scores(fx):
    scored = fx.raw("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.minmax(scored, "l_suppkey", "l_extendedprice").withColumn("scaled", r6("scaled"))


@register
def topk_orders(fx):
    """Each customer's three largest orders."""
    orders = fx.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.topk_per(
        orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3
    )


@register
def seeded_sample(fx):
    """Five repeatable random parts per supplier."""
    pairs = fx.raw("lineitem").select(
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("id"),
    ).distinct()
    return ranking.seeded_sample(pairs, "user_id", 5, SEED)


@register
def hybrid_rank(fx):
    als = long_topk(fx)
    asks = fx.long_vectors().select(
        F.col("user_id").alias("query_id"), F.col("long_vector").alias("vector")
    )
    similar = topk.topk_ip(asks, fx.content(), 20)
    return ranking.hybrid_rank(als, similar).withColumn("score", r6("score"))


@register
def fallback_songs(fx):
    wanted = fx.user_ids().withColumn("n", F.lit(100))
    return ranking.fallback_songs(wanted, fx.counted_songs(), fx.served().select("user_id", "id"), SEED)


def feeds(fx: Fixtures, state: DataFrame | None = None) -> DataFrame:
    state = feed.feed_state(fx.feed_served()) if state is None else state
    wanted = feed.refills(fx.user_ids(), state, feed.FEED)
    return feed.home_feed(
        wanted, fx.vectors(), fx.items(), fx.counted_songs(), fx.feed_served(), SEED
    )


@register
def home_feed(fx):
    return feeds(fx)


@register
def paginate_feed(fx):
    state = cut(feed.feed_state(fx.feed_served()))
    return ranking.paginate(feeds(fx, state).drop("source"), 20, feed.FEED.cap, state, fx.names())


@register
def hydrate_feed(fx):
    shown = ranking.hydrate(feeds(fx), fx.names())
    return shown.select("user_id", "id", "rank", "track_name", "artist_name", "duration")


@register
def next_songs(fx):
    room = feed.refills(fx.requests().select("user_id"), feed.feed_state(fx.served()), feed.PLAYLIST)
    ranked = feed.next_songs(
        fx.requests().join(room, "user_id"),
        fx.vectors(),
        fx.items(),
        fx.content(),
        fx.counted_songs(),
        fx.served(),
        SEED,
    )
    return ranked.withColumn("score", r6("score"))


@register
def feed_state(fx):
    return feed.feed_state(fx.served())


@register
def active_served(fx):
    return fx.feed_served().select("user_id", "id")


@register
def mark_served(fx):
    new = fx.user_ids().select("user_id", F.lit("5").alias("id"), F.lit(1).alias("rank"))
    return feed.mark_served(fx.served(), new, AS_OF_MS)


@register
def hand_out(fx):
    """The queues after every listener took one page of 20."""
    asks = fx.requests().select("query_id", "user_id")
    _, after = feed.hand_out(fx.feed_served(), asks, fx.names(), 20, feed.FEED)
    return feed.feed_state(after)


@register
def reset_served(fx):
    quiet = fx.feed_served().select("user_id")
    return feed.reset_served(fx.served(), quiet).select("user_id", "id")


# ---- search -------------------------------------------------------------------------


def postings(fx: Fixtures) -> search.Postings:
    """The word index of all songs, published to a new folder and read back."""
    root = scratch(fx.spark, "postings")
    search.publish_postings(fx.names(), root)
    return search.read_postings(fx.spark, root)


@register
def search_songs(fx):
    """Every supplier and every song name as a query against all songs."""
    parts = fx.raw("part")
    asked = parts.select(
        F.col("p_partkey").cast("string").alias("query_id"),
        F.concat_ws(" ", F.upper("p_name"), F.col("p_brand")).alias("text"),
    )
    return search.search_songs(postings(fx), asked, 10, 5)


@register
def token_index(fx):
    return search.token_index(fx.names())


@register
def search_regex(fx):
    patterns = fx.spark.createDataFrame(list(FEED_PATTERNS.items()), "query_id string, pattern string")
    return search.search_regex(fx.names(), patterns, 20, 10)


# ---- training and content -----------------------------------------------------------


@register
def idmap_users(fx):
    return indexing.build_idmap(events.implicit_score(fx.play_log()), "user_id")


@register
def idmap_items(fx):
    lines = fx.raw("lineitem").select(F.col("l_partkey").cast("string").alias("track_id"))
    return indexing.build_idmap(lines, "track_id")


@register
def training_triples(fx):
    triples, _, _ = training.training_data(fx.play_log(), AS_OF)
    return triples.withColumn("rating", F.col("rating").cast("double"))


def trained(fx: Fixtures) -> training.Trained:
    return training.train(fx.play_log(), AS_OF, seed=SEED)


@register
def als_factors(fx):
    """Every factor's id and length, that none is negative, and that it is not all zero."""
    model = trained(fx)

    def facts(df: DataFrame, kind: str, key: str, vec: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            F.size(vec).alias("dim"),
            F.forall(vec, lambda x: x >= 0).alias("not_negative"),
            F.exists(vec, lambda x: x > 0).alias("not_zero"),
        )

    items = facts(training.export_item_factors(model), "item", "id", "embedding")
    return items.unionByName(facts(training.user_factors(model), "user", "user_id", "vector"))


def in_blocks(df: DataFrame, key: str, vec: str, number: str, size: int) -> DataFrame:
    """Rows packed into numbered blocks of about ``size``."""
    n = max(1, df.count() // size)
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(number)).agg(
        F.collect_list(F.struct(F.col(key).alias("key"), F.col(vec).alias("vec"))).alias(f"_{number}")
    )


def best_left_out(users: DataFrame, items: DataFrame, listed: DataFrame) -> DataFrame:
    """Each user's best score of an item that is not listed, by plain products of blocks."""
    songs = in_blocks(items, "id", "embedding", "n", 4096)
    last = songs.agg(F.max("n")).first()[0]
    lists = listed.groupBy("user_id").agg(F.collect_set("id").alias("ids"))
    asked = users.join(lists, "user_id").select(
        "user_id", F.struct("vector", "ids").alias("both")
    )
    asked = in_blocks(asked, "user_id", "both", "u", 512)
    met = asked.withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last)))).join(songs, "n")

    def products(frames):
        for frame in frames:
            for people, tracks in zip(frame["_u"], frame["_n"], strict=True):
                vecs = np.array([t["vec"] for t in tracks], dtype=np.float64)
                place = {t["key"]: i for i, t in enumerate(tracks)}
                score = np.array([p["vec"]["vector"] for p in people], dtype=np.float64) @ vecs.T
                for row, p in enumerate(people):
                    score[row, [place[i] for i in p["vec"]["ids"] if i in place]] = -np.inf
                yield pd.DataFrame({"user_id": [p["key"] for p in people], "best": score.max(axis=1)})

    rows = met.select("_u", "_n").mapInPandas(products, "user_id string, best double")
    return rows.groupBy("user_id").agg(F.max("best").alias("best"))


@register
def als_recommend(fx):
    """For each user and rank whether the score is the inner product of the two factors, whether it
    falls with the rank, and whether no left-out item beats it."""
    model = trained(fx)
    users = cut(training.user_factors(model))
    items = cut(training.export_item_factors(model))
    best = cut(training.recommend(model, users.select("user_id"), 10))
    both = best.join(users, "user_id").join(items, "id").join(best_left_out(users, items, best), "user_id")
    product = vector.vec_ip(F.col("vector"), F.col("embedding"))
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    return both.select(
        "user_id",
        "rank",
        (F.abs(product - F.col("score")) <= 1e-9 * (1 + F.abs(product))).alias("is_product"),
        F.coalesce(before >= F.col("score"), F.lit(True)).alias("falls"),
        (F.col("best") <= F.col("score") + 1e-9 * (1 + F.abs("score"))).alias("bounded"),
    )


@register
def als_half_step(fx):
    """The trainer's user factors, solved again from its item factors: whether both agree."""
    triples, users, items = training.training_data(fx.play_log(), AS_OF)
    triples = cut(triples)
    model = training.Trained(training.train_als(triples, seed=SEED), users, items)
    rated = indexing.decode_ids(indexing.decode_ids(triples, users, "user_index", "user_id"), items, "item_index", "id")
    ours = half_step.half_step(rated, training.export_item_factors(model))
    both = ours.join(training.user_factors(model).withColumnRenamed("vector", "theirs"), "user_id")
    apart = F.array_max(F.zip_with("vector", "theirs", lambda a, b: F.abs(a - b)))
    return both.select(
        "user_id",
        F.size("vector").alias("dim"),
        (apart <= 1e-3 * F.greatest(F.lit(1.0), F.array_max("theirs"))).alias("agrees"),
        F.forall("vector", lambda x: x >= 0).alias("not_negative"),
    )


@register
def content_vectors(fx):
    songs = fx.songs()
    none = fx.spark.createDataFrame([], schemas.VECTORS)
    made = content.embed_text(songs, none)
    return made.select("id", *vector_sums("embedding"))


# ---- sources and jobs ---------------------------------------------------------------


@register
def lake_trending(fx):
    """Land the events in a lake, then count its last days with pruned partitions."""
    path = scratch(fx.spark, "lake")
    lake.write_lake(fx.play_log().drop("date_str"), path)
    return counts.trending_7d(lake.read_lake(fx.spark, path), AS_OF)


@register
def jsonl_round_trip(fx):
    """Export the cleaned songs as JSON lines and load them back into the song schema."""
    path = scratch(fx.spark, "songs")
    lake.write_jsonl(catalogue.clean_songs(fx.songs()), path)
    good, _ = master.read_master_jsonl(fx.spark, path, schemas.SONGS)
    return good.select(
        "_id",
        "track_name",
        "duration",
        F.col("plays_7d").cast("bigint").alias("plays_7d"),
        "release_date",
        F.md5("lrclib_plain_lyrics").alias("lyrics_md5"),
    )


@register
def rejected_lines(fx):
    """Master lines that are no JSON object or lack an id, each kept with its reason."""
    path = scratch(fx.spark, "lines")
    key = F.col("p_partkey")
    line = (
        F.when(key % 3 == 0, F.concat(F.lit("broken "), key.cast("string")))
        .when(key % 3 == 1, F.concat(F.lit('{"track_name":"'), key.cast("string"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"id":"'), key.cast("string"), F.lit('"}')))
    )
    fx.raw("part").select(line.alias("value")).write.text(path)
    _, rejected = master.read_master_jsonl(fx.spark, path, schemas.SONGS)
    return rejected


@register
def read_history(fx):
    """A history folder of several files, sorted, written and read back whole."""
    path = scratch(fx.spark, "history")
    lake.write_table(lake.sort_history(fx.play_log().drop("date_str")), path, schemas.PLAY_LOG)
    whole = lake.read_history(fx.spark, path)
    return whole.select("user_id", "track_id", "timestamp", "action")


@register
def load_vectors(fx):
    path = scratch(fx.spark, "vectors")
    fx.items().write.parquet(path)
    return tables.load_vectors(fx.spark, path, 64).select("id", *vector_sums("embedding"))


@register
def conform_times(fx):
    """Event times as text, some unreadable, cast to timestamps."""
    text = F.when(F.col("event_type") == "error", "bad").otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    wanted = StructType([StructField("event_id", LongType()), StructField("ts", TimestampType())])
    cast = schemas.conform(fx.raw("events").select("event_id", text.alias("ts")), wanted)
    return cast.select("event_id", F.unix_millis("ts").alias("ms"))


@register
def is_empty(fx):
    """Whether each action has events in the log; one never does."""
    log = fx.play_log()
    names = ["listen", "skip", "complete", "never"]
    found = [(n, counts.is_empty(log.filter(F.col("action") == n))) for n in names]
    return fx.spark.createDataFrame(found, "action string, empty boolean")


def letter_counts():
    """A stand-in for a sentence model: a text's length, its letters e and its blanks."""
    return lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts]


@register
def batch_encoder(fx):
    """Whole lyrics through a model that reads 500 characters at once: means of the windows."""
    none = fx.spark.createDataFrame([], schemas.VECTORS)
    made = content.embed_text(fx.songs(), none, content.BatchEncoder(letter_counts, window=500))
    return made.select("id", *(r6(F.col("embedding")[i].cast("double")).alias(f"x{i}") for i in range(3)))


@register
def publish_vectors(fx):
    root = scratch(fx.spark, "vectors")
    tables.write_vectors(fx.items(), root, schemas.ITEM_DIM)
    tables.write_vectors(fx.content(), root, schemas.ITEM_DIM)
    return tables.read_table(fx.spark, root).select("id", *vector_sums("embedding"))


@register
def prepare_history(fx):
    log, users = jobs.prepare_history(fx.history(), fx.names(), AS_OF)
    return log.select("user_id", "track_id", "timestamp", "duration").unionByName(
        users.select(F.col("_id").alias("user_id")), allowMissingColumns=True
    )


@register
def sync_master(fx):
    """Load the listeners' profiles over the user table."""
    path = scratch(fx.spark, "users")
    lake.write_jsonl(catalogue.extract_users(fx.play_log(), AS_OF), path)
    table, _, _ = jobs.sync_master(
        fx.users(), path, schemas.USERS, master.USER_IDS, ("latent_vector",)
    )
    return table.select("_id", "username", "signup_date")


@register
def run_incremental(fx):
    """Three runs of the counting job with a fold between; one run dies before it commits."""
    root = scratch(fx.spark, "counting")
    songs, kept = f"{root}/songs", f"{root}/counts"
    tables.publish(schemas.conform(fx.names(), schemas.SONGS), songs)
    log = fx.play_log()
    early = log.filter(F.col("timestamp") <= MARK_MS)
    jobs.run_incremental(early.filter(F.col("timestamp") <= MARK_MS // 2), kept)
    jobs.run_incremental(early, kept)
    jobs.fold_counts(fx.spark, songs, kept)
    # What a run that died before its log row leaves behind.
    early.write.parquet(f"{kept}/deltas/{jobs.INCREMENTAL_JOB}-{MARK_MS}-{MARK_MS + 1}")
    jobs.run_incremental(log, kept)
    return jobs.song_counters(fx.spark, songs, kept).select("_id", "plays_cumulative")


@register
def fold_stream_counts(fx):
    """The stream's counts in the song table; the last fold repeats one that was already done."""
    root = scratch(fx.spark, "folding")
    tables.publish(schemas.conform(fx.names(), schemas.SONGS), f"{root}/songs")
    log = fx.play_log(stream_of(fx, "events"))
    stream_counts.count_stream(log, f"{root}/deltas", f"{root}/ckpt", NOW).awaitTermination()
    for upto in (0, 10**9, 10**9):
        jobs.fold_stream_counts(fx.spark, f"{root}/songs", f"{root}/deltas", upto)
    return tables.read_table(fx.spark, f"{root}/songs").select("_id", "plays_cumulative")


@register
def run_nightly(fx):
    """Trailing counts and trained vectors, as published by the nightly job."""
    root = scratch(fx.spark, "nightly")
    roots = jobs.Roots(*[f"{root}/{n}" for n in ("songs", "users", "items", "content")])
    tables.publish(schemas.conform(fx.names(), schemas.SONGS), roots.songs)
    tables.publish(fx.users(), roots.users)
    at = datetime.combine(AS_OF, datetime.min.time())
    jobs.run_nightly(fx.play_log(), roots, at, seed=SEED)
    songs = tables.read_table(fx.spark, roots.songs)
    users = tables.read_table(fx.spark, roots.users)
    items = tables.read_table(fx.spark, roots.item_vectors)

    def rows(df: DataFrame, kind: str, key: str, number: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), number.alias("n"))

    dim = F.coalesce(F.size("latent_vector"), F.lit(0)).cast("bigint")
    return (
        rows(songs, "song", "_id", F.col("plays_7d").cast("bigint"))
        .unionByName(rows(users, "user", "_id", dim))
        .unionByName(rows(items, "item", "id", F.size("embedding").cast("bigint")))
    )


@register
def build_content(fx):
    """Which songs have a content vector after the job, and that the new ones are unit."""
    wide = F.flatten(F.array_repeat("embedding", 6))
    have = fx.content().select("id", wide.alias("embedding"))
    table = jobs.build_content(fx.songs(), have)
    square = F.round(vector.vec_ip(F.col("embedding"), F.col("embedding")), 3)
    return table.select("id", F.size("embedding").alias("dim"), square.alias("square"))


@register
def clean_catalogue(fx):
    songs, items, vectors, export = jobs.clean_catalogue(fx.songs(), fx.items(), fx.content())
    parts = (songs.select("_id"), items.select("id"), vectors.select("id"), export.select("_id"))
    out = [p.toDF("id").withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register
def merge_buckets(fx):
    """A keyed song table after a set of names, additions to counters and a delete, each of few keys."""
    root = scratch(fx.spark, "keyed")
    keyed.create_keyed(fx.names(), root, "_id", 16)
    key = F.col("_id").cast("bigint")
    ids = fx.names().select("_id")
    named = ids.filter(key % 100 == 3).withColumn("track_name", F.concat(F.lit("new "), "_id"))
    made = ids.filter(key % 500 == 7).select(F.concat(F.lit("x"), "_id").alias("_id"), F.lit("made").alias("track_name"))
    keyed.update_keyed(
        named.unionByName(made), root, lambda rows, new: merge.merge_set(rows, new, "_id", ["track_name"])
    )
    plays = counts.play_counts(fx.play_log()).withColumn("_id", F.col("track_id"))
    keyed.update_keyed(plays, root, counts.add_counts)
    keyed.delete_keyed(ids.filter(key % 200 == 11), root)
    return keyed.read_keyed(fx.spark, root).select(
        "_id", "track_name", F.col("plays_7d").cast("bigint").alias("plays_7d"), "plays_cumulative"
    )


@register
def trailing_days(fx):
    """Trailing counts kept from day to day: loads up to three days, late events of the last, a day's rest."""
    root = scratch(fx.spark, "days")
    log = fx.play_log()
    late = (F.pmod(F.xxhash64("user_id", "timestamp"), F.lit(10)) == 0) & (F.col("date_str") >= "2024-01-20")
    day = F.col("date_str")
    loads = [
        (day <= "2024-01-24") & ~late, (day <= "2024-01-27") & (day > "2024-01-24") & ~late,
        (day <= "2024-01-27") & late, day > "2024-01-27",
    ]
    for i, (part, as_of) in enumerate(zip(loads, (24, 27, 28, 31), strict=True)):
        lake.write_lake(log.filter(part), f"{root}/lake", f"load-{i}")
        day_counts.refresh(fx.spark, f"{root}/lake", f"{root}/counts", AS_OF.replace(day=as_of))
    return day_counts.read_trailing(fx.spark, f"{root}/counts")


@register
def kept_sessions(fx):
    """Sessions carried from run to run, over stretches that end inside days and at the last play's end."""
    root = scratch(fx.spark, "sessions")
    lake.write_lake(fx.play_log(), f"{root}/lake", "all")
    for upto in (MARK_MS + 5_000_000, AS_OF_MS - 40_000_000, AS_OF_MS + 86_400_000):
        session_log.advance(fx.spark, f"{root}/lake", f"{root}/kept", fx.items(), upto)
    out = session_log.read_sessions(fx.spark, f"{root}/kept")
    return out.select("user_id", "session_no", "last_ts", "n_plays", *vector_sums("vector"))


@register
def serve_batch(fx):
    """Every listener asks for a feed, for what follows, and searches their brand's name."""
    listeners = fx.requests()
    brand = fx.names().select(F.col("_id").alias("current_song_id"), F.col("artist_name").alias("text"))
    asked = listeners.join(brand, "current_song_id", "left").select(
        "query_id", "user_id", "current_song_id", "text", F.explode(F.array(*map(F.lit, ("feed", "next", "search")))).alias("kind")
    )
    out = jobs.serve_batch(
        asked,
        jobs.Tables(
            fx.counted_songs(), fx.items(), fx.content(), fx.vectors(), fx.feed_served(), fx.served(),
            postings(fx),
        ),
        20,
        SEED,
        AS_OF_MS,
    )

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "query_id", "id", "rank", "has_more")

    return (
        rows(out.feeds, "feed")
        .unionByName(rows(out.following, "next"))
        .unionByName(rows(out.found, "search"))
    )


# ---- streams ------------------------------------------------------------------------

NOW = {"availableNow": True}


def stream_of(fx: Fixtures, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    return (
        fx.spark.readStream.schema(fx.raw(name).schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(fx.dir)
    )


#: Rows of a file of a stream made from a table.
FILE_ROWS = 1_000_000


def in_files(fx: Fixtures, df: DataFrame, path: str, number: Column) -> DataFrame:
    """Rows as a stream of a micro-batch for each ``number``, in their order, from 0.

    A batch is as many files as the largest has millions of rows, so no task writes or reads more.
    """
    numbered = df.withColumn("_file", number.cast("int"))
    sizes = {r["_file"]: r["count"] for r in numbered.groupBy("_file").count().collect()}
    files = -(-max(sizes.values()) // FILE_ROWS)
    for i in range(max(sizes) + 1):
        part = numbered.filter(F.col("_file") == i).drop("_file")
        whole = files == 1 or sizes.get(i, 0) < files * files
        (part.coalesce(1) if whole else part.repartition(files)).write.mode("append").parquet(path)
        for _ in range(files - 1 if whole else 0):  # empty ones, so that all batches have equally many
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    return fx.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@register
def ingest_stream(fx):
    root = scratch(fx.spark, "ingest")
    lake_path, quarantine = f"{root}/lake", f"{root}/quarantine"
    events_ = in_files(fx, fx.raw("events"), f"{root}/events", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    query = ingest.ingest_stream(payloads(events_), lake_path, quarantine, f"{root}/ckpt", NOW)
    query.awaitTermination()
    landed = lake.read_lake(fx.spark, lake_path)
    # A missing time becomes the arrival time, which differs from run to run: hide it.
    timed = F.col("action") != "listen"
    return landed.select(
        "user_id",
        "track_id",
        F.when(timed, F.col("timestamp")).alias("timestamp"),
        "action",
        "duration",
        "total_duration",
        F.when(timed, F.col("date_str")).alias("date_str"),
    )


@register
def count_stream(fx):
    root = scratch(fx.spark, "counts")
    log = fx.play_log(stream_of(fx, "events"))
    stream_counts.count_stream(log, f"{root}/deltas", f"{root}/ckpt", NOW).awaitTermination()
    return stream_counts.read_counts(fx.spark, f"{root}/deltas")


def _collected(stream: DataFrame, root: str, spark: SparkSession) -> DataFrame:
    """The stream's updates, each with the micro-batch that made it."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    # A processing-time timeout asks for empty batches for ever; a run to the end of the
    # available data must not wait for them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = (
        stream.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", f"{root}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register
def short_term_stream(fx):
    """Plays in three micro-batches by time, then a fourth that repeats plays of sessions long over."""
    root = scratch(fx.spark, "short")
    log = fx.play_log().select("user_id", "track_id", "timestamp")
    whole = Window.partitionBy("user_id")
    known = log.join(fx.items().select(F.col("id").alias("track_id")), "track_id", "left_semi")
    old = known.withColumn("_last", F.max("timestamp").over(whole)).filter(
        F.col("timestamp") <= F.col("_last") - 3_600_000
    )
    low, high = log.agg(F.min("timestamp"), F.max("timestamp")).first()
    third = F.floor((F.col("timestamp") - low) * 3 / (high - low + 1)).cast("int")
    numbered = log.withColumn("_n", third)
    late = old.drop("_last").withColumn("_n", F.lit(3))
    # Each file is written from these rows; they are made once.
    rows = cut(numbered.unionByName(late))
    stream = in_files(fx, rows, f"{root}/log", F.col("_n"))
    out = _collected(short_term.short_term_stream(stream, fx.items()), root, fx.spark)
    last = short_term.latest_vectors(out)
    return last.select("user_id", "last_ts", *vector_sums("short_vector"))


@register
def listen_stream(fx):
    """Turns in three micro-batches, then late snapshots, which read the timer at its newest moment."""
    root = scratch(fx.spark, "listen")
    turns = fx.player_events()
    late = turns.groupBy("play_id").agg(F.lit(0).cast("int").alias("ts_ms"))
    late = late.withColumn("kind", F.lit("snapshot")).withColumn("_n", F.lit(3))
    rows = turns.withColumn("_n", F.least(F.floor(F.col("ts_ms") / 40_000), F.lit(2)).cast("int"))
    rows = rows.withColumn("ts_ms", F.col("ts_ms").cast("int")).unionByName(late)
    stream = in_files(fx, rows, f"{root}/turns", F.col("_n"))
    out = _collected(stream_player.listen_stream(stream), root, fx.spark)
    last = F.max_by(F.struct("listen_ms", "qualified_ms"), "batch_id").alias("last")
    return out.groupBy("play_id").agg(last).select("play_id", "last.listen_ms", "last.qualified_ms")
