"""Home feeds and next-song lists for a whole table of requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.ranking import (
    fallback_songs,
    hybrid_rank,
    hydrate,
    seeded_sample,
    topk_per,
)
from earshot.operators.topk import topk_ip
from earshot.session import cut, spread


@dataclass(frozen=True)
class Quota:
    """How much one refill generates: batch size, session cap, refill threshold, ttl."""

    batch: int
    cap: int
    refill_below: int
    ttl_ms: int

    def room(self, n_generated: Column) -> Column:
        return F.least(F.lit(self.batch), F.lit(self.cap) - n_generated)


# The serving quotas.
FEED = Quota(batch=100, cap=500, refill_below=20, ttl_ms=86_400_000)
PLAYLIST = Quota(batch=50, cap=200, refill_below=15, ttl_ms=3_600_000)


def active_served(served: DataFrame, as_of_ms: int | Column, ttl_ms: int) -> DataFrame:
    """Served ids of users whose last refill is younger than the ttl.

    Each refill restarts the clock for everything served to that user before.
    """
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    last = served.groupBy("user_id").agg(F.max("served_at").alias("_last"))
    alive = last.filter(as_of < F.col("_last") + ttl_ms).select("user_id")
    return served.join(alive, "user_id", "left_semi")


def reset_served(served: DataFrame, users: DataFrame) -> DataFrame:
    """Forget everything served to ``users``."""
    return served.join(users.select("user_id"), "user_id", "left_anti")


def mark_served(served: DataFrame, new: DataFrame, served_at_ms: int) -> DataFrame:
    """Append a new batch ``(user_id, id, rank)`` to the queues: the state after a refill.

    ``served(user_id, id, position, queued, served_at)`` holds each session's ids once; new
    ones wait at the end of their user's queue, in the order of ``rank``. An id generated again
    waits again.
    """
    columns = ["user_id", "id", "position", "queued", "served_at"]
    ends = served.groupBy("user_id").agg(F.max("position").alias("_end"))
    place = F.coalesce(F.col("_end"), F.lit(0)) + F.col("rank")
    added = new.join(ends, "user_id", "left").select(
        "user_id", "id", place.cast("bigint").alias("position"), F.lit(True).alias("queued"),
        F.lit(served_at_ms).cast("bigint").alias("served_at"),
    )
    both = served.select(*columns).unionByName(added)
    return both.groupBy("user_id", "id").agg(
        *(F.max(c).alias(c) for c in ("position", "queued", "served_at"))
    )


def hand_out(state: DataFrame, asks: DataFrame, songs: DataFrame, limit: int, quota: Quota) -> tuple[DataFrame, DataFrame]:
    """Answer ``asks(query_id, user_id)`` from the queues: ``(pages, state afterwards)``.

    A user's queries, in the order of their ids, take the next ``limit`` waiting ids each. A page
    holds those that have a song, with its data; ``rank`` counts places of the page, songs or
    not. More follows a page with songs while ids wait behind it or the session has room.
    """
    limit = min(limit, quota.cap)
    state = spread(state, "user_id", rows=state.count())
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("query_id"))
    turns = cut(asks.select("query_id", "user_id").withColumn("turn", turn))
    counts = feed_state(state).join(turns.select("user_id").distinct(), "user_id")
    most = F.max("turn") * limit
    wanted = turns.groupBy("user_id").agg(most.alias("_wanted"))
    line = state.filter("queued").join(wanted, "user_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("position", "id"))
    popped = cut(line.withColumn("_place", place).filter(F.col("_place") <= F.col("_wanted")))
    pages = (
        popped.select(
            "user_id", "id", F.ceil(F.col("_place") / limit).cast("int").alias("turn"),
            ((F.col("_place") - 1) % limit + 1).cast("int").alias("rank"),
        )
        .join(turns, ["user_id", "turn"])
        .join(counts, "user_id")
    )
    more = (F.col("n_queued") > F.col("turn") * limit) | (F.col("n_generated") < quota.cap)
    shown = hydrate(pages.withColumn("has_more", more), songs)
    after = state.join(popped.select("user_id", "id", F.lit(True).alias("_out")), ["user_id", "id"], "left")
    queued = F.col("queued") & F.col("_out").isNull()
    after = after.select("user_id", "id", "position", queued.alias("queued"), "served_at")
    return shown.drop("turn", "n_queued", "n_generated"), after


def feed_state(served: DataFrame) -> DataFrame:
    """Per user how many ids were generated and how many of them still wait.

    An id waits until it is handed out; ``queued`` says so.
    """
    served = spread(served.select("user_id", "id", "queued"), "user_id", rows=served.count())
    per_id = served.groupBy("user_id", "id").agg(F.max("queued").alias("queued"))
    return per_id.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_generated"), F.count_if("queued").alias("n_queued")
    )


def refills(users: DataFrame, state: DataFrame, quota: Quota) -> DataFrame:
    """``(user_id, n)`` of the users whose queue runs low and whose session has room."""
    generated = F.coalesce(F.col("n_generated"), F.lit(0))
    queued = F.coalesce(F.col("n_queued"), F.lit(0))
    return (
        users.select("user_id")
        .join(state, "user_id", "left")
        .filter((queued < quota.refill_below) & (generated < quota.cap))
        .select("user_id", quota.room(generated).cast("bigint").alias("n"))
    )


# How many candidates lists of a length are drawn from.
def feed_pool(quota: Column) -> Column:
    """How many candidates a personal quota is drawn from."""
    pool = F.floor(quota * F.when(quota <= 50, 3.0).otherwise(1.2))
    return F.greatest(pool, F.lit(20)).cast("bigint")


def next_pool(limit: Column) -> Column:
    """How many candidates each of the two next-song lists holds."""
    pool = F.floor(limit * F.when(limit <= 50, 3.0).otherwise(1.5))
    return F.greatest(pool, F.lit(15)).cast("bigint")


def _most(requests: DataFrame, n: Column) -> int:
    """The largest ``n`` that a request table holds."""
    return int(requests.agg(F.max(n)).first()[0] or 0)


def home_feed(
    wanted: DataFrame,
    vectors: DataFrame,
    items: DataFrame,
    songs: DataFrame,
    served: DataFrame,
    seed: int,
) -> DataFrame:
    """Ranked feed ids for ``wanted(user_id, n)``.

    A user with a vector gets a random ``quota`` of the best-matching songs not served
    yet: all ``n`` with a long-term vector, half with only a short-term one. Trending
    songs, neither served nor just taken, fill the rest. ``source`` is 1 for personal and
    2 for trending songs.
    """
    whole = F.col("n")
    quota = F.when(F.col("has_long"), whole).otherwise(F.floor(whole * 0.5))
    wanted = cut(
        wanted.join(vectors, "user_id", "left").select(
            "user_id", "n", "vector", quota.alias("quota")
        )
    )
    asks = wanted.filter(F.col("vector").isNotNull())
    seen = cut(served.select("user_id", "id").join(wanted.select("user_id").distinct(), "user_id", "left_semi"))
    best = topk_ip(
        asks.select(F.col("user_id").alias("query_id"), "vector"),
        items,
        max(1, _most(asks, feed_pool(F.col("quota")))),
        seen.withColumnRenamed("user_id", "query_id"),
    ).withColumnRenamed("query_id", "user_id")
    pool = best.join(asks.select("user_id", "quota"), "user_id").filter(
        F.col("rank") <= feed_pool(F.col("quota"))
    )
    longest = _most(asks, F.col("quota"))
    taken = cut(
        seeded_sample(
            pool.select("user_id", "id", "quota"), "user_id", longest, seed, F.col("quota")
        ).select("user_id", "id", "rank")
    )
    got = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("_got"))
    n_taken = F.coalesce(F.col("_got"), F.lit(0))
    short = wanted.join(got, "user_id", "left").select(
        "user_id", (F.col("n") - n_taken).alias("n"), n_taken.alias("offset")
    )
    filler = fallback_songs(short, songs, seen.unionByName(taken.select("user_id", "id")), seed)
    both = taken.withColumn("source", F.lit(1)).unionByName(
        filler.withColumn("source", F.lit(2))
    )
    return both.select("user_id", "id", "source", "rank")


def next_songs(
    requests: DataFrame,
    vectors: DataFrame,
    items: DataFrame,
    content: DataFrame,
    songs: DataFrame,
    served: DataFrame,
    seed: int,
) -> DataFrame:
    """Ranked next songs for ``requests(query_id, user_id, current_song_id, n)``.

    Candidates come from the user's vector and from the current song's content vector,
    both without served songs and the current one; the two scaled scores are blended. A
    user without a vector is ranked by content alone. Only when both lists are empty do
    trending songs answer, and there the current song may appear.
    """
    tastes = vectors.select("user_id", F.col("vector").alias("taste"))
    sound = content.select(
        F.col("id").alias("current_song_id"), F.col("embedding").alias("sound")
    )
    queries = cut(
        requests.select("query_id", "user_id", "current_song_id", "n")
        .join(tastes, "user_id", "left")
        .join(sound, "current_song_id", "left")
    )
    seen = queries.select("query_id", "user_id").join(served.select("user_id", "id"), "user_id")
    seen = seen.select("query_id", "id")
    current = queries.select("query_id", F.col("current_song_id").alias("id"))
    hidden = cut(seen.unionByName(current).distinct())
    longest = _most(queries, F.col("n"))
    most = max(1, _most(queries, next_pool(F.col("n"))))

    def candidates(vector: str, table: DataFrame) -> DataFrame:
        asks = queries.select("query_id", F.col(vector).alias("vector"))
        limits = queries.select("query_id", next_pool(F.col("n")).alias("_pool"))
        best = topk_ip(asks, table, most, hidden).join(limits, "query_id")
        return best.filter(F.col("rank") <= F.col("_pool"))

    als, similar = candidates("taste", items), candidates("sound", content)
    merged = cut(
        topk_per(
            hybrid_rank(als, similar), ["query_id"], [F.desc("score"), F.asc("id")], longest
        )
    )
    ranked = merged.join(queries.select("query_id", "n"), "query_id").filter(
        F.col("rank") <= F.col("n")
    )
    lost = queries.join(merged.select("query_id").distinct(), "query_id", "left_anti")
    filler = fallback_songs(
        lost.select(F.col("query_id").alias("user_id"), "n"),
        songs,
        seen.withColumnRenamed("query_id", "user_id"),
        seed,
    ).withColumnRenamed("user_id", "query_id")
    return ranked.select("query_id", "id", "score", "rank").unionByName(
        filler.select("query_id", "id", F.lit(None).cast("double").alias("score"), "rank")
    )
