"""Domain tables as views of the given tables. `suite.oracle` states the same in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.operators.counts import play_counts, resync_trending, trending_7d
from earshot.operators.feed import active_served
from earshot.operators.sessions import active_short_term, session_vectors
from earshot.session import cut

AS_OF = date(2024, 1, 31)
AS_OF_MS = 1_706_659_200_000
MARK_MS = 1_705_276_800_000
SEED = 7


class Fixtures:
    """Lazy domain tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._tables: dict[str, DataFrame] = {}
        # The given timestamps carry no zone; they are read as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        """A given table; its footer is read once per query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def play_log(self, events: DataFrame | None = None) -> DataFrame:
        events = self.raw("events") if events is None else events
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        action = (
            F.when(F.col("event_type") == "purchase", "complete")
            .when(F.col("event_type").isin("view", "click"), "listen")
            .otherwise("skip")
        )
        return events.select(
            F.col("user_id").cast("string").alias("user_id"),
            F.get_json_object("props", "$.k").alias("track_id"),
            F.floor(us / 1000).alias("timestamp"),
            action.alias("action"),
            F.lit("simulation").alias("source"),
            F.col("value").alias("duration"),
            F.lit(300.0).alias("total_duration"),
            F.col("ts").cast("date").alias("date_str"),
        )

    def songs(self) -> DataFrame:
        """Song master with lyrics and look-up flags; counters still empty."""
        part, docs = self.raw("part"), self.raw("documents")
        fetched = F.col("p_size") <= 40
        found = F.col("text").isNotNull()
        null = F.lit(None)
        return part.join(docs, part.p_partkey == docs.doc_id, "left").select(
            F.col("p_partkey").cast("string").alias("_id"),
            F.col("p_name").alias("track_name"),
            F.col("p_brand").alias("artist_id"),
            F.col("p_brand").alias("artist_name"),
            null.cast("string").alias("image_url"),
            F.col("p_type").alias("url"),
            (F.col("p_size") * 10.0).alias("duration"),
            F.lit(0).alias("plays_7d"),
            F.lit(0).cast("bigint").alias("plays_cumulative"),
            null.cast("date").alias("release_date"),
            F.col("text").alias("lrclib_plain_lyrics"),
            null.cast("string").alias("lrclib_synced_lyrics"),
            F.when(found & fetched, F.col("doc_id")).alias("lrclib_id"),
            fetched.alias("lrclib_fetched"),
            F.when(fetched, ~found).alias("lrclib_not_found"),
            F.when(fetched & found, F.lit(True)).alias("release_date_checked"),
        )

    def names(self) -> DataFrame:
        """The song table without lyrics: what counting, ranking and search need."""
        part = self.raw("part")
        return part.select(
            F.col("p_partkey").cast("string").alias("_id"),
            F.col("p_name").alias("track_name"),
            F.col("p_brand").alias("artist_id"),
            F.col("p_brand").alias("artist_name"),
            F.lit(None).cast("string").alias("image_url"),
            F.col("p_type").alias("url"),
            (F.col("p_size") * 10.0).alias("duration"),
            F.lit(0).alias("plays_7d"),
            F.lit(0).cast("bigint").alias("plays_cumulative"),
            F.lit(None).cast("date").alias("release_date"),
        )

    def counted_songs(self) -> DataFrame:
        """Songs with the trailing play counts set."""
        return resync_trending(self.names(), trending_7d(self.play_log(), AS_OF))

    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("_id"),
            F.col("c_name").alias("username"),
            F.lit(None).cast("array<float>").alias("latent_vector"),
            F.lit(AS_OF).alias("signup_date"),
            F.lit(None).cast("string").alias("image_url"),
        )

    def user_ids(self) -> DataFrame:
        return self.users().select(F.col("_id").alias("user_id"))

    def items(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").cast("string").alias("id"), "embedding"
        )

    def content(self) -> DataFrame:
        return self.items().select("id", F.reverse("embedding").alias("embedding"))

    def long_vectors(self) -> DataFrame:
        listeners = self.play_log().select("user_id").distinct()
        return self.items().select(
            F.col("id").alias("user_id"), F.col("embedding").alias("long_vector")
        ).join(listeners, "user_id", "left_semi")

    def short_vectors(self) -> DataFrame:
        return active_short_term(self.play_log(), self.items(), AS_OF_MS)

    def vectors(self) -> DataFrame:
        return session_vectors(self.long_vectors(), self.short_vectors())

    def history(self) -> DataFrame:
        events, part = self.raw("events"), self.raw("part")
        track = F.get_json_object("props", "$.k").cast("bigint")
        name = F.when(F.col("event_type") == "click", F.upper("p_name")).otherwise(F.col("p_name"))
        iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return events.withColumn("k", track).join(part, F.col("k") == F.col("p_partkey")).select(
            F.col("user_id").cast("string").alias("user_id"),
            F.when(F.col("event_type") == "error", "bad").otherwise(iso).alias("timestamp"),
            F.col("k").cast("string").alias("musicbrainz_track_id"),
            name.alias("track_name"),
            F.col("p_brand").alias("musicbrainz_artist_id"),
            F.col("p_brand").alias("artist_name"),
        )

    def player_events(self, turns: DataFrame | None = None) -> DataFrame:
        """Play on even turns, pause on odd ones; the last turn reads the timer."""
        turns = self.raw("conversations") if turns is None else turns
        last = self.raw("conversations").groupBy("conv_id").agg(F.max("turn").alias("_last"))
        kind = (
            F.when(F.col("turn") == F.col("_last"), "snapshot")
            .when(F.col("turn") % 2 == 0, "play")
            .otherwise("pause")
        )
        return turns.join(last, "conv_id").select(
            F.col("conv_id").cast("string").alias("play_id"),
            (F.col("turn") * 20_000).alias("ts_ms"),
            kind.alias("kind"),
        )

    def served(self) -> DataFrame:
        """What each user was served: every track of theirs; skipped ones still wait."""
        last = self.play_log().groupBy("user_id", F.col("track_id").alias("id")).agg(
            F.max("timestamp").alias("served_at"),
            F.min(F.col("action") == "skip").alias("queued"),
        )
        place = F.row_number().over(Window.partitionBy("user_id").orderBy("served_at", "id"))
        return last.withColumn("position", place.cast("bigint"))

    def feed_served(self) -> DataFrame:
        """Live sessions, and three kinds more: a full queue, one whose first ids have no song, and
        a session at its cap."""
        if "alive" not in self._tables:  # every use of the sessions reads them several times
            self._tables["alive"] = cut(active_served(self.served(), AS_OF_MS, 86_400_000))
        alive = self._tables["alive"]
        users = self.user_ids().withColumn("_kind", F.col("user_id").cast("bigint") % 10)

        def more(kind: int, n: int, queued: bool, name: str, first: int) -> DataFrame:
            k = F.explode(F.sequence(F.lit(1), F.lit(n)))
            some = users.filter(F.col("_kind") == kind).select("user_id", k.alias("k"))
            return some.select(
                "user_id",
                F.concat(F.lit(name), F.col("k").cast("string")).alias("id"),
                F.lit(AS_OF_MS).alias("served_at"),
                F.lit(queued).alias("queued"),
                (F.col("k") + first).cast("bigint").alias("position"),
            )

        full = more(1, 40, True, "", 1_000_000)
        ghosts = more(2, 25, True, "ghost-", -1_000)
        capped = more(3, 500, False, "old-", -1_000)
        new = full.join(alive.select("user_id", "id"), ["user_id", "id"], "left_anti")
        out = alive.select("user_id", "id", "served_at", "queued", "position")
        for part in (new, ghosts, capped):
            out = out.unionByName(part)
        return out

    def requests(self) -> DataFrame:
        """Each listener asks for what follows their latest track."""
        latest = F.max_by("track_id", F.struct("timestamp", "track_id"))
        return (
            self.play_log()
            .groupBy("user_id")
            .agg(latest.alias("current_song_id"))
            .select(F.col("user_id").alias("query_id"), "user_id", "current_song_id")
        )

    def fetched_lyrics(self) -> DataFrame:
        """Two ranked look-up results per document; short texts count as no lyrics."""
        docs = self.raw("documents")
        base = docs.select(
            F.col("doc_id").cast("string").alias("_id"),
            F.when(F.col("n_chars") >= 200, F.col("text")).alias("plain_lyrics"),
            F.col("source").alias("synced_lyrics"),
            F.col("doc_id").alias("lrclib_id"),
            F.when(F.col("lang") != "en", F.col("n_chars") * 1.0).alias("duration"),
            F.lit(AS_OF).alias("release_date"),
            F.lit(1).alias("rank"),
        )
        second = base.withColumns({"plain_lyrics": F.lit("second"), "rank": F.lit(2)})
        return base.unionByName(second)

    def totals(self) -> DataFrame:
        return play_counts(self.play_log())
