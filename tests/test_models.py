import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import content, feed, search, training
from earshot.operators.events import with_event_date
from earshot.plans import jobs
from earshot.schemas import SONGS, USERS, conform
from earshot.sources import tables

AS_OF = date(1970, 1, 3)
SMALL = training.Params(rank=4, maxIter=4)
WIDE = training.Params(rank=12, maxIter=8)


def clustered_log(spark):
    """Two groups of listeners, each with its own songs."""
    rows = []
    for u in range(12):
        for t in range(12):
            if u % 2 == t % 2 and (u + t) % 5:
                rows.append((f"u{u}", f"t{t}", 1000 * (u + t), "complete"))
            elif (u * t) % 7 == 1:
                rows.append((f"u{u}", f"t{t}", 1000, "skip"))
    rows += [("old", "t0", -(10**12), "complete"), ("u0", "t0", 5, "listen")]
    df = spark.createDataFrame(rows, "user_id string, track_id string, timestamp long, action string")
    return with_event_date(df)


def factors(trained):
    items = training.export_item_factors(trained).collect()
    users = training.user_factors(trained).collect()
    return {r["id"]: r["embedding"] for r in items}, {r["user_id"]: r["vector"] for r in users}


def test_ratings_sum_scores_and_skip_old_and_skipped(spark):
    triples, users, items = training.training_data(clustered_log(spark), AS_OF)
    names = {r["idx"]: r["id"] for r in users.collect()}
    tracks = {r["idx"]: r["id"] for r in items.collect()}
    got = {(names[r["user_index"]], tracks[r["item_index"]]): r["rating"] for r in triples.collect()}
    assert "old" not in names.values()
    assert got[("u0", "t2")] == 1.0 and ("u0", "t0") in got and got[("u0", "t0")] == 0.5


def test_training_is_repeatable_nonnegative_and_finds_the_clusters(spark):
    log = clustered_log(spark)
    items, users = factors(training.train(log, AS_OF, WIDE, 3, blocks=2))
    again, _ = factors(training.train(log, AS_OF, WIDE, 3, blocks=2))
    assert items.keys() == again.keys()
    for track, vec in items.items():
        assert vec == pytest.approx(again[track], abs=1e-3)
    assert all(x >= 0 for v in [*items.values(), *users.values()] for x in v)
    for user, vec in users.items():
        score = {t: float(np.dot(vec, items[t])) for t in items}
        own = [s for t, s in score.items() if int(t[1:]) % 2 == int(user[1:]) % 2]
        other = [s for t, s in score.items() if int(t[1:]) % 2 != int(user[1:]) % 2]
        assert np.mean(own) > 3 * np.mean(other)


def test_recommend_ranks_by_inner_product(spark):
    trained = training.train(clustered_log(spark), AS_OF, SMALL, 3, blocks=2)
    items, users = factors(trained)
    asked = spark.createDataFrame([("u1",)], "user_id string")
    got = [r["id"] for r in training.recommend(trained, asked, 4).orderBy("rank").collect()]
    best = sorted(items, key=lambda t: (-float(np.dot(np.float64(users["u1"]), np.float64(items[t]))), t))
    assert got == best[:4]


def test_nightly_publishes_counts_and_vectors(spark, tmp_path):
    roots = jobs.Roots(*[str(tmp_path / n) for n in ("songs", "users", "items", "content")])
    songs = spark.createDataFrame([("t2", 99), ("quiet", 99)], "_id string, plays_7d int")
    tables.publish(conform(songs, SONGS), roots.songs)
    users = spark.createDataFrame([("u0", "Ann"), ("idle", "Bob")], "_id string, username string")
    tables.publish(conform(users, USERS), roots.users)
    at = datetime(1970, 1, 3, 2)
    jobs.run_nightly(clustered_log(spark), roots, at, SMALL, 1, blocks=2)
    plays = {r["_id"]: r["plays_7d"] for r in tables.read_table(spark, roots.songs).collect()}
    assert plays["quiet"] == 0 and 0 < plays["t2"] < 99
    got = {r["_id"]: r for r in tables.read_table(spark, roots.users).collect()}
    assert len(got["u0"]["latent_vector"]) == 4 and got["u0"]["username"] == "Ann"
    assert got["u0"]["last_model_update"] == at
    assert got["idle"]["latent_vector"] is None and got["u1"]["username"] is None
    assert tables.read_table(spark, roots.item_vectors).count() == 12


def lyric_songs(spark):
    texts = {
        "a": "love and rain " * 10,
        "b": "love and rain " * 10,
        "c": "engines roar at night " * 10,
        "short": "la la",
        "none": None,
        "blank": "   " * 40,
    }
    return spark.createDataFrame(list(texts.items()), "_id string, lrclib_plain_lyrics string")


def no_vectors(spark):
    return spark.createDataFrame([], "id string, embedding array<float>")


def test_content_vectors_are_unit_and_equal_for_equal_texts(spark):
    got = {r["id"]: r["embedding"] for r in content.embed_text(lyric_songs(spark), no_vectors(spark)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"]
    for vec in got.values():
        assert len(vec) == 384 and math.isclose(sum(x * x for x in vec), 1, abs_tol=1e-5)


def test_only_missing_vectors_are_made_and_they_do_not_depend_on_the_rest(spark):
    songs = lyric_songs(spark)
    full = {r["id"]: r["embedding"] for r in content.embed_text(songs, no_vectors(spark)).collect()}
    have = spark.createDataFrame([("a", [1.0] * 384)], "id string, embedding array<float>")
    table = {r["id"]: r["embedding"] for r in jobs.build_content(songs, have).collect()}
    assert table["a"] == [1.0] * 384
    assert table["b"] == full["b"] and table["c"] == full["c"]
    short = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    with pytest.raises(Exception, match="not of length 384"):
        jobs.build_content(songs, short).collect()


def test_stored_rarity_keeps_vectors_comparable(spark):
    songs = lyric_songs(spark)
    texts = songs.select(F.col("_id").alias("id"), F.col("lrclib_plain_lyrics").alias("text"))
    rarity = content.fit_rarity(texts.filter("id in ('a', 'b', 'c')"))
    encoder = content.HashingEncoder(rarity=rarity)
    one = content.embed_text(songs.filter("_id = 'c'"), no_vectors(spark), encoder).first()["embedding"]
    full = {r["id"]: r["embedding"] for r in content.embed_text(songs, no_vectors(spark)).collect()}
    assert one == full["c"]


def test_batch_encoder_reads_whole_texts_in_windows(spark):
    def make():
        return lambda texts: [[len(t), 1.0] for t in texts]

    lengths = {"a": 140, "b": 140, "c": 220}
    for window, mean in ((None, lambda n: n), (60, lambda n: n / -(-n // 60)), (1000, lambda n: n)):
        encoder = content.BatchEncoder(make, window=window)
        made = {r["id"]: r["embedding"] for r in content.embed_text(lyric_songs(spark), no_vectors(spark), encoder).collect()}
        assert made == {k: [pytest.approx(mean(n)), 1.0] for k, n in lengths.items()}


def test_prepare_history(spark):
    raw = spark.createDataFrame(
        [
            ("u2", "2009-05-04T13:06:10Z", "t", "T", "a", "A"),
            ("u1", "2009-05-04T13:06:09Z", "t", "T", "a", "A"),
            ("u3", "bad", "t", "T", "a", "A"),
            ("u4", "2009-05-04T13:06:09Z", "gone", "T", "a", "A"),
        ],
        "user_id string, timestamp string, musicbrainz_track_id string, track_name string, musicbrainz_artist_id string, artist_name string",
    )
    songs = spark.createDataFrame([("t", None)], "_id string, duration double")
    log, users = jobs.prepare_history(raw, songs, AS_OF)
    got = log.collect()
    assert [r["user_id"] for r in got] == ["u1", "u2"]
    assert got[0]["duration"] == 300.0 and got[0]["action"] == "complete"
    assert sorted(r["_id"] for r in users.collect()) == ["u1", "u2"]


def test_sync_master_keeps_trained_vectors(spark, tmp_path):
    users = spark.createDataFrame([("1", "old", [1.0])], "_id string, username string, latent_vector array<float>")
    path = tmp_path / "users.jsonl"
    path.write_text('{"user_id": "1", "username": "new", "latent_vector": null}\n{"_id": "2", "username": "b"}\nx\n')
    table, profile, rejected = jobs.sync_master(
        conform(users, USERS), str(path), USERS, ("user_id", "_id", "id"), ("latent_vector",)
    )
    got = {r["_id"]: r for r in table.collect()}
    assert got["1"]["username"] == "new" and got["1"]["latent_vector"] == [1.0]
    assert got["2"]["latent_vector"] is None and rejected.count() == 1
    assert profile.filter("field = 'username'").first()["n_values"] == 2


def test_clean_catalogue(spark):
    songs = conform(spark.createDataFrame([("a", "words"), ("b", None)], "_id string, lrclib_plain_lyrics string"), SONGS)
    songs = songs.withColumns({"lrclib_fetched": F.lit(True), "lrclib_not_found": F.lit(None).cast("boolean")})
    vecs = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<float>")
    kept, items, lyr, export = jobs.clean_catalogue(songs, vecs, vecs)
    for df in (kept, export):
        assert [r["_id"] for r in df.collect()] == ["a"]
    for df in (items, lyr):
        assert [r["id"] for r in df.collect()] == ["a"]


def test_serve_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    ids = [f"s{i:02d}" for i in range(60)]
    songs = conform(
        spark.createDataFrame([(i, f"song {i}", k) for k, i in enumerate(ids)], "_id string, track_name string, plays_7d int"),
        SONGS,
    )
    vecs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in ids], "id string, embedding array<float>")
    requests = spark.createDataFrame(
        [("f", "feed", "u", None, None), ("f2", "feed", "u", None, None)]
        + [(u, "feed", u, None, None) for u in ("full", "ghost", "capped")]
        + [("n", "next", "u", "s05", None), ("s", "search", None, None, "s07 song")],
        "query_id string, kind string, user_id string, current_song_id string, text string",
    )
    kind = "user_id string, id string, position long, queued boolean, served_at long"
    feeds = spark.createDataFrame(
        [("u", "s01", 1, False, 5)]
        + [("full", f"s{i:02d}", i + 1, True, 5) for i in range(25)]
        + [("ghost", f"x{i}", i, True, 5) for i in range(20)]
        + [("capped", f"o{i}", i, False, 5) for i in range(498)]
        + [("capped", f"s{i:02d}", 500 + i, True, 5) for i in range(3)],
        kind,
    )
    served = spark.createDataFrame([("u", "s01", 1, False, 5)], kind)
    tastes = spark.createDataFrame([("u", True, [1.0, 0.0, 0.0])], "user_id string, has_long boolean, vector array<double>")
    search.publish_postings(songs, str(tmp_path / "postings"))
    index = search.read_postings(spark, str(tmp_path / "postings"))
    state = jobs.Tables(songs, vecs, vecs, tastes, feeds, served, index)
    out = jobs.serve_batch(requests, state, 5, 1, 9)

    def pages(df):
        got = {}
        for r in sorted(df.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["id"], r["has_more"]))
        return got

    one, following = pages(out.feeds), pages(out.following)
    assert one["full"] == [(f"s{i:02d}", True) for i in range(5)]  # nothing generated
    assert one["capped"] == [(f"s{i:02d}", False) for i in range(3)]
    assert "ghost" not in one  # its first ids have no song
    assert len(one["f"]) == 5 and len(one["f2"]) == 5 and len(following["n"]) == 5
    assert not {i for i, _ in one["f"]} & {i for i, _ in one["f2"]}
    waiting = {r["user_id"]: r["n_queued"] for r in feed.feed_state(out.feed_served).collect()}
    assert waiting == {"u": 49, "full": 20, "ghost": 15, "capped": 0}
    # The next batch goes on where this one ended.
    again = jobs.serve_batch(
        requests, jobs.Tables(songs, vecs, vecs, tastes, out.feed_served, out.playlist_served, index), 5, 1, 10
    )
    two = pages(again.feeds)
    seen = {i for q in ("f", "f2") for i, _ in one[q]}
    assert len(two["f"]) == 5 and not seen & {i for q in ("f", "f2") for i, _ in two[q]}
    assert not {i for i, _ in following["n"]} & {i for i, _ in pages(again.following)["n"]}
    assert two["full"] == [(f"s{i:02d}", True) for i in range(5, 10)]
    got = out.found.orderBy("rank").collect()
    assert got[0]["id"] == "s07" and len(got) == 5 and got[0]["has_more"]


def test_incremental_job_counts_once(spark, tmp_path):
    songs, kept = str(tmp_path / "songs"), str(tmp_path / "counts")
    tables.publish(conform(spark.createDataFrame([("t0",)], "_id string"), SONGS), songs)
    log = clustered_log(spark).filter("timestamp >= 0")
    newest = log.agg(F.max("timestamp")).first()[0]
    assert jobs.run_incremental(log, kept) == newest
    assert jobs.run_incremental(log, kept) is None

    def total():
        return jobs.song_counters(spark, songs, kept).agg(F.sum("plays_cumulative")).first()[0]

    expected = log.filter("action <> 'skip' and timestamp > 0").count()
    assert total() == expected
    jobs.fold_counts(spark, songs, kept)
    assert total() == expected and tables.read_table(spark, songs).agg(F.sum("plays_cumulative")).first()[0] == expected
    jobs.fold_counts(spark, songs, kept)
    assert total() == expected
    assert tables.delta_mark(spark, kept, jobs.INCREMENTAL_JOB) == newest


def test_a_counting_run_that_dies_counts_once_when_repeated(spark, tmp_path, monkeypatch):
    songs, kept = str(tmp_path / "songs"), str(tmp_path / "counts")
    tables.publish(conform(spark.createDataFrame([("t0",)], "_id string"), SONGS), songs)
    log = clustered_log(spark).filter("timestamp >= 0")
    create = type(spark).createDataFrame

    def dies(*_, **__):
        raise RuntimeError("lost before the log row")

    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        tables.append_delta(log.select("track_id"), kept, jobs.INCREMENTAL_JOB, 0, 5)
    monkeypatch.setattr(type(spark), "createDataFrame", create)
    jobs.run_incremental(log, kept)
    total = jobs.song_counters(spark, songs, kept).agg(F.sum("plays_cumulative")).first()[0]
    assert total == log.filter("action <> 'skip' and timestamp > 0").count()


def test_stream_deltas_fold_once(spark, tmp_path):
    songs, deltas = str(tmp_path / "songs"), str(tmp_path / "deltas")
    tables.publish(conform(spark.createDataFrame([("a",)], "_id string"), SONGS), songs)
    for batch in range(3):
        rows = spark.createDataFrame([("a", 1), ("b", 2)], "track_id string, plays long")
        rows.write.parquet(f"{deltas}/batch_id={batch}")
    for upto in (0, 2, 2):
        jobs.fold_stream_counts(spark, songs, deltas, upto)
    got = {r["_id"]: r["plays_cumulative"] for r in tables.read_table(spark, songs).collect()}
    assert got == {"a": 3, "b": 6}


def test_serving_works_on_the_sessions_of_those_who_ask(spark):
    """The queues of all others stay, each id once; before, they were refilled and counted with the rest."""
    rows = [("a", "s1", 1, True, 5), ("b", "s1", 1, True, 5), ("b", "s1", 2, False, 6), (None, "s2", 1, True, 5)]
    table = spark.createDataFrame(rows, "user_id string, id string, position long, queued boolean, served_at long")
    asks = spark.createDataFrame([("q", "a"), ("r", "a"), ("t", None)], "query_id string, user_id string")
    served, others = jobs._of_users(table, asks)
    assert [tuple(r) for r in served.collect()] == [rows[0]]
    left = jobs._without_new(others, 9)
    assert {tuple(r) for r in left.collect()} == {("b", "s1", 2, True, 6), rows[3]}
