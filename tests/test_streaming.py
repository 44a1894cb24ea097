import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import counts, player, sessions
from earshot.plans import jobs
from earshot.sources.lake import read_lake
from earshot.streaming import ingest, short_term
from earshot.streaming import counts as stream_counts
from earshot.streaming import player as stream_player

NOW = {"availableNow": True}
LOG = "user_id string, track_id string, timestamp long, action string"


@pytest.fixture(autouse=True)
def no_empty_batches(spark):
    """A processing-time timeout asks for empty batches for ever; these runs must end."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def event(i, **changes):
    base = {
        "user_id": f"u{i % 3}",
        "track_id": f"t{i % 4}",
        "timestamp": 1_700_000_000_000 + i * 40_000_000,
        "action": ("listen", "skip", "complete")[i % 3],
        "source": "simulation",
        "duration": 10,
        "total_duration": 20,
    }
    return json.dumps({**base, **changes})


def test_ingest_lands_valid_events_once_and_quarantines_the_rest(spark, tmp_path):
    src, out, bad, ckpt = (str(tmp_path / n) for n in ("src", "lake", "bad", "ckpt"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1.json").write_text("\n".join([event(0), event(1), "garbage", event(2, action="x")]))

    def run():
        jobs.run_ingest(spark, {"path": src}, out, bad, ckpt, "text", NOW).awaitTermination()

    run()
    (tmp_path / "src" / "2.json").write_text("\n".join([event(3), event(4)]))
    run()
    run()
    lake = read_lake(spark, out)
    assert lake.count() == 4
    days = {str(r["date_str"]) for r in lake.select("date_str").distinct().collect()}
    assert days == {"2023-11-14", "2023-11-15", "2023-11-16"}
    reasons = {r["reason"] for r in spark.read.parquet(bad).collect()}
    assert reasons == {"malformed", "action unknown"}


def test_repeats_can_be_dropped(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1.json").write_text("\n".join([event(0), event(0), event(1)]))
    stream = ingest.read_event_stream(spark, "text", path=str(tmp_path / "src"))
    lake, bad = str(tmp_path / "lake"), str(tmp_path / "bad")
    ingest.ingest_stream(stream, lake, bad, str(tmp_path / "c"), NOW, "1 hour").awaitTermination()
    assert read_lake(spark, lake).count() == 2


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    lake, bad = str(tmp_path / "lake"), str(tmp_path / "bad")
    lines = spark.createDataFrame([(event(i),) for i in range(4)] + [("{",)], "value string")
    for _ in range(2):
        ingest.write_batch(ingest.land(lines), 7, lake, bad)
    ingest.write_batch(ingest.land(lines.limit(1)), 8, lake, bad)
    assert read_lake(spark, lake).count() == 5 and spark.read.parquet(bad).count() == 1


def test_streams_with_their_own_checkpoints_share_a_lake(spark, tmp_path):
    lake, bad = str(tmp_path / "lake"), str(tmp_path / "bad")
    for name, lines in (("a", [event(0), "{"]), ("b", [event(1), "["])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(lines))

    def run(name, ckpt):
        stream = ingest.read_event_stream(spark, "text", path=str(tmp_path / name))
        ingest.ingest_stream(stream, lake, bad, str(tmp_path / ckpt), NOW).awaitTermination()
        return read_lake(spark, lake).count(), spark.read.parquet(bad).count()

    assert run("a", "c1") == (1, 1)
    assert run("b", "c2") == (2, 2)
    # A restart from the same checkpoint: the replay of its last batch replaces itself.
    for commit in (tmp_path / "c2" / "commits").iterdir():
        commit.unlink()
    assert run("b", "c2") == (2, 2)


def test_late_plays_neither_move_time_back_nor_restart(spark):
    songs = np.eye(3)
    vector, last = short_term.fold_plays(None, 0, np.array([10_000_000]), songs[:1], 0.7, 3_600_000)
    late, at = short_term.fold_plays(vector, last, np.array([7_000_000]), songs[1:2], 0.7, 3_600_000)
    assert at == 10_000_000 and late == pytest.approx([0.7, 0.3, 0])
    same, at = short_term.fold_plays(late, at, np.array([5_000_000]), songs[2:], 0.7, 3_600_000)
    assert at == 10_000_000 and same is late
    after, at = short_term.fold_plays(late, at, np.array([10_700_000]), songs[2:], 0.7, 3_600_000)
    assert at == 10_700_000 and after == pytest.approx([0.49, 0.21, 0.3])


def test_late_player_events_give_no_negative_time():
    def fold(state, *events):
        kinds, ts = np.array([k for k, _ in events]), np.array([t for _, t in events], np.int64)
        return stream_player.fold_events(state, kinds, ts, 30_000)

    state, reading = fold((0, -1, -1, 0), ("play", 50_000))
    state, reading = fold(state, ("pause", 20_000))
    assert reading == 0 and state == (0, -1, -1, 50_000)
    state, reading = fold(state, ("play", 60_000), ("snapshot", 80_000), ("play", 85_000), ("pause", 95_000))
    assert reading == 10_000 and state[2] == -1
    state, reading = fold(state, ("play", 100_000))
    state, reading = fold(state, ("snapshot", 125_000))
    assert reading == 35_000 and state[2] == 120_000
    state, reading = fold(state, ("reset", 130_000))
    assert reading == 0 and state[:2] == (0, -1)


def log_stream(spark, tmp_path, rows, schema, n_files, order):
    """Rows as a stream, one file per micro-batch, in time order."""
    folder = tmp_path / "files"
    rows = sorted(rows, key=lambda r: r[order])
    step = -(-len(rows) // n_files)
    for n in range(n_files):
        part = spark.createDataFrame(rows[n * step : (n + 1) * step], schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run_updates(stream, tmp_path):
    """Run an update-mode stream to the end; keep every micro-batch's rows."""
    out = str(tmp_path / "updates")
    query = (
        stream.writeStream.foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}")
        )
        .outputMode("update")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_count_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"u{i % 3}", f"t{rng.randrange(4)}", i, rng.choice(["listen", "skip", "complete"])) for i in range(90)]
    stream = log_stream(spark, tmp_path, rows, LOG, 3, 2)
    target = str(tmp_path / "deltas")
    stream_counts.count_stream(stream, target, str(tmp_path / "c"), NOW).awaitTermination()
    batch = sorted(counts.play_counts(spark.createDataFrame(rows, LOG)).collect())
    assert sorted(stream_counts.read_counts(spark, target).collect()) == batch
    first = spark.read.parquet(str(tmp_path / "files")).filter("timestamp < 30")
    stream_counts.write_deltas(first, 0, target)
    assert sorted(stream_counts.read_counts(spark, target).collect()) == batch
    parts = [stream_counts.read_counts(spark, target, -1, 0), stream_counts.read_counts(spark, target, 0)]
    both = parts[0].unionByName(parts[1]).groupBy("track_id").agg(F.sum("plays").alias("plays"))
    assert sorted(both.collect()) == batch


def test_short_term_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    ts, rows = 0, []
    for _ in range(120):
        ts += rng.choice([1000, 600_000, 3_599_999, 3_600_000])
        rows.append((rng.choice(["hot", "hot", "u"]), f"t{rng.randrange(5)}", ts, "listen"))
    vecs = np.random.default_rng(1).normal(size=(4, 3))
    items = spark.createDataFrame(
        [(f"t{i}", [float(x) for x in v]) for i, v in enumerate(vecs)], "id string, embedding array<float>"
    )
    stream = log_stream(spark, tmp_path, rows, LOG, 4, 2)
    got = run_updates(short_term.short_term_stream(stream, items), tmp_path)
    batch = sessions.short_term_vectors(spark.createDataFrame(rows, LOG), items, dim=3)
    want = {r["user_id"]: r for r in batch.orderBy("session_no").collect()}
    last = {r["user_id"]: r for r in got.orderBy("last_ts").collect()}
    assert set(last) == set(want)
    for user, row in last.items():
        assert row["last_ts"] == want[user]["last_ts"]
        assert row["vector"] == pytest.approx(want[user]["vector"], abs=1e-9)


def test_short_term_stream_deals_users_to_groups(spark, tmp_path):
    rng = random.Random(5)
    users = [f"u{i}" for i in range(20)]
    # A user who is in no batch after the first stays as they were.
    rows, ts = [("early", "t1", 1, "listen"), (None, "t2", 2, "listen")], 10
    for _ in range(200):
        ts += rng.choice([1000, 900_000])
        rows.append((rng.choice(users), f"t{rng.randrange(4)}", ts, "listen"))
    items = spark.createDataFrame(
        [(f"t{i}", [float(i), 1.0, -float(i)]) for i in range(4)], "id string, embedding array<float>"
    )
    stream = log_stream(spark, tmp_path, rows, LOG, 4, 2)
    got = run_updates(short_term.short_term_stream(stream, items, groups=2), tmp_path)
    batch = sessions.short_term_vectors(spark.createDataFrame(rows, LOG), items, dim=3)
    want = {r["user_id"]: r for r in batch.orderBy("session_no").collect()}
    last = {r["user_id"]: r for r in got.orderBy("last_ts").collect()}
    assert set(last) == {*users, "early", None}
    assert last[None]["vector"] == [2.0, 1.0, -2.0]
    for user in (*users, "early"):
        assert last[user]["last_ts"] == want[user]["last_ts"]
        assert last[user]["vector"] == pytest.approx(want[user]["vector"], abs=1e-6)


def test_listen_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "play_id string, ts_ms long, kind string"
    rows = []
    for p in range(20):
        for t in sorted(rng.sample(range(0, 200_000, 500), 8)):
            rows.append((f"p{p}", t, rng.choice(["play", "play", "pause", "snapshot", "reset"])))
    stream = log_stream(spark, tmp_path, rows, schema, 4, 1)
    got = run_updates(stream_player.listen_stream(stream), tmp_path).orderBy("ts_ms").collect()
    last = {r["play_id"]: r for r in got}
    df = spark.createDataFrame(rows, schema)
    read = {r["play_id"]: r["listen_ms"] for r in player.listen_time(df).collect()}
    hits = {r["play_id"]: r["qualified_ms"] for r in player.qualified_listens(df).collect()}
    assert {p: r["listen_ms"] for p, r in last.items()} == read
    assert {p: r["qualified_ms"] for p, r in last.items() if r["qualified_ms"] is not None} == hits
