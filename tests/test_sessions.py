import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import player, sessions

HOUR = 3_600_000


def fold(plays, vectors, decay, gap):
    """The moving average, play by play: {(user, session): (vector, last ts, plays)}."""
    state, out = {}, {}
    for user, track, ts in sorted(plays, key=lambda p: (p[0], p[2], p[1])):
        if track not in vectors:
            continue
        vec = np.array(vectors[track], dtype=np.float64)
        if user not in state:
            state[user] = (vec, ts, 1, 1)
        else:
            old, last, no, n = state[user]
            if ts - last >= gap:
                state[user] = (vec, ts, no + 1, 1)
            else:
                state[user] = (old * decay + vec * (1 - decay), ts, no, n + 1)
        now = state[user]
        out[(user, now[2])] = (now[0], now[1], now[3])
    return out


def frames(spark, plays, vectors):
    log = spark.createDataFrame(plays, "user_id string, track_id string, timestamp long")
    items = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>")
    return log, items


def random_plays(seed, n):
    rng = random.Random(seed)
    plays, ts = [], 0
    for _ in range(n):
        ts += rng.choice([1, 1000, 60_000, HOUR - 1, HOUR, 3 * HOUR])
        # One user holds most of the plays.
        plays.append((rng.choice(["hot", "hot", "hot", "u"]), f"t{rng.randrange(5)}", ts))
    return plays


@pytest.mark.parametrize("slice_ms", [None, 60_000, 7_777])
def test_short_term_equals_fold(spark, slice_ms):
    rng = np.random.default_rng(1)
    vectors = {f"t{i}": [float(x) for x in rng.normal(size=3)] for i in range(4)}
    plays = random_plays(3, 300)
    log, items = frames(spark, plays, vectors)
    got = sessions.short_term_vectors(log, items, slice_ms=slice_ms, dim=3).collect()
    vectors32 = {k: np.float32(v) for k, v in vectors.items()}
    want = fold(plays, vectors32, 0.7, HOUR)
    assert {(r["user_id"], r["session_no"]) for r in got} == set(want)
    for r in got:
        vec, last, n = want[(r["user_id"], r["session_no"])]
        assert r["vector"] == pytest.approx(vec, abs=1e-12)
        assert (r["last_ts"], r["n_plays"]) == (last, n)


@pytest.mark.parametrize("gap,n_sessions", [(HOUR - 1, 1), (HOUR, 2)])
def test_session_breaks_at_exactly_the_gap(spark, gap, n_sessions):
    log, items = frames(spark, [("u", "a", 5), ("u", "b", 5 + gap)], {"a": [1.0], "b": [0.0]})
    rows = sessions.sessionize(log).collect()
    assert max(r["session_no"] for r in rows) == n_sessions


def test_play_without_vector_does_not_keep_a_session_alive(spark):
    plays = [("u", "a", 0), ("u", "x", HOUR // 2), ("u", "b", HOUR)]
    log, items = frames(spark, plays, {"a": [1.0], "b": [0.0]})
    got = sessions.short_term_vectors(log, items, dim=1).collect()
    assert [r["n_plays"] for r in got] == [1, 1]


def test_long_session_weights_sum_to_one(spark):
    plays = [("u", f"t{i % 7}", i * 1000) for i in range(2000)]
    log, _ = frames(spark, plays, {"a": [1.0]})
    total = sum(r["weight"] for r in sessions.play_weights(log, slice_ms=50_000).collect())
    assert total == pytest.approx(1.0, abs=1e-12)


def test_slices_wider_than_the_gap_are_refused(spark):
    log, _ = frames(spark, [("u", "a", 0)], {"a": [1.0]})
    with pytest.raises(ValueError):
        sessions.sessionize(log, gap_ms=10, slice_ms=11)


def test_only_live_sessions_are_active(spark):
    plays = [("old", "a", 0), ("new", "a", HOUR), ("new", "b", HOUR + 5), ("future", "a", 9 * HOUR)]
    log, items = frames(spark, plays, {"a": [1.0], "b": [0.0]})
    got = sessions.active_short_term(log, items, HOUR + 10, dim=1).collect()
    assert [(r["user_id"], r["short_vector"]) for r in got] == [("new", pytest.approx([0.7]))]


def timer(rows, limit):
    """The play timer, event by event: (reading after the last event, first time at limit)."""
    total, opened, reading, hit = 0, None, 0, None
    rank = {"reset": 0, "pause": 1, "play": 2, "snapshot": 2}
    for ts, kind in sorted(rows, key=lambda r: (r[0], rank[r[1]])):
        now = total + (ts - opened if opened is not None else 0)
        if hit is None and opened is not None and now >= limit:
            hit = opened + max(limit - total, 0)
        if kind == "play":
            opened, reading = ts, total
        elif kind == "pause":
            total, opened, reading = now, None, now
        elif kind == "reset":
            total, opened, reading = 0, None, 0
        else:
            reading = now
    return reading, hit


@pytest.mark.parametrize("slice_ms", [HOUR, 10_000, 1])
def test_player_timer_equals_fold(spark, slice_ms):
    rng = random.Random(5)
    kinds = ["play", "play", "pause", "pause", "snapshot", "reset"]
    events = {}
    for p in range(60):
        times = sorted(rng.sample(range(0, 120_000, 500), rng.randrange(1, 12)))
        events[f"p{p}"] = [(t, rng.choice(kinds)) for t in times]
    edge = {
        "moved": [(0, "play"), (40_000, "play"), (50_000, "pause")],
        "exact": [(0, "play"), (30_000, "pause")],
        "short": [(0, "play"), (29_999, "pause"), (40_000, "snapshot")],
        "pause first": [(0, "pause"), (5, "play"), (10, "snapshot")],
        "read twice": [(0, "play"), (10_000, "snapshot"), (20_000, "pause")],
        "reset": [(0, "play"), (20_000, "reset"), (20_001, "play"), (45_000, "pause")],
        "open": [(0, "play")],
    }
    events.update(edge)
    rows = [(p, t, k) for p, es in events.items() for t, k in es]
    df = spark.createDataFrame(rows, "play_id string, ts_ms long, kind string")
    read = {r["play_id"]: r["listen_ms"] for r in player.listen_time(df, slice_ms).collect()}
    hits = {r["play_id"]: r["qualified_ms"] for r in player.qualified_listens(df, 30, slice_ms).collect()}
    for p, es in events.items():
        reading, hit = timer(es, 30_000)
        assert read[p] == reading, (p, es)
        assert hits.get(p) == hit, (p, es)


def test_many_plays_at_one_moment_are_few_rows_before_any_window(spark):
    """An import without times gives all its plays one arrival stamp."""
    rows = [("hot", f"t{i % 3}", 1_000) for i in range(3_000)] + [("hot", "t0", 2_000), ("u", "t1", 5)]
    log = spark.createDataFrame(rows, "user_id string, track_id string, timestamp long")
    got = {(r["user_id"], r["track_id"]): r for r in sessions.play_weights(log, decay=0.999).collect()}
    order = sorted(r[1] for r in rows[:3_000]) + ["t0"]
    weights = {}
    for k, track in enumerate(order, 1):
        w = 0.999 ** (len(order) - k) * (1 if k == 1 else 1 - 0.999)
        weights[track] = weights.get(track, 0) + w
    for track, w in weights.items():
        assert got["hot", track]["weight"] == pytest.approx(w, rel=1e-9)
        assert got["hot", track]["n_plays"] == 3_001
    assert got["u", "t1"]["weight"] == 1


def test_vectors_of_another_length_fail(spark):
    log = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "user_id string, track_id string, timestamp long")
    items = spark.createDataFrame([("a", [1.0] * 128), ("b", [2.0] * 128)], "id string, embedding array<float>")
    (row,) = sessions.short_term_vectors(log, items).collect()
    assert len(row["vector"]) == 128
    with pytest.raises(Exception, match="not of length 64"):
        sessions.short_term_vectors(log, items, dim=64).collect()


def test_sorted_history_splits_rows_of_one_moment(spark):
    from earshot.sources.lake import sort_history

    rows = [(7, f"u{i:04d}") for i in range(2_000)] + [(1, "a"), (9, "z")]
    df = spark.createDataFrame(rows, "timestamp long, user_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = sort_history(df)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 2_000
    assert [tuple(r) for r in out.collect()] == sorted(rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
