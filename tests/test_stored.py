"""Stored forms: version logs, keyed tables in buckets, counts of days."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from earshot.operators import counts, merge, sessions
from earshot.plans import jobs
from earshot.schemas import SONGS, conform
from earshot.sources import commits, day_counts, keyed, lake, session_log, tables

T = "_id string, a string, b int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, ids, a="x"):
    return spark.createDataFrame([(str(i), a, i) for i in ids], T)


def test_a_version_is_created_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert commits.newest(spark, folder) == 0
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: commits.commit(spark, folder, 1, {"by": i}), range(8)))
    assert won.count(True) == 1
    assert commits.entry(spark, folder, 1) == {"by": won.index(True)}
    assert commits.newest(spark, folder) == 1
    assert [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_")] == []
    assert commits.commit(spark, folder, 1, {"by": "é"}, replace=True)
    assert commits.entry(spark, folder, 1) == {"by": "é"}


def test_a_store_without_links_refuses_to_replace(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    folder = "viewfs://kept/in/log"
    assert commits.commit(spark, folder, 1, {"by": 1})
    assert not commits.commit(spark, folder, 1, {"by": 2})
    assert commits.entry(spark, folder, 1) == {"by": 1}
    assert commits.commit(spark, folder, 1, {"by": 3}, replace=True)
    assert commits.entry(spark, folder, 1) == {"by": 3} and commits.newest(spark, folder) == 1


def test_two_publishers_give_two_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda i: tables.publish(table(spark, [i]), root, marks={f"j{i}": i}), range(4)))
    assert got == [1, 2, 3, 4]
    assert sorted(rows(tables.read_table(spark, root, v))[0][2] for v in got) == [0, 1, 2, 3]
    assert len(tables.read_marks(spark, root)) == 4  # none is lost
    with pytest.raises(tables.Conflict):
        tables.publish(table(spark, [9]), root, base=2)
    assert tables.current_version(spark, root) == 4


def test_updates_that_meet_are_all_kept(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.publish(table(spark, [0]), root)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: tables.update(spark, root, lambda t: t.unionByName(table(spark, [i]))), (1, 2, 3)))
    assert [r[2] for r in rows(tables.read_table(spark, root))] == [0, 1, 2, 3]


def set_a(rows_, changes):
    return merge.merge_set(rows_, changes, "_id", ["a"])


def test_an_update_rewrites_only_the_buckets_it_hits(spark, tmp_path):
    root = str(tmp_path / "k")
    keyed.create_keyed(table(spark, range(400)), root, "_id", 32)
    before = tables.read_entry(spark, root)["files"]
    changes = spark.createDataFrame([("3", "new"), ("5", None), ("900", "made")], "_id string, a string")
    assert keyed.update_keyed(changes, root, set_a, {"job": 7}) == 2
    after = tables.read_entry(spark, root)
    changed = {b for b in after["files"] if after["files"][b] != before.get(b)}
    assert len(before) == 32 and 1 <= len(changed) <= 3 and after["marks"] == {"job": 7}
    want = {str(i): ("x", i) for i in range(400)} | {"3": ("new", 3), "5": (None, 5), "900": ("made", None)}
    assert {r[0]: r[1:] for r in rows(keyed.read_keyed(spark, root))} == want
    assert len(rows(keyed.read_keyed(spark, root, version=1))) == 400  # the version before is whole
    some = spark.createDataFrame([("3",), ("900",), ("none",), ("3",)], "_id string")
    found = keyed.read_keyed(spark, root, some)
    assert {r[0] for r in rows(found)} == {"3", "900"} and len(found.inputFiles()) < 10
    assert keyed.delete_keyed(some, root) == 3
    assert len(rows(keyed.read_keyed(spark, root))) == 399
    assert keyed.update_keyed(changes.limit(0), root, set_a) == 3
    inc = spark.createDataFrame([("7", 5), ("7", 1), ("901", 2)], "_id string, b int")
    keyed.update_keyed(inc, root, lambda t, d: merge.merge_inc(t, d, "_id", ["b"]))
    assert {r[0]: r[2] for r in rows(keyed.read_keyed(spark, root)) if r[0] in ("7", "901")} == {"7": 13, "901": 2}


def test_an_update_may_add_a_column_and_empty_a_bucket(spark, tmp_path):
    root = str(tmp_path / "k")
    keyed.create_keyed(table(spark, range(20)), root, "_id", 4)
    flag = spark.createDataFrame([("1", True), (None, False)], "_id string, flag boolean")
    keyed.update_keyed(flag, root, lambda t, c: merge.merge_set(t, c, "_id", ["flag"]))
    assert sum(r[3] is True for r in rows(keyed.read_keyed(spark, root))) == 1
    everything = keyed.read_keyed(spark, root).select("_id")
    keyed.update_keyed(everything, root, lambda t, c: t.filter(F.lit(False)))
    assert rows(keyed.read_keyed(spark, root)) == [] and tables.read_entry(spark, root)["files"] == {}
    keyed.update_keyed(spark.createDataFrame([("5", "back")], "_id string, a string"), root, set_a)
    assert rows(keyed.read_keyed(spark, root))[0][:2] == ("5", "back")
    with pytest.raises(ValueError, match="other buckets"):
        more = table(spark, range(100)).withColumn("flag", F.lit(None).cast("boolean"))
        keyed.update_keyed(flag.limit(1), root, lambda t, c: more)


def test_an_update_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "k")
    keyed.create_keyed(table(spark, range(50)), root, "_id", 8)
    change = spark.createDataFrame([("1", "new")], "_id string, a string")

    def dies(*_, **__):
        raise RuntimeError("lost before the log file")

    with monkeypatch.context() as patched:
        patched.setattr(commits, "commit", dies)
        with pytest.raises(RuntimeError):
            keyed.update_keyed(change, root, set_a)
    assert tables.current_version(spark, root) == 1
    assert {r[1] for r in rows(keyed.read_keyed(spark, root))} == {"x"}


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "k")
    keyed.create_keyed(table(spark, range(10)), root, "_id", 2)

    def add(i):
        d = spark.createDataFrame([(str(k), 10**i) for k in range(10)], "_id string, b int")
        return keyed.update_keyed(d, root, lambda t, c: merge.merge_inc(t, c, "_id", ["b"]))

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(add, (1, 2, 3))) == [2, 3, 4]
    assert {r[0]: r[2] for r in rows(keyed.read_keyed(spark, root))} == {str(k): k + 1110 for k in range(10)}


def test_trailing_counts_follow_days_and_late_events(spark, tmp_path):
    source, root = str(tmp_path / "lake"), str(tmp_path / "counts")
    draw, first = random.Random(3), date(2024, 1, 1)
    schema = "user_id string, track_id string, timestamp long, action string, source string, duration double, total_duration double"

    def land(day, batch, n, songs=6):
        start = 1_704_067_200_000 + (day - first).days * 86_400_000
        events = [
            ("u", f"t{draw.randrange(songs)}", start + draw.randrange(86_400_000), draw.choice(["listen", "skip", "complete"]), "s", 1.0, 2.0)
            for _ in range(n)
        ]
        lake.write_lake(spark.createDataFrame(events, schema), source, batch)

    changed = {}
    for i in range(12):
        day = first + timedelta(days=i)
        if i != 4:  # a day without events
            land(day, f"day-{i}", 15)
        if i in (6, 9):
            land(day - timedelta(days=3), f"late-{i}", 5, 40)
        if i == 10:
            land(day - timedelta(days=2), f"day-{i - 2}", 8)  # a load that is repeated replaces itself
        changed[i] = day_counts.refresh(spark, source, root, day)
        want = rows(counts.trending_7d(lake.read_lake(spark, source), day))
        assert rows(day_counts.read_trailing(spark, root)) == want
    for i, days in changed.items():
        extra = {6: [3], 9: [6], 10: [8]}.get(i, [])
        assert [(d - first).days for d in days] == extra + ([i] if i != 4 else [])
    assert day_counts.refresh(spark, source, root, first + timedelta(days=11)) == []
    assert day_counts.refresh(spark, source, root, first + timedelta(days=40)) == []
    assert rows(day_counts.read_trailing(spark, root)) == []


def test_jobs_on_a_keyed_song_table(spark, tmp_path):
    songs, kept = str(tmp_path / "songs"), str(tmp_path / "counts")
    blank = spark.createDataFrame([(f"t{i}",) for i in range(60)], "_id string")
    keyed.create_keyed(conform(blank, SONGS), songs, "_id", 16)
    log = spark.createDataFrame(
        [("u", f"t{i % 3}", 1000 + i, "listen") for i in range(30)] + [("u", "new", 2000, "complete")],
        "user_id string, track_id string, timestamp long, action string",
    )
    log = log.withColumn("date_str", F.lit("1970-01-01").cast("date"))
    jobs.run_incremental(log, kept)
    before = tables.read_entry(spark, songs)["files"]
    for _ in range(2):
        jobs.fold_counts(spark, songs, kept)
        got = {r["_id"]: r["plays_cumulative"] for r in keyed.read_keyed(spark, songs).collect() if r["plays_cumulative"]}
        assert got == {"t0": 10, "t1": 10, "t2": 10, "new": 1}
    after = tables.read_entry(spark, songs)["files"]
    assert sum(after[b] != before.get(b) for b in after) <= 4
    trending = spark.createDataFrame([("t0", 10), ("t5", 2)], "track_id string, plays long")
    version = jobs.resync_keyed(trending, songs)
    got = {r["_id"]: r["plays_7d"] for r in keyed.read_keyed(spark, songs).collect() if r["plays_7d"]}
    assert got == {"t0": 10, "t5": 2}
    assert jobs.resync_keyed(trending, songs) == version  # nothing differs


def session_rows(df):
    return {(r["user_id"], r["session_no"]): (r["last_ts"], r["n_plays"], r["vector"]) for r in df.collect()}


def same_sessions(got, want):
    assert got.keys() == want.keys()
    for key, (last, n, vector) in want.items():
        assert got[key][:2] == (last, n) and got[key][2] == pytest.approx(vector, abs=1e-9)


DAY_MS = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01


def play_rows(spark, seed, n=250, step=(0, 1, 60_000, 1_800_000, 3_599_999, 3_600_000, 9_000_000)):
    rng, ts, out = random.Random(seed), T0, []
    for _ in range(n):
        ts += rng.choice(step)
        day = date(2024, 1, 1) + timedelta(days=(ts - T0) // DAY_MS)
        out.append((rng.choice(["hot", "hot", "hot", "u", "v"]), f"t{rng.randrange(5)}", ts, "listen", day))
    schema = "user_id string, track_id string, timestamp long, action string, date_str date"
    vectors = [(f"t{i}", [rng.random() for _ in range(3)]) for i in range(4)]
    return out, spark.createDataFrame(out, schema), spark.createDataFrame(vectors, "id string, embedding array<float>")


@pytest.mark.parametrize("seed", range(2))
def test_sessions_in_any_stretches_equal_one_pass(spark, tmp_path, seed):
    rows_, log, items = play_rows(spark, seed)
    place, root, rng = str(tmp_path / "lake"), str(tmp_path / "s"), random.Random(seed)
    lake.write_lake(log, place, "a")
    times = sorted(r[2] for r in rows_)
    # Cuts at midnights, at plays, in the middle of sessions, twice at one moment, and after the end.
    cuts = {T0 + DAY_MS, times[60], times[61] + 1, times[-1] + 1, times[-1] + 2 * 3_600_000}
    for upto in sorted(cuts | {rng.choice(times) + rng.randrange(2)}) + [times[-1] + 7_200_000]:
        session_log.advance(spark, place, root, items, upto)
        seen = log.filter(F.col("timestamp") < upto)
        want = session_rows(sessions.short_term_vectors(seen, items))
        same_sessions(session_rows(session_log.read_sessions(spark, root)), want)
    left = session_log.read_state(spark, root).collect()
    assert len(left) == 3 and all(r["vector"] is None and r["ended"] for r in left)
    with pytest.raises(ValueError):
        session_log.advance(spark, place, root, items, times[0])


def test_ended_sessions_are_written_once(spark, tmp_path):
    _, log, items = play_rows(spark, 3)
    place, root = str(tmp_path / "lake"), str(tmp_path / "s")
    lake.write_lake(log, place, "a")
    session_log.advance(spark, place, root, items, T0 + 2 * DAY_MS)
    (run,) = tmp_path.glob("s/run-*")
    assert sorted(p.name for p in run.iterdir()) == ["folded", "state"]
    assert session_log.read_sessions(spark, root).count() > 3


def test_a_session_over_midnight_goes_on(spark, tmp_path):
    night = T0 + DAY_MS
    plays = [("u", "t0", night - 1000, "listen", date(2024, 1, 1)), ("u", "t1", night + 1000, "listen", date(2024, 1, 2))]
    _, _, items = play_rows(spark, 0)
    log = spark.createDataFrame(plays, "user_id string, track_id string, timestamp long, action string, date_str date")
    lake.write_lake(log, str(tmp_path / "lake"), "a")
    for upto in (night, night + DAY_MS):
        session_log.advance(spark, str(tmp_path / "lake"), str(tmp_path / "s"), items, upto)
    (row,) = session_log.read_sessions(spark, str(tmp_path / "s")).collect()
    assert (row["session_no"], row["n_plays"], row["last_ts"]) == (1, 2, night + 1000)


def test_a_run_reads_no_older_day_and_late_plays_come_by_an_older_version(spark, tmp_path):
    rows_, log, items = play_rows(spark, 9)
    place, root = str(tmp_path / "lake"), str(tmp_path / "s")
    late = F.col("timestamp") == rows_[30][2]
    lake.write_lake(log.filter(~late), place, "a")
    for days in (1, 2, 30):
        session_log.advance(spark, place, root, items, T0 + days * DAY_MS)
    lake.write_lake(log.filter(late), place, "late")
    session_log.advance(spark, place, root, items, T0 + 30 * DAY_MS)
    want = session_rows(sessions.short_term_vectors(log.filter(~late), items))
    same_sessions(session_rows(session_log.read_sessions(spark, root)), want)
    assert rows_[30][2] < T0 + 2 * DAY_MS
    session_log.advance(spark, place, root, items, T0 + 2 * DAY_MS, base=0)
    session_log.advance(spark, place, root, items, T0 + 30 * DAY_MS)
    want = session_rows(sessions.short_term_vectors(log, items))
    same_sessions(session_rows(session_log.read_sessions(spark, root)), want)


def test_sessions_of_an_empty_lake(spark, tmp_path):
    _, log, items = play_rows(spark, 0)
    lake.write_lake(log, str(tmp_path / "lake"), "a")
    assert session_log.advance(spark, str(tmp_path / "lake"), str(tmp_path / "s"), items, T0) == 1
    assert session_log.read_sessions(spark, str(tmp_path / "s")).count() == 0
