import json
from datetime import date

from earshot.operators import counts, events

ARRIVAL = 1_700_000_000_000


def payload(**changes):
    base = {
        "user_id": "u",
        "track_id": "t",
        "timestamp": 5,
        "action": "listen",
        "source": "real_user",
        "duration": 3,
        "total_duration": 4,
    }
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v != "absent"})


def split(spark, *payloads):
    df = spark.createDataFrame([(p,) for p in payloads], "value string")
    valid, rejected = events.validate_events(events.parse_events(df), ARRIVAL)
    return valid.collect(), {r["payload"]: r["reason"] for r in rejected.collect()}


def test_valid_events_are_completed(spark):
    valid, rejected = split(
        spark,
        payload(),
        payload(user_id=7, timestamp=0),
        payload(timestamp=None, duration="absent"),
        payload(duration="3"),
    )
    assert rejected == {}
    assert sorted(v["timestamp"] for v in valid) == [5, 5, ARRIVAL, ARRIVAL]
    assert sorted(v["duration"] for v in valid) == [0.0, 3.0, 3.0, 3.0]
    assert {v["user_id"] for v in valid} == {"u", "7"}


def test_broken_events_are_kept_apart_with_a_reason(spark):
    broken = {
        "garbage": "malformed",
        payload(user_id="absent"): "user_id missing",
        payload(track_id=None): "track_id missing",
        payload(action="dance"): "action unknown",
        payload(source="bot"): "source unknown",
        payload(duration="soon"): "duration unreadable",
        payload(timestamp="noon"): "timestamp unreadable",
    }
    valid, rejected = split(spark, payload(), *broken)
    assert rejected == broken and len(valid) == 1


def test_null_payload_is_rejected(spark):
    valid, rejected = split(spark, None)
    assert valid == [] and rejected == {None: "user_id missing"}


def test_encode_round_trip(spark):
    valid, _ = split(spark, payload(duration=3), payload(user_id="é"))
    df = spark.createDataFrame(valid)
    again, rejected = events.validate_events(events.parse_events(events.encode_events(df)), ARRIVAL)
    assert sorted(again.collect()) == sorted(valid) and rejected.isEmpty()


LOG = "user_id string, track_id string, timestamp long, action string"


def dated(spark, rows):
    return events.with_event_date(spark.createDataFrame(rows, LOG))


def test_last_days_keeps_full_days_and_the_current_one(spark):
    day = 86_400_000
    rows = [("u", "t", i * day, "listen") for i in range(20)]
    got = events.last_days(dated(spark, rows), date(1970, 1, 15), 7)
    assert sorted(r["timestamp"] // day for r in got.collect()) == list(range(7, 20))
    closed = events.last_days(dated(spark, rows), date(1970, 1, 15), 7, date(1970, 1, 15))
    assert closed.count() == 8


def test_since_mark_is_strict(spark):
    rows = [("u", "t", ts, "listen") for ts in (9, 10, 10, 11)]
    assert [r["timestamp"] for r in events.since_mark(dated(spark, rows), 10).collect()] == [11]


def test_rebase_keeps_gaps(spark):
    df = spark.createDataFrame([(100,), (150,), (400,)], "timestamp long")
    got = [r[0] for r in events.rebase_time(df, 10_000, 1_000).collect()]
    assert got == [9_000, 9_050, 9_300]


def test_replay_defaults(spark):
    df = spark.createDataFrame([(1, "a", 5, None), (None, "b", 6, 2.9)], "user_id int, track_id string, timestamp long, duration double")
    [row] = events.replay_events(df).collect()
    assert row.asDict() == {
        "user_id": "1",
        "track_id": "a",
        "timestamp": 5,
        "action": "complete",
        "source": "simulation",
        "duration": 300,
        "total_duration": 300,
    }


def test_incremental_counts_over_any_split_equal_one_pass(spark):
    actions = ("listen", "skip", "complete")
    rows = [("u", f"t{i % 5}", 1000 + i * 7, actions[i % 3]) for i in range(200)]
    log = dated(spark, rows)
    songs = spark.createDataFrame([("t0", 0, 0)], "_id string, plays_7d int, plays_cumulative long")
    whole, _ = counts.incremental_counts(log, 0)
    expected = sorted(counts.add_counts(songs, whole).collect())
    mark, table = 0, songs
    for end in (1300, 1301, 1999, 10_000):
        fresh, new_mark = counts.incremental_counts(log.filter(f"timestamp <= {end}"), mark)
        table = counts.add_counts(table, fresh)
        row = new_mark.first()
        mark = mark if row is None else row[0]
    assert sorted(table.collect()) == expected
    assert mark == 1000 + 199 * 7


def test_only_skips_move_the_mark_but_count_nothing(spark):
    fresh, mark = counts.incremental_counts(dated(spark, [("u", "t", 50, "skip")]), 10)
    assert fresh.isEmpty() and mark.first()[0] == 50
    fresh, mark = counts.incremental_counts(dated(spark, [("u", "t", 5, "listen")]), 10)
    assert fresh.isEmpty() and mark.isEmpty()


def test_resync_zeroes_songs_without_plays_and_adds_new_ones(spark):
    songs = spark.createDataFrame([("a", 9, 9), ("b", 9, 9)], "_id string, plays_7d int, plays_cumulative long")
    trend = spark.createDataFrame([("a", 3), ("c", 1)], "track_id string, plays long")
    got = sorted(tuple(r) for r in counts.resync_trending(songs, trend).collect())
    assert [g[:2] for g in got] == [("a", 3), ("b", 0), ("c", 1)]


def test_lake_filters_reach_the_scan(spark, tmp_path):
    from earshot.sources.lake import read_lake, write_lake

    rows = [("u", "t", i * 43_200_000, "listen") for i in range(20)]
    write_lake(spark.createDataFrame(rows, LOG), str(tmp_path / "lake"))
    lake = read_lake(spark, str(tmp_path / "lake"))
    plan = counts.play_counts(events.since_mark(lake, 400_000_000))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in shown.splitlines() if "FileScan" in line)
    filters, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "date_str" in filters
    assert "GreaterThan(timestamp,400000000)" in pushed
    assert "duration" not in scan.split("ReadSchema: ")[1]
    assert sum(r["plays"] for r in plan.collect()) == sum(1 for r in rows if r[2] > 400_000_000)
