from datetime import date

import pytest
from pyspark.sql import functions as F

from earshot.operators import catalogue, merge
from earshot.schemas import SONGS, USERS
from earshot.sources import lake, master, tables

T = "_id string, a string, b int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_set_touches_only_given_columns(spark):
    target = spark.createDataFrame([("1", "x", 1), ("2", "y", 2), ("3", "z", 3)], T)
    updates = spark.createDataFrame(
        [("1", "new", 5), ("2", None, 6), ("9", "made", 7)], "_id string, a string, o int"
    )
    got = merge.merge_set(target, updates, "_id", ["a"])
    assert rows(got) == [("1", "new", 1), ("2", None, 2), ("3", "z", 3), ("9", "made", None)]
    kept = merge.merge_set(target, updates, "_id", ["a"], skip_null=["a"])
    assert ("2", "y", 2) in rows(kept)


def test_merge_set_takes_the_last_of_repeated_keys(spark):
    target = spark.createDataFrame([("1", "x", 1)], T)
    updates = spark.createDataFrame([("1", "late", 9), ("1", "zzz", 3)], "_id string, a string, o int")
    got = merge.merge_set(target, updates, "_id", ["a"], order=F.col("o"))
    assert rows(got) == [("1", "late", 1)]


def test_merge_set_adds_new_columns(spark):
    target = spark.createDataFrame([("1", "x", 1)], T)
    updates = spark.createDataFrame([("1", True)], "_id string, flag boolean")
    assert merge.merge_set(target, updates, "_id", ["flag"]).first()["flag"] is True


def test_merge_inc_sums_repeats_and_starts_at_zero(spark):
    target = spark.createDataFrame([("1", "x", 1), ("2", "y", None), ("3", "z", None)], T)
    deltas = spark.createDataFrame([("1", 2), ("1", 3), ("2", 4), ("9", 5)], "_id string, b int")
    got = merge.merge_inc(target, deltas, "_id", ["b"])
    assert rows(got) == [("1", "x", 6), ("2", "y", 4), ("3", "z", None), ("9", None, 5)]


def test_cascade_delete_and_lookup(spark):
    songs = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], T)
    vecs = spark.createDataFrame([("1",), ("3",)], "id string")
    gone = spark.createDataFrame([("1",)], "_id string")
    kept, left = merge.cascade_delete(gone, (songs, "_id"), (vecs, "id"))
    assert rows(kept) == [("2", "y", 2)] and rows(left) == [("3",)]
    assert rows(merge.lookup(songs, "2")) == rows(merge.lookup(songs, gone.select(F.lit("2"))))


def test_profile_names_types(spark):
    df = spark.createDataFrame([("1", None, [1], (2,)), (None, None, [], (3,))], "a string, b int, c array<int>, d struct<x:int>")
    assert rows(merge.profile_table(df)) == [
        (2, "a", "string", 1),
        (2, "b", "Null", 0),
        (2, "c", "Array", 2),
        (2, "d", "Object", 2),
    ]


def test_versions_are_published_and_replays_change_nothing(spark, tmp_path):
    root = str(tmp_path / "songs")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root)
    first = spark.createDataFrame([("1", "x", 1)], T)
    assert tables.publish(first, root) == 1
    merged = merge.merge_inc(tables.read_table(spark, root), first.select("_id", "b"), "_id", ["b"])
    assert tables.publish(merged, root) == 2
    assert tables.publish(merged.filter(F.lit(True)), root, 2) == 2
    assert rows(tables.read_table(spark, root)) == [("1", "x", 2)]
    assert tables.current_version(spark, root) == 2


def test_marks_only_grow(spark, tmp_path):
    root = str(tmp_path / "control")
    assert tables.read_mark(spark, root, "job") == 0
    for ts in (50, 90, 70):
        tables.advance_mark(spark, root, "job", ts)
    assert tables.read_mark(spark, root, "job") == 90
    assert tables.read_mark(spark, root, "other") == 0


def test_vectors_are_checked(spark, tmp_path):
    good = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    tables.write_vectors(good, str(tmp_path / "v"), 2)
    assert tables.read_table(spark, str(tmp_path / "v")).schema["embedding"].dataType.simpleString() == "array<float>"
    for bad in ([("a", [1.0])], [("a", [1.0, 2.0]), ("a", [3.0, 4.0])], [(None, [1.0, 2.0])]):
        df = spark.createDataFrame(bad, "id string, embedding array<double>")
        with pytest.raises(Exception, match="vector"):
            tables.checked_vectors(df, 2).collect()


def test_append_vectors_adds_only_missing(spark):
    old = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    new = spark.createDataFrame([("a", [9.0]), ("b", [2.0])], "id string, embedding array<float>")
    assert rows(tables.append_vectors(new, old, 1)) == [("a", [1.0]), ("b", [2.0])]


def test_master_file_is_read_leniently(spark, tmp_path):
    path = tmp_path / "songs.jsonl"
    path.write_text(
        '{"_id": "1", "track_name": "a", "plays_7d": "12", "duration": "300"}\n'
        "\n   \n"
        "{broken\n"
        '{"track_name": "no id"}\n'
        '{"id": 7, "_id": "other", "plays_7d": 3, "extra": {"x": 1}}\n'
        '{"id": "", "_id": "5"}\n'
        "[1, 2]\n",
        encoding="utf-8",
    )
    good, rejected = master.read_master_jsonl(spark, str(path), SONGS)
    assert good.schema == SONGS
    got = {r["_id"]: r for r in good.collect()}
    assert set(got) == {"1", "7", "5"}
    assert (got["1"]["plays_7d"], got["1"]["duration"], got["7"]["plays_7d"]) == (12, 300.0, 3)
    reasons = [r["reason"] for r in rejected.orderBy("reason").collect()]
    assert reasons.count("malformed") >= 1 and "id missing" in reasons and len(reasons) == 3


def test_jsonl_round_trip_keeps_nulls_and_types(spark, tmp_path):
    songs = spark.createDataFrame([("1", "é\n", 5)], "_id string, track_name string, plays_7d int")
    lake.write_jsonl(catalogue.clean_songs(merge_full(songs)), str(tmp_path / "out"))
    good, rejected = master.read_master_jsonl(spark, str(tmp_path / "out"), SONGS)
    row = good.first()
    assert rejected.isEmpty()
    assert (row["track_name"], row["plays_7d"], row["duration"]) == ("é\n", 5, 300.0)


def merge_full(songs):
    from earshot.schemas import conform

    return conform(songs, SONGS)


def test_history_skips_hidden_files(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    df.write.parquet(str(tmp_path / "h"))
    for name in ("_tmp.parquet", ".hidden.parquet"):
        (tmp_path / "h" / name).write_bytes(b"not parquet")
    assert lake.read_history(spark, str(tmp_path / "h")).count() == 1


def test_sorted_history_is_ordered_across_files(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("timestamp"))
    ordered = lake.sort_history(df).select("timestamp", F.spark_partition_id().alias("p"))
    got = ordered.collect()
    assert [r["timestamp"] for r in got] == list(range(1000))


def test_write_table_has_the_exact_schema(spark, tmp_path):
    df = spark.createDataFrame([("5", "u", "x")], "_id string, username string, junk string")
    lake.write_table(df, str(tmp_path / "u"), USERS)
    assert [f.dataType for f in spark.read.parquet(str(tmp_path / "u")).schema] == [
        f.dataType for f in USERS
    ]


S = (
    "_id string, duration double, release_date date, lrclib_plain_lyrics string, "
    "lrclib_synced_lyrics string, lrclib_id long, lrclib_fetched boolean, "
    "lrclib_not_found boolean, release_date_checked boolean, plays_cumulative long"
)


def song(i, lyrics=None, fetched=None, lost=None, checked=None, plays=0):
    return (i, 10.0, None, lyrics, None, None, fetched, lost, checked, plays)


def test_enrichment_cycle(spark):
    songs = spark.createDataFrame(
        [
            song("never", plays=1),
            song("found", "la", True, False, True),
            song("lost", None, True, True, None, 9),
            song("empty", "", True, False, True),
            song("later", None, True, True, None, 5),
        ],
        S,
    )
    todo = [r["_id"] for r in catalogue.enrichment_pending(songs).collect()]
    assert todo == ["lost", "later", "never"]
    assert [r["_id"] for r in catalogue.enrichment_pending(songs, 1).collect()] == ["lost"]
    fetched = spark.createDataFrame(
        [
            ("later", "second", None, 2, 1.0, None, 2),
            ("later", "words", "sync", 1, 0.0, date(2020, 1, 2), 1),
            ("lost", None, None, None, None, None, None),
            ("never", "", None, 3, 5.0, None, 1),
            ("unknown", "words", None, 4, 5.0, None, 1),
        ],
        "_id string, plain_lyrics string, synced_lyrics string, lrclib_id long, duration double, release_date date, rank int",
    )
    merged, report = catalogue.merge_lyrics(songs, fetched)
    got = {r["_id"]: r for r in merged.collect()}
    assert set(got) == {"never", "found", "lost", "empty", "later"}
    later = got["later"]
    assert later["lrclib_plain_lyrics"] == "words" and later["duration"] == 300.0
    assert later["release_date"] == date(2020, 1, 2) and later["lrclib_id"] == 1
    assert (later["lrclib_fetched"], later["lrclib_not_found"]) == (True, False)
    assert (got["never"]["lrclib_fetched"], got["never"]["lrclib_not_found"]) == (True, True)
    assert got["never"]["duration"] == 10.0
    assert tuple(report.first()) == (4, 2, 2, 50.0)
    missing = {r["_id"] for r in catalogue.missing_lyrics(merged).collect()}
    assert missing == {"never", "lost", "empty"}


def test_report_without_outcomes(spark):
    empty = spark.createDataFrame([], "found boolean")
    assert tuple(catalogue.enrichment_report(empty).first()) == (0, 0, 0, None)


def test_gate_counts_the_stripped_text_and_cuts_the_raw_one(spark):
    df = spark.createDataFrame(
        [(1, " \n" + "a" * 50 + "\t"), (2, " " * 60 + "a" * 49), (3, "b" * 6000), (4, None)],
        "i int, t string",
    )
    got = {r["i"]: len(r["t"]) for r in catalogue.gate_text(df, "t", max_chars=5000).collect()}
    assert got == {1: 53, 3: 5000}
    whole = {r["i"]: len(r["t"]) for r in catalogue.gate_text(df, "t").collect()}
    assert whole == {1: 53, 3: 6000}


def test_clean_songs_falls_back(spark):
    df = spark.createDataFrame(
        [("1", None, "T", "", "A", 0.0, None, None)],
        "_id string, track_name string, title string, artist_name string, artist string, duration double, plays_7d int, plays_cumulative long",
    ).withColumns(
        {
            "release_date": F.lit(None).cast("date"),
            "lrclib_plain_lyrics": F.lit(None).cast("string"),
        }
    )
    row = catalogue.clean_songs(df).first()
    assert (row["track_name"], row["artist_name"], row["duration"]) == ("T", "A", "300")
    assert (row["plays_7d"], row["plays_cumulative"], row["url"]) == ("0", "0", "")


def test_new_profiles(spark):
    names = spark.createDataFrame([(" Ann ",), ("  ",), (None,), ("Ann",)], "name string")
    got = catalogue.new_profiles(names, date(2024, 1, 1)).collect()
    assert [r["username"] for r in got] == ["Ann", "Ann"]
    assert len({r["_id"] for r in got}) == 2 and got[0]["latent_vector"] is None


def test_resolve_id_prefers_the_first_non_empty(spark):
    df = spark.createDataFrame(
        [("", "b", 1), (None, None, 2), ("u", "b", 3), (None, "", None)], "user_id string, _id string, id int"
    )
    got = sorted(r["_id"] for r in catalogue.resolve_id(df, "user_id", "_id", "id").collect())
    assert got == ["2", "b", "u"]
