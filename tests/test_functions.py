import hashlib
import urllib.parse

import pytest
from pyspark.sql import functions as F

from earshot.functions import scores, text, time, vector
from earshot.schemas import PLAY_LOG, conform


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_strip_removes_every_white_space(spark):
    rows = [("　\t a b \x1f\n",), ("  ",), (None,)]
    got = values(spark, rows, "s string", text.strip_ws(F.col("s")))
    assert got == [("a b",), ("",), (None,)]
    assert all(c.isspace() for c in text.WHITESPACE)
    assert {c for c in map(chr, range(0x3001)) if c.isspace()} == set(text.WHITESPACE)


@pytest.mark.parametrize("name", ["a b", "é ~*&+/%", "Ünï", "x"])
def test_avatar_matches_percent_encoding(spark, name):
    [(avatar, cover)] = values(
        spark,
        [(name,)],
        "n string",
        text.avatar_url(F.col("n")),
        text.avatar_url(F.col("n"), "cover"),
    )
    colour = hashlib.md5(name.encode()).hexdigest()[:6]
    start = f"https://ui-avatars.com/api/?name={urllib.parse.quote(name)}&background={colour}"
    assert cover == start + "&color=fff&size=512&length=1&bold=true"
    assert avatar == cover + "&font-size=0.7"


def test_avatar_of_empty_name(spark):
    got = values(
        spark,
        [("",), (None,)],
        "n string",
        text.avatar_url(F.col("n")),
        text.avatar_url(F.col("n"), "cover"),
    )
    assert got == [("", text.UNKNOWN_COVER)] * 2


def test_short_username(spark):
    [(got,)] = values(spark, [("u1",)], "u string", text.short_username(F.col("u")))
    assert got == hashlib.sha1(b"u1").hexdigest()[:8]


def test_durations(spark):
    rows = [("3:50",), ("1:02:03",), ("abc",), ("5",), ("1:2:3:4",), (None,), (" 1 : 05",), ("1:x",)]
    got = values(spark, rows, "s string", time.duration_to_ms(F.col("s")))
    assert [g[0] for g in got] == [230000, 3723000, 0, 0, 0, 0, 65000, 0]
    shown = values(
        spark,
        [(0.0,), (59.9,), (60.0,), (3725.0,), (None,), (float("nan"),)],
        "s double",
        text.fmt_duration(F.col("s")),
    )
    assert [s[0] for s in shown] == ["0:00", "0:59", "1:00", "62:05", "0:00", "0:00"]


def test_iso_to_ms(spark):
    rows = [("2009-05-04T13:06:09",), ("2009-05-04T13:06:09Z",), ("bad",), (None,)]
    got = values(spark, rows, "s string", time.iso_to_ms(F.col("s")))
    assert [g[0] for g in got] == [1241442369000, 1241442369000, None, None]


def test_event_date_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = values(
            spark, [(1706659199999,), (1706659200000,), (-1,)], "t long", time.event_date(F.col("t"))
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [g[0] for g in got] == ["2024-01-30", "2024-01-31", "1969-12-31"]


def test_blend_guard(spark):
    rows = [
        ([1.0, 0.0], [0.0, 1.0]),
        ([1.0], None),
        (None, [2.0]),
        (None, None),
        ([1.0, 2.0], [3.0]),
    ]
    got = values(
        spark,
        rows,
        "a array<float>, b array<float>",
        vector.vec_blend_guard(F.col("a"), F.col("b")),
    )
    assert got[0][0] == pytest.approx([0.7, 0.3])
    assert [g[0] for g in got[1:]] == [[1.0], [2.0], None, [1.0, 2.0]]


def test_vector_arithmetic(spark):
    a, b = F.col("a"), F.col("b")
    [(ip, unit, zero)] = values(
        spark,
        [([3.0, 4.0], [1.0, 2.0], [0.0, 0.0])],
        "a array<float>, b array<float>, z array<float>",
        vector.vec_ip(a, b),
        vector.vec_unit(a),
        vector.vec_unit(F.col("z")),
    )
    assert ip == 11.0 and unit == pytest.approx([0.6, 0.8]) and zero == [0.0, 0.0]


@pytest.mark.parametrize(
    "seconds,total,ended,action",
    [
        (1.99, 100.0, True, None),
        (2.0, 100.0, False, "skip"),
        (49.99, 100.0, False, "skip"),
        (50.0, 100.0, False, "listen"),
        (89.99, 100.0, False, "listen"),
        (90.0, 100.0, False, "complete"),
        (10.0, 0.0, False, "skip"),
        (10.0, 100.0, True, "complete"),
    ],
)
def test_play_class(spark, seconds, total, ended, action):
    got = values(
        spark,
        [(seconds, total, ended)],
        "s double, t double, e boolean",
        scores.play_class(F.col("s"), F.col("t"), F.col("e")),
    )
    assert got == [(action,)]


def test_conform_casts_fills_and_adds(spark):
    df = spark.createDataFrame([("1", "12", "x")], "user_id string, timestamp string, duration string")
    row = conform(df, PLAY_LOG, source="simulation").first()
    assert row.asDict() == {
        "user_id": "1",
        "track_id": None,
        "timestamp": 12,
        "action": None,
        "source": "simulation",
        "duration": None,
        "total_duration": None,
    }
