import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earshot.operators import feed, ranking, search, topk
from earshot.operators.indexing import build_idmap, decode_ids, encode_ids


def brute_topk(queries, items, k, hidden=()):
    hidden = set(hidden)
    out = {}
    for q, vec in queries.items():
        scored = [
            (-float(np.dot(np.float32(vec).astype(float), np.float32(v).astype(float))), i)
            for i, v in items.items()
            if (q, i) not in hidden
        ]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def vector_frame(spark, table, key, value):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in table.items()], f"{key} string, {value} array<float>"
    )


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("block,pivots", [(4096, None), (40, 1), (40, 12), (7, 5)])
def test_topk_equals_brute_force(spark, monkeypatch, block, pivots):
    # Few chunks per lane, so that busy balls are dealt to several lanes.
    monkeypatch.setattr(topk, "CHUNKS_PER_LANE", 2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    items = {f"i{n:03d}": centres[n % 6] + rng.normal(size=8) * 0.2 for n in range(250)}
    # A third of all items are copies of one vector: ties rank by id.
    items.update({f"c{n:03d}": centres[0] for n in range(120)})
    queries = {f"q{n}": rng.normal(size=8) for n in range(30)}
    queries["zero"] = np.zeros(8)
    hidden = [("q1", i) for i in list(items)[:200]] + [("q2", "nowhere")]
    hidden += [("q3", i) for i in brute_topk({"q3": queries["q3"]}, items, 30)["q3"]]
    q, i = vector_frame(spark, queries, "query_id", "vector"), vector_frame(spark, items, "id", "embedding")
    ex = spark.createDataFrame(hidden, "query_id string, id string")
    balls = topk.build_balls(i, block, pivots)
    got = topk.topk_ip(q, i, 12, ex, balls, query_block=4)
    assert ranked(got) == brute_topk(queries, items, 12, hidden)


def test_topk_with_fewer_items_than_wanted(spark):
    items = {"a": [1.0], "b": [2.0]}
    q = vector_frame(spark, {"q": [1.0], "n": [-1.0]}, "query_id", "vector")
    got = ranked(topk.topk_ip(q, vector_frame(spark, items, "id", "embedding"), 5))
    assert got == {"q": ["b", "a"], "n": ["a", "b"]}
    none = vector_frame(spark, items, "id", "embedding").limit(0)
    assert topk.topk_ip(q, none, 5).isEmpty()


def test_topk_emits_no_cross_join(spark):
    items = vector_frame(spark, {"a": [1.0], "b": [2.0]}, "id", "embedding")
    q = vector_frame(spark, {"q": [1.0]}, "query_id", "vector")
    for pivots in (1, 2):
        balls = topk.build_balls(items, 1, pivots)
        plan = topk.topk_ip(q, items, 1, None, balls)._jdf.queryExecution().executedPlan()
        assert "Cartesian" not in plan.toString() and "NestedLoop" not in plan.toString()


def test_topk_spreads_over_tasks(spark):
    rng = np.random.default_rng(4)
    items = {f"i{n:04d}": rng.normal(size=8) for n in range(600)}
    queries = {f"q{n:03d}": rng.normal(size=8) for n in range(80)}
    i = vector_frame(spark, items, "id", "embedding")
    q = vector_frame(spark, queries, "query_id", "vector")
    balls = topk.build_balls(i, 50, 1)  # one ball: its blocks alone spread the work
    asks = q.select("query_id", "vector", F.lit(float("-inf")).alias("floor"), F.lit(0).alias("ball"))
    found = topk._scored(asks, balls, 5, None, 16)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_topk_hands_on_the_best_of_many_balls(spark):
    """A query meets the balls of a shelf in one task, which keeps its best of all of them."""
    rng = np.random.default_rng(6)
    i = vector_frame(spark, {f"i{n:04d}": rng.normal(size=8) for n in range(600)}, "id", "embedding")
    q = vector_frame(spark, {f"q{n:03d}": rng.normal(size=8) for n in range(200)}, "query_id", "vector")
    balls = topk.build_balls(i, 25, 60)
    every = F.explode(F.sequence(F.lit(0), F.lit(59))).alias("ball")
    asks = q.select("query_id", "vector", F.lit(float("-inf")).alias("floor"), every)
    assert topk._scored(asks, balls, 5, None, 64).count() < 200 * 60 * 5 / 2


def test_topk_leaves_out_far_blocks_and_low_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 10
    items = {f"i{n:04d}": centres[n % 40] + rng.normal(size=16) * 0.05 for n in range(2000)}
    queries = {f"q{n:02d}": centres[n] for n in range(40)}
    i = vector_frame(spark, items, "id", "embedding")
    q = vector_frame(spark, queries, "query_id", "vector")
    balls = topk.build_balls(i, 25, 200)
    asks = q.select("query_id", "vector", F.lit(5).cast("long").alias("need"), F.lit(float("-inf")).alias("floor"))
    kind = "query_id string, vector array<float>, floor double, ball int"
    first = topk._scored(asks.mapInArrow(topk._visits(balls, False), kind), balls, 5, None, 16)
    floors = topk._floors(first, asks, 5)
    visits = floors.mapInArrow(topk._visits(balls, True), kind)
    assert visits.count() < 40 * 200 / 4
    rows = topk._scored(visits, balls, 5, None, 16)
    low = rows.join(floors, "query_id").filter(F.col("score") < F.col("floor") - 1e-6)
    assert low.isEmpty() and rows.count() < 40 * 5 * 8
    assert ranked(topk.topk_ip(q, i, 5, None, balls)) == brute_topk(queries, items, 5)


def test_minmax(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "q string, s double")
    got = sorted((r["q"], r["scaled"]) for r in ranking.minmax(df, "q", "s").collect())
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 1.0)]


def test_hybrid_rank(spark):
    s = "query_id string, id string, score double"
    als = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("p", "z", 4.0)], s)
    content = spark.createDataFrame([("q", "b", 9.0), ("q", "c", 5.0), ("q", "d", 7.0)], s)
    got = {(r["query_id"], r["id"]): r["score"] for r in ranking.hybrid_rank(als, content).collect()}
    assert got == {
        ("q", "a"): pytest.approx(0.6),
        ("q", "b"): pytest.approx(0.4),
        ("q", "c"): pytest.approx(0.0),
        ("q", "d"): pytest.approx(0.2),
        ("p", "z"): pytest.approx(0.6),
    }


def test_page_and_paginate(spark):
    df = spark.createDataFrame([("q", i) for i in range(7)] + [("p", 0)], "q string, i int")
    got = ranking.page(df, ["q"], [F.asc("i")], 2, 3)
    assert [(r["q"], r["i"], r["has_more"]) for r in got.orderBy("i").collect()] == [
        ("q", 2, True),
        ("q", 3, True),
        ("q", 4, True),
    ]
    assert [r["has_more"] for r in ranking.page(df, ["q"], [F.asc("i")], 4, 3).collect()] == [False] * 3
    assert ranking.page(df, ["q"], [F.asc("i")], 9, 3).isEmpty()
    lists = spark.createDataFrame([("u", f"s{i}", i) for i in range(1, 6)], "user_id string, id string, rank int")
    done = spark.createDataFrame([("u", 5)], "user_id string, n_generated long")
    pages = ranking.paginate(lists, 2, 10, done)
    assert {(r["rank"], r["page"], r["has_more"]) for r in pages.collect()} == {
        (1, 1, True), (2, 1, True), (3, 2, True), (4, 2, True), (5, 3, False),
    }
    assert {r["has_more"] for r in ranking.paginate(lists, 2, 11, done).collect()} == {True}


def test_paginate_keeps_a_row_per_page(spark, monkeypatch):
    """Lists are kept once, packed; before, every row of them was."""
    rows = [(f"u{u}", f"s{i}", i) for u in range(3) for i in range(1, 101)] + [(None, "s1", 1), ("u0", "s1", 100)]
    lists = spark.createDataFrame(rows, "user_id string, id string, rank int")
    songs = spark.createDataFrame([(f"s{i}",) for i in range(1, 81)], "_id string")
    done = spark.createDataFrame([("u1", 400), ("u2", 399)], "user_id string, n_generated long")
    kept, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = ranking.paginate(lists, 20, 500, done, songs).collect()
    assert kept[0].count() == 15
    more = {(r["user_id"], r["page"], r["has_more"]) for r in got if r["id"] != "s1"}
    assert len(got) == 301 and more == {
        (u, p, p < 5 or u == "u0") for u in ("u0", "u1", "u2") for p in range(1, 6)
    }
    assert ("u0", "s1", 100, 5, True) in {tuple(r) for r in got}
    monkeypatch.setattr(ranking, "FEW_SONGS", 5)
    assert sorted(ranking.paginate(lists, 20, 500, done, songs).collect()) == sorted(got)


def test_a_tile_sums_few_scores_again(spark, monkeypatch):
    """A query's floor rises with each block of a tile; before, each block gave its own best."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(2000, 8)).astype(np.float32)
    names = [f"i{n:04d}" for n in range(2000)]
    blocks = pa.table({
        "ball": pa.array([0] * 20, pa.int32()), "ids": [names[n * 100 : n * 100 + 100] for n in range(20)],
        "vecs": pa.array([vecs[n * 100 : n * 100 + 100].ravel() for n in range(20)], pa.list_(pa.float32())),
        "reach": [99.0] * 20,
    })
    asked = pa.table({
        "query_id": ["q0", "q1", "q2"], "vector": pa.array(list(vecs[:3]), pa.list_(pa.float32())),
        "floor": [-np.inf, -np.inf, 0.0], "balls": pa.array([[0]] * 3, pa.list_(pa.int32())),
        "barred": pa.array([None] * 3, pa.list_(pa.string())),
    })
    taken, best = [], topk._best_of_block

    def block(*a):
        out = best(*a)
        taken.append(len(out[0]))
        return out

    monkeypatch.setattr(topk, "_best_of_block", block)
    got = topk._score_tile(np.zeros((1, 8)), 30, 512)(asked, blocks).to_pylist()
    assert sum(taken) < 0.5 * 20 * 30 * 3
    scores = vecs[:3].astype(float) @ vecs.T.astype(float)
    for q in range(3):
        mine = sorted((-r["score"], r["id"]) for r in got if r["query_id"] == f"q{q}")[:30]
        assert [i for _, i in mine] == [names[n] for n in np.argsort(-scores[q])[:30]]


def test_seeded_sample_is_repeatable_and_follows_the_seed(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id"))
    one, two = (sorted(ranking.seeded_sample(df.repartition(n), "g", 10, 1).collect()) for n in (1, 5))
    other = sorted(ranking.seeded_sample(df, "g", 10, 2).collect())
    assert one == two != other and len(one) == 10


def brute_fallback(wanted, songs, seen, seed):
    out = {}
    for user, n in wanted.items():
        pool = [s for s in sorted(songs, key=lambda s: (-(songs[s] or 0), s)) if (user, s) not in seen]
        pool = pool[: max(n + 40, math.floor(n * 1.5))]

        def key(s):
            h = int(hashlib.md5(f"{seed}|{user}|{s}".encode()).hexdigest()[:8], 16)
            return (-math.log((h + 1) / (2**32 + 1)) / math.log((songs[s] or 0) + 2.0), s)

        if n > 0:
            out[user] = sorted(pool, key=key)[:n]
    return {u: l for u, l in out.items() if l}


def test_fallback_equals_definition(spark):
    rng = random.Random(4)
    songs = {f"s{i:03d}": rng.choice([None, 0, 1, 5, 50]) for i in range(150)}
    wanted = {"new": 10, "busy": 20, "all": 5, "none": 0, "big": 300}
    seen = {("busy", s) for s in rng.sample(sorted(songs), 90)} | {("all", s) for s in songs}
    seen.add(("busy", "not a song"))
    w = spark.createDataFrame(list(wanted.items()), "user_id string, n int")
    table = spark.createDataFrame(list(songs.items()), "_id string, plays_7d int")
    past = spark.createDataFrame(sorted(seen), "user_id string, id string")
    got = {}
    for r in sorted(ranking.fallback_songs(w, table, past, 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["user_id"], []).append(r["id"])
    assert got == brute_fallback(wanted, songs, seen, 3)


def world(spark, n_items=80):
    rng = np.random.default_rng(0)
    items = {f"s{i:02d}": rng.normal(size=4) for i in range(n_items)}
    songs = spark.createDataFrame([(i, int(rng.integers(0, 9))) for i in items], "_id string, plays_7d int")
    return items, vector_frame(spark, items, "id", "embedding"), songs


def test_home_feed_rules(spark):
    items, table, songs = world(spark)
    vectors = spark.createDataFrame(
        [("long", True, [1.0, 0.0, 0.0, 0.0]), ("short", False, [0.0, 1.0, 0.0, 0.0])],
        "user_id string, has_long boolean, vector array<double>",
    )
    wanted = spark.createDataFrame([("long", 10), ("short", 10), ("cold", 10)], "user_id string, n long")
    served = spark.createDataFrame([("long", "s05"), ("cold", "s07")], "user_id string, id string")
    got = feed.home_feed(wanted, vectors, table, songs, served, 1).collect()
    by_user = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_user.setdefault(r["user_id"], []).append((r["id"], r["source"]))
    assert {u: [s for _, s in l] for u, l in by_user.items()} == {
        "long": [1] * 10,
        "short": [1] * 5 + [2] * 5,
        "cold": [2] * 10,
    }
    for user, entries in by_user.items():
        ids = [i for i, _ in entries]
        assert len(set(ids)) == 10
        assert not {("long", "s05"), ("cold", "s07")} & {(user, i) for i in ids}
    best = brute_topk({"long": [1.0, 0, 0, 0]}, items, 30, [("long", "s05")])["long"]
    assert {i for i, _ in by_user["long"]} <= set(best)


def test_feed_is_as_long_as_the_catalogue_allows(spark):
    _, table, songs = world(spark, 8)
    vectors = spark.createDataFrame([("u", True, [1.0, 0.0, 0.0, 0.0])], "user_id string, has_long boolean, vector array<double>")
    wanted = spark.createDataFrame([("u", 100)], "user_id string, n long")
    served = spark.createDataFrame([("u", "s01")], "user_id string, id string")
    got = feed.home_feed(wanted, vectors, table, songs, served, 1)
    assert sorted(r["id"] for r in got.collect()) == [f"s{i:02d}" for i in range(8) if i != 1]


def test_feeds_and_lists_may_be_longer_than_a_batch(spark):
    items, table, songs = world(spark, 200)
    vectors = spark.createDataFrame(
        [("u", True, [1.0, 0.0, 0.0, 0.0])], "user_id string, has_long boolean, vector array<double>"
    )
    none = spark.createDataFrame([], "user_id string, id string")
    wanted = spark.createDataFrame([("u", 120)], "user_id string, n int")
    got = feed.home_feed(wanted, vectors, table, songs, none, 1).collect()
    assert len({r["id"] for r in got}) == 120 and {r["source"] for r in got} == {1}
    ask = spark.createDataFrame([("q", "u", "s05", 80)], "query_id string, user_id string, current_song_id string, n int")
    assert feed.next_songs(ask, vectors, table, table, songs, none, 1).count() == 80


def test_next_songs_rules(spark):
    items, table, songs = world(spark)
    content = {k: v for k, v in items.items() if k != "s03"}
    content_table = vector_frame(spark, content, "id", "embedding")
    vectors = spark.createDataFrame([("u", [1.0, 0.0, 0.0, 0.0])], "user_id string, vector array<double>")
    requests = spark.createDataFrame(
        [
            ("both", "u", "s01", 5),
            ("content only", "cold", "s02", 5),
            ("taste only", "u", "s03", 5),
            ("neither", "cold", "s03", 5),
        ],
        "query_id string, user_id string, current_song_id string, n int",
    )
    served = spark.createDataFrame([("u", "s04"), ("cold", "s05")], "user_id string, id string")
    got = feed.next_songs(requests, vectors, table, content_table, songs, served, 1).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r["query_id"], []).append(r["id"])
    assert {q: len(l) for q, l in lists.items()} == dict.fromkeys(lists, 5) and len(lists) == 4
    hidden = {"both": {"s01", "s04"}, "content only": {"s02", "s05"}, "taste only": {"s03", "s04"}}
    for q, ids in hidden.items():
        assert not ids & set(lists[q])
    assert "s05" not in lists["neither"]
    assert all(r["score"] is None for r in got if r["query_id"] == "neither")
    taste = brute_topk({"q": [1.0, 0, 0, 0]}, items, 5, [("q", "s03"), ("q", "s04")])["q"]
    assert lists["taste only"] == taste
    near = brute_topk({"q": items["s02"]}, content, 5, [("q", "s02"), ("q", "s05")])["q"]
    assert lists["content only"] == near


def test_refills_and_session_state(spark):
    served = spark.createDataFrame(
        [("u", f"s{i}", i, i < 5, i) for i in range(450)]
        + [("full", f"s{i}", 1, False, i) for i in range(500)]
        + [("queue", f"s{i}", 1, True, i) for i in range(20)],
        "user_id string, id string, served_at long, queued boolean, position long",
    )
    users = spark.createDataFrame([("u",), ("full",), ("queue",), ("new",)], "user_id string")
    got = feed.refills(users, feed.feed_state(served), feed.FEED)
    assert {tuple(r) for r in got.collect()} == {("u", 50), ("new", 100)}
    alive = feed.active_served(served, 449 + 10, 10)
    assert alive.isEmpty()
    assert feed.active_served(served, 449 + 9, 10).select("user_id").distinct().count() == 1
    fresh = spark.createDataFrame([("u", "s0", 1), ("new", "x", 1)], "user_id string, id string, rank int")
    marked = feed.mark_served(served, fresh, 9_999)
    ends = {(r["user_id"], r["position"], r["queued"]) for r in marked.filter("served_at = 9999").collect()}
    assert ends == {("u", 450, True), ("new", 1, True)}
    state = {r["user_id"]: r["n_generated"] for r in feed.feed_state(marked).collect()}
    assert state == {"u": 450, "full": 500, "queue": 20, "new": 1}
    assert marked.filter("served_at = 9999").count() == 2 and marked.count() == 971
    assert feed.reset_served(served, users.filter("user_id = 'full'")).count() == 470


def brute_search(songs, text, limit, skip):
    def split(s):
        return [w for w in "".join(c.lower() if c.isalnum() else " " for c in s or "").split()]

    tokens = set(split(text))
    scored = []
    for i, (track, artist) in songs.items():
        score = sum(10 * split(track).count(t) + 5 * split(artist).count(t) for t in tokens)
        if score:
            scored.append((-score, i))
    scored.sort()
    return [(i, -s) for s, i in scored[skip : skip + limit]], len(scored) > skip + limit


@pytest.mark.parametrize("head, block", [(200, 256), (6, 3), (1, 4)])
@pytest.mark.parametrize("skip", [0, 4])
def test_search_equals_brute_force(spark, tmp_path, head, block, skip):
    rng = random.Random(9)
    words = ["the", "the", "the", "red", "blue", "Love", "night", "rain", "zebra"]
    songs = {
        f"s{i:02d}": (" ".join(rng.choices(words, k=rng.randrange(1, 5))), rng.choice(["The Who", "Red", None]))
        for i in range(90)
    }
    texts = ["the", "THE love", "zebra night", "love-rain blue", "", "nothing", "red the who zebra", "?!"]
    queries = {f"q{n}": t for n, t in enumerate(texts)}
    queries["again"] = "the"
    table = spark.createDataFrame([(i, t, a) for i, (t, a) in songs.items()], "_id string, track_name string, artist_name string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    got = {}
    root = str(tmp_path / "postings")
    search.publish_postings(table, root, 4, head, block)
    found = search.search_songs(search.read_postings(spark, root), asked, 5, skip)
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], ([], r["has_more"]))[0].append((r["id"], r["score"]))
    for q, text in queries.items():
        page, more = brute_search(songs, text, 5, skip)
        assert got.get(q, ([], False)) == (page, more if page else False), (q, text)


def test_search_lists_few_songs_of_a_large_vocabulary(spark, tmp_path, monkeypatch):
    """Every text has a word that half of all songs share; few of these are ever listed."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    songs = {
        f"s{i:05d}": (" ".join(["the"] * (i % 2) + rng.choices(vocabulary, k=4)), "x") for i in range(3000)
    }
    queries = {f"q{i}": f"the w{i} w{i + 1}" for i in range(150)}
    table = spark.createDataFrame([(i, *v) for i, v in songs.items()], "_id string, track_name string, artist_name string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    root = str(tmp_path / "postings")
    search.publish_postings(table, root)
    index = search.read_postings(spark, root)
    listed = []
    keep = search.cut
    monkeypatch.setattr(search, "cut", lambda df: listed.append(keep(df)) or listed[-1])
    got = {}
    for r in search.search_songs(index, asked, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in ("q0", "q77", "q149"):
        best, _ = brute_search(songs, queries[q], 3, 0)
        assert [(i, s) for _, i, s in sorted(got[q])] == best
    near = next(df for df in listed[::-1] if df.columns == ["_text", "id"])
    assert near.count() < 150 * 3000 / 20  # songs scored in full


def test_search_opens_only_the_folders_of_its_words(spark, tmp_path):
    songs = spark.createDataFrame([(f"s{i}", f"w{i} the", None) for i in range(500)], "_id string, track_name string, artist_name string")
    root = str(tmp_path / "postings")
    search.publish_postings(songs, root, buckets=32)
    index = search.read_postings(spark, root)
    pairs = spark.createDataFrame([("t", "w7")], "_text string, token string").withColumn("bucket", search._word_bucket(32))
    for tier in (0, 1):
        files = {f.split("/tier=")[1].rsplit("/", 1)[0] for f in index.opened(tier, pairs).inputFiles()}
        everything = {f.split("/tier=")[1].rsplit("/", 1)[0] for f in index.rows.inputFiles()}
        assert len(files) <= len(everything) and len(everything) > 40
        scan = index.opened(tier, pairs)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in scan and f"tier#" in scan
        parts = {(r[0], r[1]) for r in index.opened(tier, pairs).select("tier", "bucket").distinct().collect()}
        assert parts == {(tier, pairs.first()["bucket"])}
    nothing = spark.createDataFrame([], "query_id string, text string")
    assert search.search_songs(index, nothing, 3).count() == 0


def test_search_regex(spark):
    table = spark.createDataFrame(
        [("1", "Abc", "x"), ("2", "b.c", "y"), ("3", None, "ABC"), ("4", "zzz", None)],
        "_id string, track_name string, artist_name string",
    )
    asked = {"a": "^abc", "dot": r"b\.c", "all": "", "no": "q", "none": None}
    patterns = spark.createDataFrame(list(asked.items()), "query_id string, pattern string")
    got = search.search_regex(table, patterns, 2)
    pages = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        pages.setdefault(r["query_id"], []).append((r["id"], r["has_more"]))
    assert pages == {"a": [("1", False), ("3", False)], "dot": [("2", False)], "all": [("1", True), ("2", True)]}


def test_idmap_is_dense_and_ordered(spark):
    rows = [(f"k{i % 40:02d}",) for i in range(100)] + [("hot",)] * 200
    idmap = build_idmap(spark.createDataFrame(rows, "k string").repartition(7), "k")
    got = [r["id"] for r in idmap.orderBy("idx").collect()]
    counts = {}
    for (k,) in rows:
        counts[k] = counts.get(k, 0) + 1
    assert got == sorted(counts, key=lambda k: (-counts[k], k))
    assert [r["idx"] for r in idmap.orderBy("idx").collect()] == list(range(41))
    df = spark.createDataFrame([("hot",), ("unknown",)], "k string")
    there = encode_ids(df, idmap, "k", "i")
    assert [r["k"] for r in decode_ids(there, idmap, "i", "k").collect()] == ["hot"]


def test_topk_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("id"))
    for cut in (
        ranking.topk_per(df, ["g"], [F.desc("id")], 5),
        ranking.seeded_sample(df, "g", 5, 1, F.col("g")),
        ranking.page(df, ["g"], [F.asc("id")], 0, 5),
    ):
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "row_number(), " in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_pools_are_joined_without_nested_loops(spark):
    wanted = spark.createDataFrame([("u", 5)], "user_id string, n int")
    songs = spark.createDataFrame([(f"s{i}", i) for i in range(30)], "_id string, plays_7d int")
    seen = spark.createDataFrame([("u", "s29")], "user_id string, id string")
    df = ranking.fallback_songs(wanted, songs, seen, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert df.count() == 5


def test_search_lists_classes_of_equal_names_once(spark, tmp_path):
    """Copies of a name are one entry of the index; pages of any depth hold them by id, behind better names."""
    names = [(a, b) for a in ("red", "blue", "old") for b in ("ring", "bolt")]
    songs = {f"s{i:04d}": (" ".join(names[i % 6]), f"B {i % 5}") for i in range(3000)}
    table = spark.createDataFrame([(i, *v) for i, v in songs.items()], "_id string, track_name string, artist_name string")
    asked = spark.createDataFrame([("q", "red bolt b 3"), ("r", "b")], "query_id string, text string")
    root = str(tmp_path / "postings")
    search.publish_postings(table, root, head=8)
    index = search.read_postings(spark, root)
    listed = index.rows.filter("tier = 1").selectExpr("sum(size(ids)) AS n").first()["n"]
    assert listed == 30 * 4  # before: one of each song and word
    for skip, limit in ((0, 5), (97, 20)):
        got = search.search_songs(index, asked, limit, skip).collect()
        for q, text in (("q", "red bolt b 3"), ("r", "b")):
            page, more = brute_search(songs, text, limit, skip)
            rows = sorted((r["rank"], r["id"], r["score"], r["has_more"]) for r in got if r["query_id"] == q)
            assert rows == [(skip + 1 + n, i, s, more) for n, (i, s) in enumerate(page)]


def test_tasks_grow_in_number_with_the_rows_that_a_step_makes(spark):
    from earshot.session import TASK_ROWS, spread

    users = spark.range(100).selectExpr("cast(id AS string) AS user_id")
    assert spread(users, "user_id").rdd.getNumPartitions() == 4
    assert spread(users, "user_id", rows=9 * TASK_ROWS + 1).rdd.getNumPartitions() == 10


def test_fallback_meets_only_songs_within_reach(spark, monkeypatch):
    """Pools lie in the first positions; the other ranked songs are not kept or joined."""
    songs = spark.range(5000).selectExpr("cast(id AS string) AS _id", "id AS plays_7d")
    wanted = spark.createDataFrame([("u", 5), ("v", 10)], "user_id string, n int")
    seen = spark.createDataFrame([("u", str(4999 - i)) for i in range(20)], "user_id string, id string")
    kept, keep = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: kept.append(keep(df)) or kept[-1])
    got = ranking.fallback_songs(wanted, songs, seen, 1).collect()
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 6), *range(1, 11)])
    assert all(int(r["id"]) in range(4935, 4980) for r in got if r["user_id"] == "u")
    ranked = next(df for df in kept if "position" in df.columns)
    assert ranked.count() == 65


def test_wide_rows_come_in_small_arrow_batches(spark):
    from earshot.session import BATCH_BYTES, small_batches

    small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    wide = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) AS t")
    most = max(r["n"] for r in wide.mapInArrow(sizes, "n long").collect())
    assert most < 2 * BATCH_BYTES  # before: 60 MB
