"""Ranking within a query: top-k, paging, score scaling, blending, repeatable sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.scores import popularity_weight, sample_hash, sample_key, unit_scale
from earshot.operators.catalogue import song_summary
from earshot.operators.indexing import dense_rank_by
from earshot.session import cut, spread

WEIGHT_ALS = 0.6
#: Ranked songs that go to all tasks.
FEW_SONGS = 100_000


def topk_per(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Every task keeps only ``k`` rows of a group before the shuffle, so a group that
    holds most of the rows still arrives small.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], skip: int, limit: int
) -> DataFrame:
    """Rows ``skip+1 .. skip+limit`` of each group, and whether more follow.

    One row beyond the page is ranked to know that, then dropped.
    """
    probe = skip + limit + 1
    ranked = topk_per(df, by, order, probe)
    more = F.max("rank").over(Window.partitionBy(*by)) >= probe
    return ranked.withColumn("has_more", more).filter(F.col("rank").between(skip + 1, skip + limit))


def paginate(
    ranked: DataFrame,
    page_size: int,
    cap: int,
    already: DataFrame | None = None,
    songs: DataFrame | None = None,
) -> DataFrame:
    """Page numbers for ranked lists, and whether more can follow each page.

    More follows while the list goes on, or while the ids generated so far (this list
    and ``already(user_id, n_generated)``) stay under the cap. With ``songs(_id)`` nothing
    follows a page none of whose ids has a song.
    """
    number = F.ceil(F.col("rank") / F.lit(page_size)).cast("int").alias("page")
    entry = F.struct(*(c for c in ranked.columns if c != "user_id"))
    # Lists travel and are kept as one row per page, put together in the tasks that made them.
    packed = ranked.filter("user_id IS NOT NULL").groupBy("user_id", number)
    packed = cut(packed.agg(F.collect_list(entry).alias("_rows"), F.max("rank").alias("_last")))
    lists = packed.groupBy("user_id").agg(F.max("_last").alias("_size"))
    before = F.lit(0)
    if already is not None:
        lists = lists.join(already.select("user_id", "n_generated"), "user_id", "left")
        before = F.coalesce(F.col("n_generated"), F.lit(0))
    lists = lists.select("user_id", "_size", (before + F.col("_size")).alias("_generated"))
    more = (F.col("_size") > F.col("page") * page_size) | (F.col("_generated") < cap)
    pages = packed.join(lists, "user_id")
    if songs is not None:
        filled = _with_songs(packed, songs).withColumn("_filled", F.lit(True))
        pages = pages.join(filled, ["user_id", "page"], "left")
        more = more & F.col("_filled").isNotNull()
    rows = pages.select("user_id", "page", more.alias("has_more"), F.explode("_rows").alias("_row"))
    columns = [F.col(c if c == "user_id" else f"_row.{c}") for c in ranked.columns]
    return rows.select(*columns, "page", "has_more")


def _with_songs(packed: DataFrame, songs: DataFrame) -> DataFrame:
    """``(user_id, page)`` of the pages that show an id with a song."""
    shown = packed.select("user_id", "page", F.explode(F.array_distinct("_rows.id")).alias("id"))
    found = cut(shown.select("id").distinct().join(songs.select(F.col("_id").alias("id")), "id", "left_semi"))
    if found.count() <= FEW_SONGS:
        found = F.broadcast(found)  # at most FEW_SONGS rows
    return shown.join(found, "id", "left_semi").select("user_id", "page").distinct()


def minmax(df: DataFrame, by: str, col: str, out: str = "scaled") -> DataFrame:
    """Scale ``col`` to [0, 1] within each group.

    The bounds are an aggregate joined back, so a hot group is never gathered; adaptive
    execution splits it in the join.
    """
    bounds = df.groupBy(by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return (
        df.join(bounds, by)
        .withColumn(out, unit_scale(F.col(col), F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


def hybrid_rank(
    als: DataFrame, content: DataFrame, weight_als: float = WEIGHT_ALS, by: str = "query_id"
) -> DataFrame:
    """Blend two top-k lists per query: each scaled to [0, 1], a missing id counting 0.

    The lists hold at most the candidate pool of a query, so windows over them are small.
    """
    whole = Window.partitionBy(by)

    def scaled(scores: DataFrame, out: str) -> DataFrame:
        low, high = F.min("score").over(whole), F.max("score").over(whole)
        return scores.select(by, "id", unit_scale(F.col("score"), low, high).alias(out))

    a, c = F.coalesce(F.col("_a"), F.lit(0.0)), F.coalesce(F.col("_c"), F.lit(0.0))
    merged = a * weight_als + c * (1.0 - weight_als)
    both = scaled(als, "_a").join(scaled(content, "_c"), [by, "id"], "full_outer")
    return both.select(by, "id", merged.alias("score"))


def exclude_seen(cands: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cands.join(seen.select(*keys), list(keys), "left_anti")


def seeded_sample(
    df: DataFrame,
    by: str,
    most: int,
    seed: int,
    quota: Column | None = None,
    id_col: str = "id",
    rank: str = "rank",
) -> DataFrame:
    """A repeatable random subset of ``most`` rows per group, in random order.

    ``quota`` lowers the number per group. The constant ``most`` lets every task drop all
    but its smallest keys before the shuffle.
    """
    window = Window.partitionBy(by).orderBy("_h", id_col)
    kept = F.col(rank) <= most
    if quota is not None:
        kept = kept & (F.col(rank) <= quota)
    return (
        df.withColumn("_h", sample_hash(seed, F.col(by), F.col(id_col)))
        .withColumn(rank, F.row_number().over(window))
        .filter(kept)
        .drop("_h")
    )


def hydrate(ranked: DataFrame, songs: DataFrame) -> DataFrame:
    """Add the song summary to ranked ids; ids without a song drop, ranks stay."""
    shown = song_summary(songs).withColumnRenamed("_id", "id")
    return ranked.join(shown, "id")


def _by_plays(songs: DataFrame) -> tuple[DataFrame, list[Column]]:
    table = songs.select(
        F.col("_id").alias("id"),
        F.coalesce(F.col("plays_7d"), F.lit(0)).cast("bigint").alias("plays"),
    )
    return table, [F.desc("plays"), F.asc("id")]


def _pools(asks: DataFrame, songs: DataFrame, seen: DataFrame) -> DataFrame:
    """Every user's pool of trending songs: the first positions that hold none they have seen.

    Seen songs push a pool at most as many places down, so a user looks at the first
    ``pool + seen`` positions, and no song beyond the furthest of these is looked at. Requests are
    partitioned by user before they expand, by the number of rows that they expand to; a pool
    then meets the ranked songs in an equi-join, and stays where it is if these are few.
    """
    table, order = _by_plays(songs)
    most, rows = asks.agg(F.max("_reach"), F.sum("_pool").cast("long")).first()
    ranked = dense_rank_by(table, order, "_place").withColumn("position", F.col("_place") + 1)
    ranked = cut(ranked.filter(F.col("position") <= int(most or 0)))
    if (most or 0) <= FEW_SONGS:
        ranked = F.broadcast(ranked)  # at most FEW_SONGS rows
    skips = (
        seen.select("user_id", "id")
        .join(ranked.select("id", "position"), "id")
        .join(asks.select("user_id", "_reach"), "user_id")
        .filter(F.col("position") <= F.col("_reach"))
        .groupBy("user_id")
        .agg(F.collect_set("position").alias("_skip"))
    )
    skip = F.coalesce(F.col("_skip"), F.array().cast("array<bigint>"))
    free = F.array_except(F.sequence(F.lit(1), F.col("_pool") + F.size(skip)), skip)
    pool = F.slice(free, F.lit(1), F.col("_pool").cast("int"))
    return (
        spread(asks, "user_id", rows=rows or 0)
        .join(skips, "user_id", "left")
        .select("user_id", "n", "offset", F.explode(pool).alias("position"))
        .join(ranked, "position")
        .select("user_id", "n", "offset", "id", "plays")
    )


def fallback_songs(
    wanted: DataFrame,
    songs: DataFrame,
    seen: DataFrame,
    seed: int,
) -> DataFrame:
    """Popular songs for ``wanted(user_id, n)``: a weighted draw from the trending pool.

    An optional column ``offset`` of ``wanted`` is added to the ranks.

    A user's pool is the ``max(n + 40, 1.5 n)`` most played songs they have not seen; if
    it holds more than ``n``, ``n`` are drawn without replacement with weight
    ``ln(plays + 2)``.
    """
    pool = F.greatest(F.col("n") + 40, F.floor(F.col("n") * 1.5))
    offset = F.col("offset") if "offset" in wanted.columns else F.lit(0)
    n_seen = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("_s"))
    asks = cut(
        wanted.filter(F.col("n") > 0)
        .select("user_id", F.col("n").cast("bigint").alias("n"), offset.cast("int").alias("offset"))
        .join(n_seen, "user_id", "left")
        .withColumn("_pool", pool)
        .withColumn("_reach", F.col("_pool") + F.coalesce(F.col("_s"), F.lit(0)))
        .drop("_s")
    )
    cands = _pools(asks, songs, seen)
    hashed = sample_hash(seed, F.col("user_id"), F.col("id"))
    draw = Window.partitionBy("user_id").orderBy("_key", "id")
    return (
        cands.withColumn("_key", sample_key(hashed, popularity_weight(F.col("plays"))))
        .withColumn("rank", F.row_number().over(draw))
        .filter(F.col("rank") <= F.col("n"))
        .select("user_id", "id", (F.col("rank") + F.col("offset")).alias("rank"))
    )
