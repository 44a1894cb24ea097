"""Implicit-feedback training: ratings, id maps, factorisation, factor export."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import date, datetime

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.vector import as_vector
from earshot.operators.catalogue import stamp
from earshot.operators.events import implicit_score, last_days
from earshot.operators.indexing import build_idmap, decode_ids, encode_ids
from earshot.operators.merge import merge_set
from earshot.operators.topk import topk_ip
from earshot.session import cut, ensure_checkpoint_dir

WINDOW_DAYS = 90


@dataclass(frozen=True)
class Params:
    """The training defaults."""

    rank: int = 64
    maxIter: int = 15
    regParam: float = 0.1
    alpha: float = 40.0


@dataclass(frozen=True)
class Factors:
    """Factors by index ``(id, features)``, named as in the trainer's model."""

    userFactors: DataFrame
    itemFactors: DataFrame


@dataclass(frozen=True)
class Trained:
    model: ALSModel | Factors
    users: DataFrame
    items: DataFrame


def training_data(
    lake: DataFrame, as_of: date, days: int = WINDOW_DAYS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(triples, user ids, item ids)`` of the trailing window.

    The lake is read once: events collapse to one rating and count per user and track, and both
    id maps and the triples come from these. Ids are numbered by how many scored events they have.
    """
    scored = implicit_score(last_days(lake, as_of, days))
    rating = F.sum("score").cast("float").alias("rating")
    pairs = scored.groupBy("user_id", "track_id").agg(rating, F.count(F.lit(1)).alias("events"))
    pairs = cut(pairs)
    users, items = build_idmap(pairs, "user_id", "events"), build_idmap(pairs, "track_id", "events")
    triples = encode_ids(
        encode_ids(pairs, users, "user_id", "user_index"), items, "track_id", "item_index"
    )
    return triples.select("user_index", "item_index", "rating"), users, items


def train_als(
    triples: DataFrame, params: Params = Params(), seed: int = 0, blocks: int | None = None
) -> ALSModel | Factors:
    """Non-negative implicit factors; the same seed and data give the same factors.

    Equal up to rounding: sums run in the order in which blocks arrive.

    The trainer's solver gives up, with a factor of zeros, where a system's numbers are so large that
    its steps fall below 1e-7: an item of tens of thousands of listeners is enough. No rated item's or
    user's best factor is zero, so zeros tell of it; then all is trained by `alternate`.

    ``blocks`` sets how many parts users and items are cut into, by default as many as the
    cluster runs tasks at once. The iterations cut their lineage at the shared checkpoint folder.
    """
    blocks = blocks or max(2, triples.sparkSession.sparkContext.defaultParallelism)
    ensure_checkpoint_dir(triples.sparkSession)
    als = ALS(
        **asdict(params),
        implicitPrefs=True,
        nonnegative=True,
        coldStartStrategy="drop",
        userCol="user_index",
        itemCol="item_index",
        ratingCol="rating",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=5,
        seed=seed,
    )
    model = als.fit(triples)
    lost = F.forall("features", lambda x: x == 0)
    if model.itemFactors.filter(lost).isEmpty() and model.userFactors.filter(lost).isEmpty():
        return model
    return alternate(triples, params, seed)


def alternate(triples: DataFrame, params: Params = Params(), seed: int = 0) -> Factors:
    """The trainer's alternation with `half_step`, whose solver is exact at any size of the numbers."""
    from earshot.operators.half_step import half_step  # which takes its parameters from here

    rated = triples.select(
        F.col("user_index").cast("string").alias("user_id"), F.col("item_index").cast("string").alias("id"), "rating"
    )
    rated = cut(rated)
    turned = rated.select(F.col("id").alias("user_id"), F.col("user_id").alias("id"), "rating")
    draw = F.transform(
        F.sequence(F.lit(1), F.lit(params.rank)),
        lambda i: (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 20)) + 1).cast("double"),
    )
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    users = turned.select("id").distinct().withColumn("embedding", draw)
    users = cut(users.withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(square)).cast("array<float>")))
    for _ in range(params.maxIter):
        items = cut(half_step(turned, users, params).toDF("id", "embedding"))
        users = cut(half_step(rated, items, params).toDF("id", "embedding"))
    return Factors(*(t.select(F.col("id").cast("int").alias("id"), F.col("embedding").alias("features")) for t in (users, items)))


def train(
    lake: DataFrame,
    as_of: date,
    params: Params = Params(),
    seed: int = 0,
    days: int = WINDOW_DAYS,
    blocks: int | None = None,
) -> Trained:
    triples, users, items = training_data(lake, as_of, days)
    return Trained(train_als(triples, params, seed, blocks), users, items)


def user_factors(trained: Trained) -> DataFrame:
    factors = trained.model.userFactors.select("id", as_vector(F.col("features")).alias("vector"))
    return decode_ids(factors, trained.users, "id", "user_id").select("user_id", "vector")


def export_item_factors(trained: Trained) -> DataFrame:
    """``(id, embedding)`` of every trained song, read and written by executors only."""
    factors = trained.model.itemFactors.select("id", as_vector(F.col("features")).alias("embedding"))
    return decode_ids(factors.withColumnRenamed("id", "idx"), trained.items, "idx", "id").select(
        "id", "embedding"
    )


def export_user_factors(trained: Trained, users: DataFrame, as_of: datetime) -> DataFrame:
    """The user table with fresh vectors; a user without a profile gets a bare one."""
    factors = user_factors(trained).select(
        F.col("user_id").alias("_id"), F.col("vector").alias("latent_vector")
    )
    fresh = stamp(factors, "last_model_update", as_of)
    return merge_set(users, fresh, "_id", ["latent_vector", "last_model_update"])


def recommend(trained: Trained, users: DataFrame, k: int) -> DataFrame:
    """The ``k`` best songs by the model for each of ``users(user_id)``."""
    asks = user_factors(trained).join(users.select("user_id"), "user_id", "left_semi")
    best = topk_ip(
        asks.select(F.col("user_id").alias("query_id"), "vector"), export_item_factors(trained), k
    )
    return best.withColumnRenamed("query_id", "user_id")
