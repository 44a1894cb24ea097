"""Mix sources to target weights by Poisson replication, in DataFrame operations only.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is the rate
at which its source must be repeated to get its share. The draw inverts the distribution at
a number in (0, 1) taken from an md5 of seed and id, so it is the same on every run and however
the rows are dealt out, and no row needs to know of any other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.session import cut

#: Larger means are drawn as a sum of this many's parts: exp(-mean) stays far from zero.
STEP = 64.0
#: A table of rates up to so many sources is broadcast (each row has a few hundred numbers).
SOURCES = 10_000


def _draw(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_rates(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None
) -> DataFrame:
    """``(source, chars, docs, rate)``: how often to repeat a source's documents on average.

    A document's size is its code points plus one. ``weights`` are shares up to a factor, a
    source that is not in them has none; without them all sources get the same. ``total`` is
    the wanted size, by default that of the input.
    """
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    per = docs.groupBy("source").agg(F.sum(size).alias("chars"), F.count(F.lit(1)).alias("docs"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(share)).otherwise(weight)
    per = cut(per.withColumn("_weight", weight))
    sums = per.agg(F.sum("_weight"), F.sum("chars")).first()
    whole = float(total if total is not None else sums[1] or 0)
    share = F.col("_weight") / float(sums[0] or 1.0)
    return per.select("source", "chars", "docs", (share * whole / F.col("chars")).alias("rate"))


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with every row repeated by its draw, in a shuffled order.

    Adds ``copy`` (from 1) and ``shuffle_key``; input columns of these names give way. Rows that
    repeat an id share a draw. A row without an id is drawn by its text, a null text is empty,
    a null source is a source. An empty table gives an empty one.
    """
    rates = source_rates(docs, weights, total)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    rates = rates.withColumn("_parts", parts).withColumn("_mean", F.col("rate") / F.col("_parts"))
    most = (F.col("_mean") + 12 * F.sqrt("_mean") + 30).cast("int")
    zero = F.exp(-F.col("_mean"))
    begin = F.struct(zero.alias("p"), F.array(zero).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("_mean") / k
        so_far = F.element_at(state["sums"], -1)
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(so_far + p)).alias("sums"))

    # Every value that a draw of 52 bits can reach: the rest is less likely than its last bit.
    sums = F.aggregate(F.sequence(F.lit(1), most), begin, step)["sums"]
    rates = cut(
        rates.select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
            "_parts",
            sums.alias("_sums"),
        )
    )
    if rates.count() <= SOURCES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(
        F.struct("*").alias("_row"),
        key.alias("_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
    ).join(rates, "_source")

    def count(part: Column) -> Column:
        u = _draw(F.lit(seed), F.col("_key"), part.cast("string"))
        return F.size(F.filter("_sums", lambda c: c < u))

    times = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, part: n + count(part)
    )
    copies = rows.withColumn("_n", times).where("_n > 0")
    copies = copies.select("_row", "_key", F.explode(F.sequence(F.lit(1), "_n")).alias("copy"))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "_key", F.col("copy").cast("string")))
    key = F.conv(F.substring(place, 1, 15), 16, 10).cast("long")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.withColumn("shuffle_key", key).repartition(n, "shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key").select(*kept, "copy", "shuffle_key")
