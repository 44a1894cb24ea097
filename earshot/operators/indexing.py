"""Dense integer positions for a whole table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.session import cut

MAX_INT = 2**31 - 1


def dense_rank_by(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Number the rows 0, 1, 2, … in ``order``, which must tell all rows apart.

    Rows are range-partitioned and sorted, so each partition holds one stretch of the
    order. A row's number is its place in the partition plus the sizes of the partitions
    before it; those sizes are one row per partition, the only thing that is windowed as
    a whole. The sorted stretches are checkpointed: both uses must see the same cut, also
    after an executor is lost.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the place in its lower 33.
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: broadcasting it is bounded by the partition count.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + place)
        .drop("_at", "_part", "_offset")
    )


def build_idmap(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """``(id, n, idx)``: ids numbered from 0, most frequent first, ties by id.

    ``weight`` names a column of counts if rows stand for several events. The trainer takes
    32-bit ids, so a larger number fails the job instead of wrapping.
    """
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(F.col(col).alias("id")).agg(number.alias("n"))
    ranked = dense_rank_by(counts, [F.desc("n"), F.asc("id")], "idx")
    fits = F.when(F.col("idx") <= MAX_INT, F.col("idx").cast("int")).otherwise(
        F.raise_error(F.lit("more ids than a 32-bit index can hold")).cast("int")
    )
    return ranked.select("id", "n", fits.alias("idx"))


def encode_ids(df: DataFrame, idmap: DataFrame, col: str, out: str) -> DataFrame:
    """Replace ``col`` by its index; ids not in the map drop."""
    known = idmap.select(F.col("id").alias(col), F.col("idx").alias(out))
    return df.join(known, col).drop(col)


def decode_ids(df: DataFrame, idmap: DataFrame, col: str, out: str) -> DataFrame:
    known = idmap.select(F.col("idx").alias(col), F.col("id").alias(out))
    return df.join(known, col).drop(col)
