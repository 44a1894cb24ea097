"""Connected components of an edge table, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import cut

MAX_ROUNDS = 60
#: Edges that one task may handle; small tables need few tasks.
TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of ``edges(a, b)``: the smallest id it is connected with.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest
    neighbour that it knows. A busy node is only ever aggregated and joined, never gathered.
    The rounds end when nothing changes, after about the logarithm of the longest path.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u > v").distinct()
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, tasks = mark, -(-mark[0] // TASK)
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = least.select("u", F.col("m").alias("v"))
        now = cut(small.unionByName(hung).coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
