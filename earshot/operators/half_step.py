"""Factors between trainings: one implicit half step of new or changed users against stored items.

With the items fixed, a user's best factor ``x`` solves a small system of its own: of all items'
products (the Gram matrix), of the items that the user has heard, and of the penalty. The Gram
matrix is summed in the tasks; users are solved in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.training import Params

#: Rated items of one user that a task holds at once.
CHUNK = 4096
_PART = "user_id string, terms array<double>"
_OUT = "user_id string, vector array<float>"


def _product_sums(rank: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            if batch.num_rows:
                vecs = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                total += vecs.T @ vecs
        cells = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["at", "cell"])

    return sums


def gram(items: DataFrame, rank: int) -> np.ndarray:
    """Sum of the outer products of ``items(id, embedding)``; the driver sees rank x rank numbers.

    A vector that is not ``rank`` long fails the job.
    """
    size = F.size("embedding")
    wrong = F.raise_error(F.lit(f"item factor not of length {rank}")).cast("array<float>")
    vecs = items.select(F.when(size == rank, F.col("embedding").cast("array<float>")).otherwise(wrong).alias("v"))
    cells = vecs.mapInArrow(_product_sums(rank), "at long, cell double").groupBy("at").agg(F.sum("cell").alias("cell"))
    out = np.zeros(rank * rank)
    for row in cells.collect():
        out[row["at"]] = row["cell"]
    return out.reshape(rank, rank)


def solve_nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ``x >= 0`` with the least ``x'ax/2 - b'x``, for a positive definite ``a``.

    Block principal pivoting (Kim and Park, 2011): all indices on the wrong side of zero change
    sides at once; if that stops helping, only the last one does, which is sure to end.
    """
    n = len(b)
    free, x, slope = np.zeros(n, dtype=bool), np.zeros(n), -b
    tries, least = 3, n + 1
    margin = 1e-12 * max(1.0, np.abs(b).max(initial=0.0))
    while True:
        wrong = np.where(free, x < 0, slope < -margin)
        count = int(wrong.sum())
        if not count:
            return x
        if count < least:
            least, tries = count, 3
        elif tries:
            tries -= 1
        else:
            wrong[: np.flatnonzero(wrong)[-1]] = False
        free ^= wrong
        x = np.zeros(n)
        x[free] = np.linalg.solve(a[np.ix_(free, free)], b[free])
        slope = a @ x - b
        slope[free] = 0.0


def _normal_terms(rank: int, alpha: float):
    """Of each chunk the sums that the user's system needs: matrix, right side, number of items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                rating = rows.field("rating").to_numpy(zero_copy_only=False).astype(np.float64)
                vecs = np.stack(rows.field("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                weight, liked = alpha * np.abs(rating), rating > 0
                own = np.concatenate([
                    ((vecs * weight[:, None]).T @ vecs).ravel(), (1.0 + weight[liked]) @ vecs[liked], [liked.sum()]
                ])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("user_id").slice(i, 1), pa.array([own], pa.list_(pa.float64()))],
                    names=["user_id", "terms"],
                )

    return terms


def _solutions(products: np.ndarray, reg: float, nonnegative: bool):
    rank = len(products)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("terms").to_numpy(zero_copy_only=False):
                a = products + own[: rank * rank].reshape(rank, rank) + reg * own[-1] * np.eye(rank)
                b = own[rank * rank : -1]
                if not b.any():
                    out.append(np.zeros(rank, dtype=np.float32))
                elif nonnegative:
                    out.append(solve_nonnegative(a, b).astype(np.float32))
                else:
                    out.append(np.linalg.solve(a, b).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id"), pa.array(out, pa.list_(pa.float32()))], names=["user_id", "vector"]
            )

    return solve


def half_step(
    ratings: DataFrame,
    items: DataFrame,
    params: Params = Params(),
    nonnegative: bool = True,
    chunk: int = CHUNK,
    products: np.ndarray | None = None,
) -> DataFrame:
    """``(user_id, vector)``: each user's best factor for the items as they are.

    ``ratings(user_id, id, rating)`` holds all of a user's ratings; a pair that comes repeatedly
    counts as its sum. Null ratings and ids without a factor take no part, nor does a user left
    without any. Only the users asked about are read; ``products`` may be a stored `gram`. The
    ratings of a busy user are summed in chunks of about ``chunk`` items, so no task holds more.
    """
    products = gram(items, params.rank) if products is None else products
    pairs = ratings.filter("user_id IS NOT NULL AND rating IS NOT NULL")
    pairs = pairs.groupBy("user_id", "id").agg(F.sum("rating").cast("float").alias("rating"))
    parts = pairs.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_parts"))
    vectors = items.select("id", F.col("embedding").cast("array<float>").alias("v"))
    dealt = pairs.join(parts, "user_id").join(vectors, "id")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    packed = dealt.groupBy("user_id", "_part", "_parts").agg(
        F.sort_array(F.collect_list(F.struct("id", "rating", "v"))).alias("rows")
    )
    kept = packed.select("user_id", "_parts", "rows")
    terms = _normal_terms(params.rank, params.alpha)
    whole = kept.filter("_parts = 1").drop("_parts").mapInArrow(terms, _PART)
    pieces = kept.filter("_parts > 1").drop("_parts").mapInArrow(terms, _PART)
    cells = pieces.select("user_id", F.posexplode("terms").alias("at", "cell"))
    cells = cells.groupBy("user_id", "at").agg(F.sum("cell").alias("cell"))
    # rank * (rank + 1) + 1 cells a user.
    summed = cells.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "cell"))), lambda c: c["cell"]).alias("terms")
    )
    return whole.unionByName(summed).mapInArrow(
        _solutions(products, params.regParam, nonnegative), _OUT
    )
