"""Exact top-k search by inner product with M-trees.

Vectors of equal dimension are dealt to shards of bounded size by a hash of the id, so that equal
vectors spread too. Each shard is bulk-loaded into an M-tree: pages hold a routing object with its
covering radius and its distance to the parent's routing object, leaf pages hold vectors with
their distance to the page's routing object. Inner product becomes a metric by one more component
that gives all vectors of a shard the same norm; a query has 0 there.

Queries meet a tree in blocks. Pages are taken best first; what stored distances and radii rule out
by the triangle inequality is never computed. A query first searches one shard; the k-th score
found there is the floor with which it enters the others, and nothing below it is returned.
"""

from __future__ import annotations

import heapq
import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.session import cut

#: Vectors per tree, entries per page, queries per block.
SHARD, PAGE, BLOCK = 4_096, 64, 512
#: Sums below this are exact in doubles.
EXACT = float(1 << 52)
_FOUND = "query_id bigint, vec_id bigint, score bigint"


class MTree:
    """Pages of one shard. Page i's entries are children pages, or rows if it is a leaf."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.norm2 = float(squares.max(initial=0))
        self.extra = np.sqrt(np.maximum(self.norm2 - squares, 0))
        self.pages: list[dict] = []
        self.root = self._load(np.arange(len(vectors)), 0)

    def __getstate__(self) -> dict:
        small = np.abs(self.vectors).max(initial=0) < 1 << 15
        return self.__dict__ | {"vectors": self.vectors.astype(np.int16 if small else np.int64)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"vectors": state["vectors"].astype(np.float64)}

    def distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        gap = self.vectors[rows] - self.vectors[to]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.extra[rows] - self.extra[to]) ** 2)

    def _load(self, rows: np.ndarray, routing: int) -> int:
        """Make the page of ``rows`` under a routing row, and the pages below it."""
        away = self.distance(rows, routing)
        page = {"routing": routing, "radius": float(away.max(initial=0))}
        parts = self._split(rows) if len(rows) > PAGE else []
        if len(parts) > 1:
            below = [self._load(part, at) for part, at in parts]
            page["below"] = np.array(below)
            page["radii"] = np.array([self.pages[i]["radius"] for i in below])
            page["rows"] = np.array([at for _, at in parts])
        else:  # few rows, or rows that do not differ
            page["rows"] = rows
        page["parent"] = self.distance(page["rows"], routing)
        self.pages.append(page)
        return len(self.pages) - 1

    def _split(self, rows: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Rows dealt to the nearest of far-apart routing rows; an overfull part is cut."""
        want = min(PAGE, -(-len(rows) // PAGE) + 1)
        centres = [int(rows[0])]
        near = self.distance(rows, centres[0])
        which = np.zeros(len(rows), np.int64)
        while len(centres) < want and near.max() > 0:
            centres.append(int(rows[near.argmax()]))
            d = self.distance(rows, centres[-1])
            which[d < near] = len(centres) - 1
            near = np.minimum(near, d)
        return [(rows[which == i], c) for i, c in enumerate(centres) if (which == i).any()]

    def search(
        self, queries: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, floor: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query the rows among the k best scores: query numbers, rows, scores.

        All rows that tie with the k-th are returned, none below ``floor``; the row with the
        query's ``own`` id is left out. Scores are whole numbers, summed in doubles where these hold
        them exactly, else in 64-bit integers. Bounds leave room for the rounding of large squares,
        and rounding keeps order, so comparing rounded scores loses no row.
        """
        q = queries.astype(np.float64)
        whole = np.einsum("ij,ij->i", q, q) + self.norm2
        largest = max(np.abs(q).max(initial=0), np.abs(self.vectors).max(initial=0)) ** 2 * q.shape[1]
        whole_numbers = self.vectors.astype(np.int64) if largest >= EXACT else None
        room = 1e-6 * np.sqrt(whole) if largest >= EXACT else np.zeros(len(q))
        best = np.full((len(q), k), -np.inf)
        least = floor.astype(np.float64)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def reach(who: np.ndarray) -> np.ndarray:
            """How far an entry may be for a query to still gain from it."""
            d = np.sqrt(np.maximum(whole[who] - 2 * np.maximum(least[who], -1e300), 0))
            return d * (1 + 1e-9) + 1e-6 + room[who]

        def away(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(whole[who, None] - 2 * (q[who] @ self.vectors[rows].T), 0))

        everyone = np.arange(len(q))
        start = self.pages[self.root]["routing"]
        agenda = [(0.0, self.root, everyone, away(everyone, np.array([start]))[:, 0])]
        while agenda:
            _, i, who, to_routing = heapq.heappop(agenda)
            page = self.pages[i]
            alive = to_routing - page["radius"] <= reach(who)
            who, to_routing = who[alive], to_routing[alive]
            if not len(who):
                continue
            radii = page.get("radii", 0.0)
            open_ = np.abs(to_routing[:, None] - page["parent"]) - radii <= reach(who)[:, None]
            some, cols = open_.any(1), np.flatnonzero(open_.any(0))
            who = who[some]
            if not len(who):
                continue
            if "below" in page:
                d = away(who, page["rows"][cols])
                near = (d - page["radii"][cols] <= reach(who)[:, None]) & open_[some][:, cols]
                for j, c in enumerate(cols):
                    if (m := near[:, j]).any():
                        bound = float((d[m, j] - page["radii"][c]).min())
                        heapq.heappush(agenda, (bound, int(page["below"][c]), who[m], d[m, j]))
                continue
            rows = page["rows"][cols]
            if whole_numbers is None:
                exact = np.rint(q[who] @ self.vectors[rows].T).astype(np.int64)
            else:
                exact = queries[who].astype(np.int64) @ whole_numbers[rows].T
            score = exact.astype(np.float64)
            score[own[who, None] == ids[rows]] = -np.inf
            a, b = np.nonzero((score >= least[who, None]) & np.isfinite(score))
            hits.append((who[a], rows[b], exact[a, b]))
            top = np.concatenate([best[who], score], 1)
            best[who] = np.partition(top, top.shape[1] - k, 1)[:, -k:]
            least[who] = np.maximum(least[who], best[who].min(1))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        n, rows, score = (np.concatenate(x) for x in zip(*hits))
        keep = score.astype(np.float64) >= least[n]
        return n[keep], rows[keep], score[keep]


def _pack(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def _packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of bounded size: its ids, vectors and floors as one binary."""
    names = ", ".join(f"{c} bigint" for c in by)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        data = _pack(
            ids=group["vec_id"].to_numpy(np.int64),
            vectors=np.stack(group["v"].to_list()).astype(np.int64),
            floor=group["floor"].to_numpy(np.float64),
        )
        return pd.DataFrame([[*key, data]], columns=[*by, "data"])

    return rows.groupBy(*by).applyInPandas(pack, f"{names}, data binary")


def _trees(items: DataFrame) -> DataFrame:
    """``(dim, shard, tree)``: every shard's vectors in the order of its leaves, loaded once."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        vectors = np.stack(group["v"].to_list()).astype(np.int64)
        blob = pickle.dumps((MTree(vectors), group["vec_id"].to_numpy(np.int64)))
        return pd.DataFrame([[*key, blob]], columns=["dim", "shard", "tree"])

    return items.groupBy("dim", "shard").applyInPandas(build, "dim bigint, shard bigint, tree binary")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs(tree, data)`` to the best rows of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, block in zip(batch["tree"], batch["data"], strict=True):
                tree, ids = pickle.loads(blob.as_py())
                queries = np.load(io.BytesIO(block.as_py()))
                n, rows, score = tree.search(
                    queries["vectors"], k, queries["ids"], ids, queries["floor"]
                )
                # Of ties at the end only the smallest ids can be among the k best.
                order = np.lexsort((ids[rows], -score, n))
                n, rows, score = n[order], rows[order], score[order]
                keep = np.arange(len(n)) - np.searchsorted(n, n) < k
                yield pa.RecordBatch.from_pydict(
                    {"query_id": queries["ids"][n[keep]], "vec_id": ids[rows[keep]],
                     "score": score[keep]}
                )

    # One pair at a time in memory, and pairs dealt evenly.
    return pairs.mapInArrow(run, _FOUND)


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component, without unusable vectors."""
    bad = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(usable).where(~bad)
    # No product of two such vectors leaves 64 bits.
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size("v")))
    fits = F.forall("v", lambda x: (x <= most) & (x >= -most))
    wrong = F.raise_error(F.lit("vector too large for 64-bit scores")).cast("array<bigint>")
    ids = F.col("vec_id").cast("long").alias("vec_id")
    return rows.select(ids, whole.alias("v")).select("vec_id", F.when(fits, F.col("v")).otherwise(wrong).alias("v"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row whose id is divisible by ``every``.

    ``vectors`` has ``vec_id`` and ``embedding``; components become floor(64 * x). Scores are inner
    products with every other row, highest first, ties to the smaller id; fewer rows give fewer
    ranks. Components so large that a score could leave 64 bits fail the job. Rows without an id,
    null or empty vectors and vectors with a null or non-finite component take no part; vectors of
    another length are no candidates. A query id that repeats is one query, all rows of its id are its own; other repeated rows are candidates each.
    """
    items = cut(quantized(vectors).withColumn("dim", F.size("v").cast("long")))
    per = {r[0]: (r[1], r[2]) for r in items.groupBy("dim").agg(
        F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).collect()}

    def parts(sizes: dict[int, int], salt: int):
        """A part number by a hash of the id, as many as the dimension needs."""
        n = F.lit(1)
        for dim, size in sizes.items():
            n = F.when(F.col("dim") == dim, size).otherwise(n)
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id", F.col("row")), n)

    shards = {d: max(1, -(-n // SHARD)) for d, (n, _) in per.items()}
    blocks = {d: max(1, -(-m // BLOCK)) for d, (_, m) in per.items()}
    rows = items.withColumn("row", F.monotonically_increasing_id())
    trees = cut(_trees(rows.withColumn("shard", parts(shards, 1)).drop("row")))
    queries = items.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    queries = queries.withColumn("row", F.lit(0)).withColumn("block", parts(blocks, 2)).drop("row")
    queries = cut(queries.withColumn("floor", F.lit(float("-inf"))))
    n = F.lit(1)
    for dim, size in shards.items():
        n = F.when(F.col("dim") == dim, size).otherwise(n)
    by = ["dim", "block"]
    home = _packed(queries, by).withColumn("shard", F.pmod("block", n))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(_search(home.join(trees, ["dim", "shard"]).repartition(spread, *by), k))
    floors = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("m"), F.min("score").alias("low")
    )
    floors = floors.where(F.col("m") >= k).select(F.col("query_id").alias("vec_id"), "low")
    raised = queries.drop("floor").join(floors, "vec_id", "left")
    raised = raised.withColumn("floor", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))))
    away = _packed(raised, by).withColumn("shard", F.explode(F.sequence(F.lit(0), n - 1)))
    away = away.where(F.col("shard") != F.pmod("block", n))
    pairs = away.join(trees, ["dim", "shard"]).repartition(spread, "shard", *by)
    everything = found.unionByName(_search(pairs, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
