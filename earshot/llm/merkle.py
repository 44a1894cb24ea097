"""A Merkle manifest of a dataset, and proofs of its rows as octopus multiproofs.

Rows are leaves, one tree for each language, and the trees' roots are the leaves of a last tree. Trees
are built in blocks of 2**BITS nodes, so that a task never holds more of a tree than a block.
For proofs, a block of leaves works out which nodes it can't derive itself (the union over its
leaves, each named once), gets these in one join, derives what its leaves share, and writes every
leaf's own proof.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import fold
from earshot.operators.indexing import dense_rank_by
from earshot.session import cut

#: Levels that are built at once: blocks of 1,024 nodes.
BITS = 10
#: Trees, or nodes of the upper levels, that may be broadcast; some 100 bytes each.
FEW = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WANTED = "tree string, block long, level int, idx long"
_PROOF = (
    "doc_id long, leaf string, tampered string, subroot string, root string, siblings array<string>, "
    "proof_sha256 string, folded_root string"
)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(**changed: Column) -> Column:
    """Lower-case hex SHA-256 of a row's fields, each ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        size = F.octet_length(value).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), value)))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


@dataclass
class Manifest:
    """``leaves`` (tree, idx, block, doc_id, leaf, tampered), ``nodes`` (tree, level, idx, hash) above
    them, ``trees`` (tree, n, subroot, up, sides, root): ``up`` is a tree's proof among the trees."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    few_trees: bool
    height: int


def _grow(rows: DataFrame, most: int) -> DataFrame:
    """All nodes above ``rows(tree, idx, n, hash)``; ``most`` is the largest tree's number of rows."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        level, n = int(frame["level"].iloc[0]), int(frame["n"].iloc[0])
        at, now = int(frame["idx"].iloc[0]), frame["hash"].tolist()
        out = []
        for _ in range(BITS):
            if n == 1:
                break
            now = [digest("".join(now[i : i + 2])) for i in range(0, len(now), 2)]
            level, n, at = level + 1, -(-n // 2), at >> 1
            out += [(level, at + i, n, h) for i, h in enumerate(now)]
        made = pd.DataFrame(out, columns=["level", "idx", "n", "hash"])
        made.insert(0, "tree", frame["tree"].iloc[0])
        return made

    schema = "tree string, level int, idx long, n long, hash string"
    now, level, made = rows.withColumn("level", F.lit(0)), 0, []
    while most > 1:
        blocks = now.where("n > 1").groupBy("tree", F.shiftright("idx", BITS).alias("block"))
        step = cut(blocks.applyInPandas(block, schema))
        made.append(step)
        level, most = level + BITS, -(-most // (1 << BITS))
        now = step.where(F.col("level") == level)
    spark = rows.sparkSession
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], schema)


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """``(level, idx)`` of the nodes that ``known`` leaves of a tree of ``n`` need but can't derive."""
    out, level = [], 0
    while n > 1:
        beside = known ^ 1
        beside = beside[(beside < n) & ~np.isin(beside, known)]
        out += [(level, int(i)) for i in beside]
        known, n, level = np.unique(known >> 1), -(-n // 2), level + 1
    return out


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``; other columns don't count.

    Per language, leaves ascend by doc_id (null first), rows that repeat an id by their hash. ``tampered``
    is the leaf hash with 1 added to n_chars where 7 divides the CRC of the decimal doc_id, n_chars is
    not null and doc_id isn't either; else null. An empty table has no leaf, no node and no root.
    """
    odd = (fold("doc_id", 7) == 0) & F.col("n_chars").isNotNull() & F.col("doc_id").isNotNull()
    rows = cut(docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash().alias("leaf"),
        F.when(odd, leaf_hash(n_chars=F.col("n_chars") + 1)).alias("tampered"),
    ))
    order = [F.asc("tree"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    placed = dense_rank_by(rows, order, "at")
    starts = placed.groupBy("tree").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    starts = cut(starts)
    number, most = starts.agg(F.count(F.lit(1)), F.max("n")).first()
    few = number <= FEW
    small = F.broadcast(starts) if few else starts
    idx = F.col("at") - F.col("start")
    leaves = placed.join(small, "tree").select(
        "tree", idx.alias("idx"), F.shiftright(idx, BITS).alias("block"), "n", "doc_id", "leaf", "tampered"
    )
    leaves = cut(leaves)
    nodes = _grow(leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")), most or 0)
    tops = leaves.where("n = 1").select("tree", F.col("leaf").alias("subroot")).unionByName(
        nodes.where("n = 1").select("tree", F.col("hash").alias("subroot")))
    ranked = dense_rank_by(tops, [F.asc("tree")], "idx")
    ranked = cut(ranked.withColumn("n", F.lit(number).cast("long")))
    over = _grow(ranked.select(F.lit("").alias("tree"), "idx", "n", F.col("subroot").alias("hash")), number)
    bare = ranked.select(F.lit("").alias("tree"), F.lit(0).alias("level"), "idx", F.col("subroot").alias("hash"))
    over = bare.unionByName(over.drop("n"))
    root = over.where(F.col("level") == height(number)).first()  # one value
    proofs = _tree_proofs(ranked, over, number).join(starts.drop("start"), "tree")
    return Manifest(
        leaves,
        nodes.drop("n"),
        cut(proofs.withColumn("root", F.lit(root["hash"] if root else None).cast("string"))),
        few,
        height(most or 0),
    )


def height(n: int) -> int:
    return max(0, n - 1).bit_length()


def _tree_proofs(ranked: DataFrame, over: DataFrame, number: int) -> DataFrame:
    """``(tree, subroot, up, sides)``: each tree's siblings in the last tree, level by level.

    A side is ``l`` or ``r``, where the sibling stands, or ``-`` where a level has none.
    """
    up = ranked.select("tree", "subroot", "idx")
    levels, sides = [], []
    for level in range(height(number)):
        at = F.shiftright("idx", level).bitwiseXOR(F.lit(1))
        there = -(-number // (1 << level))
        side = F.when(at >= there, "-").when(at % 2 == 0, "l").otherwise("r")
        beside = over.where(F.col("level") == level).select(
            F.col("idx").alias("_at"), F.col("hash").alias(f"_h{level}")
        )
        up = up.withColumn("_at", at).withColumn(f"_s{level}", side).join(beside, "_at", "left").drop("_at")
        levels.append(F.col(f"_h{level}"))
        sides.append(F.col(f"_s{level}"))
    none = F.array().cast("array<string>")
    return up.select(
        "tree",
        "subroot",
        (F.array_compact(F.array(*levels)) if levels else none).alias("up"),
        (F.concat(*sides) if sides else F.lit("")).alias("sides"),
    )


def _fetched(made: Manifest, wanted: DataFrame) -> DataFrame:
    """The nodes at ``wanted`` coordinates, by block.

    Nodes over 2 * BITS levels up are wanted by many blocks each, but there are few of them.
    """
    leaves = made.leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"))
    keys = ["tree", "level", "idx"]
    low = F.col("level") <= 2 * BITS
    near = made.nodes.where(low).unionByName(leaves)
    out = wanted.where(low).join(near, keys)
    if made.height > 2 * BITS:
        far = made.nodes.where(~low)
        far = F.broadcast(far) if far.limit(FEW + 1).count() <= FEW else far
        out = out.unionByName(wanted.where(~low).join(far, keys))
    return out.select("tree", "block", "level", "idx", "hash")


def prove(made: Manifest, ids: DataFrame | None = None, siblings: bool = True) -> DataFrame:
    """The proofs of all leaves, or of those whose doc_id is in ``ids(doc_id)``.

    ``(doc_id, leaf, tampered, subroot, root, siblings, proof_sha256, folded_root)``: ``siblings`` is
    the proof, level by level to the root (null unless asked for), ``proof_sha256`` the hash of it
    joined; ``folded_root`` the root that follows from the tampered leaf (else the leaf) and the proof.
    Rows that repeat an id are proved each. A null id is no id of ``ids``.
    """
    leaves = made.leaves
    if ids is not None:
        leaves = leaves.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    by = ["tree", "block"]

    def coordinates(key, frame):
        out = missing(np.unique(frame["idx"].to_numpy()), int(frame["n"].iloc[0]))
        rows = pd.DataFrame(out, columns=["level", "idx"])
        return rows.assign(tree=key[0], block=key[1])[["tree", "block", "level", "idx"]]

    def expand(key, frame, beside):
        frame = frame.sort_values("idx")
        known: list[dict[int, str]] = [dict(zip(frame["idx"].tolist(), frame["leaf"].tolist(), strict=True))]
        first = frame.iloc[0]
        depth = height(int(first["n"]))
        known += [{} for _ in range(depth)]
        for level, idx, h in zip(beside["level"], beside["idx"], beside["hash"], strict=True):
            known[level][int(idx)] = h
        n = int(first["n"])
        for level in range(depth):
            now, up = known[level], known[level + 1]
            for i in {i >> 1 for i in now}:
                if i not in up and 2 * i in now and (2 * i + 1 in now or 2 * i + 1 >= n):
                    up[i] = digest(now[2 * i] + now.get(2 * i + 1, ""))
            n = -(-n // 2)
        over, sides = list(first["up"]), first["sides"]
        out = []
        for doc_id, leaf, tampered, i in zip(
            frame["doc_id"], frame["leaf"], frame["tampered"], frame["idx"], strict=True
        ):
            proof, h = [], tampered or leaf
            for level in range(depth):
                other = known[level].get(i ^ 1, "")
                h = digest(other + h if i & 1 else h + other)
                proof.append(other)
                i >>= 1
            rest = iter(over)
            for side in sides:
                other = "" if side == "-" else next(rest)
                h = digest(other + h if side == "l" else h + other)
                proof.append(other)
            row = [p for p in proof if p] if siblings else None
            out.append((doc_id, leaf, tampered, first["subroot"], first["root"], row, digest("".join(proof)), h))
        names = [field.split()[0] for field in _PROOF.split(", ")]
        return pd.DataFrame(out, columns=names)

    trees = F.broadcast(made.trees) if made.few_trees else made.trees
    held = leaves.withColumn("tampered", F.coalesce("tampered", F.lit("")))
    held = held.join(trees.drop("n"), "tree")
    # Ids travel as text: pandas would turn a column with a null into doubles.
    held = held.withColumn("doc_id", F.col("doc_id").cast("string"))
    wanted = leaves.select(*by, "idx", "n").groupBy(*by).applyInPandas(coordinates, _WANTED)
    fetched = _fetched(made, wanted)
    proofs = held.groupBy(*by).cogroup(fetched.groupBy(*by)).applyInPandas(
        expand, _PROOF.replace("doc_id long", "doc_id string")
    )
    return proofs.withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "tampered": F.nullif("tampered", F.lit(""))}
    )
