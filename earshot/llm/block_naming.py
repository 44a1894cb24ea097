"""Exact de-duplication by deterministic block naming, in DataFrame operations only.

A text without white space is cut into blocks of a fixed number of characters. The distinct
blocks are sorted and numbered; then adjacent pairs of numbers are numbered the same way, and
so on, until one number is left of each text. Two texts have the same number after the same
number of rounds exactly if they are equal: nothing rests on a hash.

Only texts whose length and 64-bit hash occur more than once can be equal, so only they are
named. They are found through a table of at most ``BUCKETS`` hash buckets, the one thing that
is broadcast; more texts than buckets let more texts through, never fewer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import stored
from earshot.session import cut

BLOCK = 16_384
BUCKETS = 1 << 20
KEY = ["doc_id", "_hash", "_bytes"]


def squeezed(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09-0x0D; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for char in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _named(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Number the distinct values of ``parts`` in their order, and put the number in ``_name``.

    The order is by hash first, so that the driver sees only hashes when ranges are chosen, then
    by the values themselves. The numbers are written before use: every reader sees the same ones.
    """
    distinct = rows.select(*parts).distinct().withColumn("_order", F.xxhash64(*parts))
    in_order = distinct.repartitionByRange("_order").sortWithinPartitions("_order", *parts)
    names = cut(in_order.drop("_order").withColumn("_name", F.monotonically_increasing_id()))
    return rows.join(names, parts)


def text_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, _hash, _bytes, _round, _name)`` of rows ``(doc_id, _hash, _bytes, _text)``."""
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    pieces = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(pieces)
    cells = docs.select(*KEY, pieces.alias("_pieces")).select(
        *KEY, F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("_at", "_piece")
    )
    cells = stored(cells, "blocks")
    level = cut(_named(cells, ["_piece"]).select(*KEY, "_n", "_at", "_name"))
    longest = level.agg(F.max("_n")).first()[0] or 1
    done = []
    rounds = math.ceil(math.log2(longest))
    for k in range(rounds + 1):
        done.append(
            level.where(F.col("_n") == 1).select(*KEY, F.lit(k).alias("_round"), "_name")
        )
        if k == rounds:
            break
        odd = F.col("_at") % 2 == 1
        pairs = (
            level.where("_n > 1")
            .groupBy(*KEY, F.ceil(F.col("_n") / 2).cast("int").alias("_n"),
                     F.shiftright("_at", 1).alias("_at"))
            .agg(
                F.max(F.when(~odd, F.col("_name"))).alias("_left"),
                F.coalesce(F.max(F.when(odd, F.col("_name"))), F.lit(-1)).alias("_right"),
            )
        )
        level = cut(_named(pairs, ["_left", "_right"]).select(*KEY, "_n", "_at", "_name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs(doc_id, text, …)``: which row stays for its text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts the one with the
    most code points in the original stays, then the smallest id; a row without an id gives way
    to one that has an id. A null text counts as empty, and so do texts of white space only:
    they are one group. Rows that repeat an id and its text are members like others and share
    the decision. Other columns are not read; an empty table gives an empty one.
    """
    return _groups(docs, block).drop("_chars", "_mark")


def _groups(docs: DataFrame, block: int) -> DataFrame:
    """`exact_groups`, with each row's code points and a hash of its text as it is."""
    plain = squeezed(F.col("text"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_given"), plain.alias("_text"))
    hashed = base.select(
        "doc_id", "_given", "_text",
        F.xxhash64("_text").alias("_hash"), F.octet_length("_text").alias("_bytes"),
    )
    marks = cut(
        hashed.select(
            *KEY,
            F.char_length("_given").alias("_chars"),
            F.xxhash64("_given").alias("_mark"),
            F.sha2("_text", 256).alias("text_sha256"),
        )
    )
    bucket = F.pmod(F.col("_hash"), F.lit(BUCKETS)).alias("_bucket")
    shared = marks.groupBy("_hash", "_bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # At most BUCKETS rows of one number each.
    buckets = F.broadcast(shared.select(bucket).distinct())
    named = text_names(
        hashed.withColumn("_bucket", bucket).join(buckets, "_bucket", "left_semi"), block
    )
    # Keys that nulls cannot break.
    safe = [F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    named = named.select(*safe, "_hash", "_bytes", "_round", "_name")
    rows = marks.select("*", *safe)
    on = ["_no_id", "_id", "_hash", "_bytes"]
    members = rows.join(named, on).select(*on, "doc_id", "_chars", "_round", "_name")
    best = F.min(F.struct(-F.col("_chars"), "_no_id", "doc_id"))["doc_id"]
    groups = members.groupBy("_round", "_name").agg(
        best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    decided = named.join(groups, ["_round", "_name"]).select(*on, "keep_id", "group_size")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(decided, on, "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "_chars",
        "_mark",
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Of rows that repeat an id each text is judged by itself; of equal texts of one id the longest
    row stays. Rows without an id all stay.
    """
    longest = F.max_by("_mark", F.struct("_chars", "_mark")).alias("_mark")
    keep = _groups(docs, block).where("kept AND doc_id IS NOT NULL")
    keep = keep.groupBy(F.col("doc_id").alias("_key"), "text_sha256").agg(longest).drop("text_sha256")
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark")
    row = docs.select(F.col("doc_id").alias("_key"), mark, F.struct("*").alias("_row"))
    known = row.join(keep, ["_key", "_mark"], "left_semi").dropDuplicates(["_key", "_mark"])
    return known.unionByName(row.where(F.col("_key").isNull())).select("_row.*")
