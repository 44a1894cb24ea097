"""Near-duplicate detection by bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed to 64 bits. The hash range is divided in
``STRATA`` equal strata. The ``RUN`` smallest values of a stratum together are a key of the inverted
lists: single values would put all documents with a common phrase in one list, whole runs of them
only like documents. For estimates the sketch retains ``DEPTH`` values of each stratum, or the whole
set if it has no more than ``STRATA * DEPTH`` values.

1. Documents with equal sets are one class; the work goes on with one of each class.
2. Lists of up to ``SMALL`` classes give all their pairs. Longer lists give a star: each member
   with a leader, picked by one of ``ORDERS`` hash orders of the ids.
3. Pairs whose sketches cannot reach the threshold fall away: whole sets are compared as they are,
   sketches by an upper bound of the union-sketch estimate plus six standard deviations.
   The rest is verified on the full sets.
4. Verified links join classes to components. In long lists that still hold several of them,
   each member outside the list's main component is compared with all members of other components,
   in blocks of at most ``BLOCK`` by ``BLOCK`` members, by the same rule: first by the smallest value
   of each stratum, then by the sketches. A pair counts in its first common list only. Of these
   comparisons only the members with a likely pair leave, never the pairs, whose number grows with
   the square of a crowd. Such members meet once more in the same blocks, now with their full sets;
   likely pairs that are not yet connected there are verified, and the links found are a forest of
   the block. This is the exact way for what the stars left open.

Two sets at the threshold share a given stratum's run with a chance of about one in two, so that
one of 32 keys is shared by all but some 1e-10 of them. Sets of up to ``TINY`` values may differ in one or
two values at 80 % or more, so the sets that are left without one value, or without two, are keys of
theirs as well: then some key is shared for certain. Larger sets of few values miss all shared strata
with a chance below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.graph import components
from earshot.llm.pieces import slices
from earshot.llm.words import mix, shingles, utf8, word_hashes, word_places
from earshot.session import cut

STRATA, RUN, DEPTH = 32, 3, 8
#: Sets of so many values are listed without one value too, and those of over ``ONE`` without two.
TINY, ONE = 14, 7
SMALL, ORDERS, BLOCK = 8, 4, 4_096
#: Bytes of text hashed at once.
SLICE = 1 << 22
#: Bytes of full sets that are compared in one task at once.
CELL = 1 << 24
#: Hash buckets that say which sets to read again for verification.
BUCKETS = 1 << 20
_SKETCH = (
    "doc_id bigint, mark bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, marks binary, "
    "kept array<int>, whole boolean"
)


def document_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = utf8(column)
    for i, j in slices(np.diff(at).tolist(), SLICE):
        part = data[at[i] : at[j]]
        starts, ends, first = word_places(part, at[i : j + 1] - at[i])
        hashes = word_hashes(part, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield shingles(hashes[a:b], words)


def sketch(values: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray, bool]:
    """Of a sorted set: each stratum's key (0 if it is empty); each stratum's smallest value and key
    cut to 32 bits; the retained values cut to 32 bits; and whether these are all of the set."""
    stratum = (values >> np.uint64(64 - STRATA.bit_length() + 1)).astype(np.int64)
    place = np.arange(len(values)) - np.searchsorted(stratum, stratum)
    run, group = values[place < RUN], stratum[place < RUN]
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    keys, least = np.zeros(STRATA, np.uint64), np.zeros(STRATA, np.uint32)
    hashes = mix(np.add.reduceat(mix(run), at) + np.uint64(1))
    # The lowest bits are the stratum's number, the next one says that it is filled.
    low = np.uint64(2 * STRATA - 1)
    keys[group[at]] = (hashes & ~low) | np.uint64(STRATA) | group[at].astype(np.uint64)
    least[group[at]] = run[at].astype(np.uint32) | np.uint32(1)
    marks = np.concatenate([least, (keys >> np.uint64(32)).astype(np.uint32)]).tobytes()
    whole = len(values) <= STRATA * DEPTH
    kept = values if whole else values[place < DEPTH]
    return keys, marks, np.unique(kept.astype(np.uint32)), whole


def without_few(values: np.ndarray) -> np.ndarray:
    """Keys of a tiny set and of what is left of it without one value or two.

    The bit that says "stratum filled" is not set, which tells them from the other keys.
    """
    spread = mix(values)
    sums = np.sum(spread, dtype=np.uint64) - np.concatenate([np.zeros(1, np.uint64), spread])
    if len(values) > ONE:
        i, j = np.triu_indices(len(values), 1)
        sums = np.concatenate([sums, sums[0] - spread[i] - spread[j]])
    keys = mix(sums + np.uint64(1)) & ~np.uint64(STRATA)
    return np.unique(np.where(keys == 0, np.uint64(1), keys))


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(kind)))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, mark, n, f1, f2, keys, marks, kept, whole)``: a hash of the text, set size, set
    fingerprint, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), b"", np.zeros(0, np.uint32), True
        for batch in batches:
            sizes, prints, keys, marks, kept, whole = [], [], [], [], [], []
            for values in document_sets(batch["text"], words):
                k, m, v, w = sketch(values) if len(values) else none
                sizes.append(len(values))
                total = np.sum(mix(values), dtype=np.uint64)
                prints.append((total, np.bitwise_xor.reduce(values, initial=0)))
                keys.append(np.concatenate([k, without_few(values)]) if 0 < len(values) <= TINY else k)
                marks.append(m)
                kept.append(v)
                whole.append(w)
            sums = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["mark"], pa.array(sizes, pa.int64()), pa.array(sums[:, 0]),
                 pa.array(sums[:, 1]), _lists(keys, np.int64), pa.array(marks, pa.binary()),
                 _lists(kept, np.int32),
                 pa.array(whole, pa.bool_())],
                ["doc_id", "mark", "n", "f1", "f2", "keys", "marks", "kept", "whole"],
            )

    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark, "text")
    return rows.mapInArrow(run, _SKETCH)


def _sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")


def _bound(a: str, b: str, percent: int) -> Column:
    """Whether the sketches allow the threshold: surely for whole sets, else within six deviations."""
    t = percent / 100
    shared = F.size(F.array_intersect(f"{a}kept", f"{b}kept"))
    union = (F.col(f"{a}n") + F.col(f"{b}n")) / (1 + t)
    fewest = F.least(F.size(f"{a}kept"), F.size(f"{b}kept"))
    share = F.greatest(F.lit(0.0), 1 - fewest / union)  # the sketch is a sample without replacement
    slack = 6 * F.sqrt(t * (1 - t) * fewest * share) + 1
    exact = 100 * shared >= percent * (F.col(f"{a}n") + F.col(f"{b}n") - shared)
    both = F.col(f"{a}whole") & F.col(f"{b}whole")
    return F.when(both, exact).otherwise(shared >= t * fewest - slack)


def _only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Few rows of ``table`` besides those with one of ``ids``: by hash buckets, at most BUCKETS."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("_bucket")
    buckets = F.broadcast(ids.select(bucket).distinct())
    return table.withColumn("_bucket", bucket).join(buckets, "_bucket", "left_semi").drop("_bucket")


def _side(classes: DataFrame, name: str) -> DataFrame:
    columns = (F.col(c).alias(f"{name}_{c}") for c in ("n", "kept", "whole"))
    return classes.select(F.col("id").alias(name), *columns)


def _likely_pairs(group: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a list's cell, members with the later ones that they are a likely pair with, by place.

    Pairs of one ``root`` are left out, and those that share an earlier list. ``piece`` tells the two
    sides of a cell apart; in a cell of ``alike`` sides all members are compared.
    """
    t = percent / 100
    number, alike = int(group["key"].iloc[0]), group["alike"].iloc[0]
    # A list of tiny sets has no place among the strata: its pairs count whatever they share there.
    stratum = number & (STRATA - 1) if number & STRATA else 0
    ids, roots, piece = (group[c].to_numpy() for c in ("id", "root", "piece"))
    n, whole = group["n"].to_numpy(), group["whole"].to_numpy()
    marks = np.frombuffer(b"".join(group["marks"]), np.uint32).reshape(len(ids), 2, STRATA)
    least, keys = marks[:, 0].T.copy(), marks[:, 1]
    filled = (least > 0).sum(0)
    kept = [np.sort(np.asarray(k).astype(np.uint32)) for k in group["kept"]]
    sizes = np.array([len(k) for k in kept])
    begin, flat = np.cumsum(np.r_[0, sizes]), np.concatenate(kept)
    is_main = roots == group["main"].iloc[0]
    for a in np.flatnonzero(~is_main):
        ok = (roots != roots[a]) & (is_main | (ids > ids[a]))
        ok &= 100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a])
        if not alike:
            ok &= piece != piece[a]
        b = np.flatnonzero(ok)
        if not len(b):
            continue
        same = ((least[:, b] == least[:, a, None]) & (least[:, a, None] > 0)).sum(0)
        strata = np.maximum(filled[b], filled[a])
        b = b[same >= t * strata - 6 * np.sqrt(t * (1 - t) * strata)]
        before = (keys[b, :stratum] == keys[a, :stratum]) & (keys[a, :stratum] > 0)
        b = b[~before.any(1)]
        if not len(b):
            continue
        at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in b])
        place = np.minimum(np.searchsorted(kept[a], flat[at]), sizes[a] - 1)
        hit = kept[a][place] == flat[at]
        shared = np.add.reduceat(hit, np.cumsum(np.r_[0, sizes[b]])[:-1], dtype=np.int64)
        fewest = np.minimum(sizes[b], sizes[a])
        share = np.maximum(0, 1 - fewest * (1 + t) / (n[b] + n[a]))
        near = shared >= t * fewest - 6 * np.sqrt(t * (1 - t) * fewest * share) - 1
        exact = 100 * shared >= percent * (n[b] + n[a] - shared)
        b = b[np.where(whole[b] & whole[a], exact, near)]
        if len(b):
            yield a, b


def _with_likely_pairs(percent: int):
    """The members of a cell that are in a likely pair."""

    def members(group: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(group), bool)
        for a, b in _likely_pairs(group, percent):
            hit[a] = hit[b] = True
        return group.loc[hit, ["key", "low", "high", "piece", "id", "root", "main", "n"]]

    return members


def _linked_in_cell(percent: int):
    """Links of likely pairs by their full sets: no more than connect what the cell connects."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(v, np.uint64) for v in group["values"]]
        _, marks, kept, whole = zip(*map(sketch, sets), strict=True)
        ids, (_, part) = group["id"].to_numpy(), np.unique(group["root"], return_inverse=True)
        group = group.assign(n=[len(v) for v in sets], marks=marks, kept=kept, whole=whole)
        found = []
        for a, others in _likely_pairs(group, percent):
            for b in others:
                if part[a] != part[b] and _reach(sets[a], sets[b], percent):
                    found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                    part[part == part[b]] = part[a]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return links


def _full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``(id, values)``: the full sets of ``ids(id)`` and of few others, from the texts again.

    Hash buckets of the wanted ids, at most ``BUCKETS`` bits, keep most other texts from being hashed
    and shuffled; a join decides.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    wanted = np.zeros(BUCKETS, bool)
    wanted[ids.select(bucket).distinct().toArrow()["bucket"].to_numpy()] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            part = batch.filter(pa.array(wanted[batch["bucket"].to_numpy()]))
            values = [v.tobytes() for v in document_sets(part["text"], words)]
            yield pa.RecordBatch.from_arrays(
                [part["id"], pa.array(values, pa.binary())], ["id", "values"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    return rows.select("id", bucket, "text").mapInArrow(sets, "id bigint, values binary")


def _reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def linked_in_cells(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b)``: links among ``members(key, low, high, piece, id, root, main, n)`` of crowds, which
    are those of a list's cells that have likely pairs there.

    A set is sent once to each cell. A cell whose sets take over ``CELL`` bytes is cut into pieces,
    every two of which meet in a cell of their own. Rows that repeat an id with another text are each
    compared; any that reaches it links.
    """
    cell = ["key", "low", "high"]
    parts = F.least(F.ceil(F.sum("n") * 8 * 2 / max(CELL, 1)), F.count(F.lit(1))).cast("bigint")
    weight = members.groupBy(*cell).agg(F.when(F.sum("n") * 8 > CELL, parts).otherwise(1).alias("_parts"))
    # A cell of two blocks is cut on both sides, so that pieces of one side need not meet.
    finer = (F.col("piece") * F.col("_parts") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("_parts"))).alias("_own")
    sides = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1), lambda i: F.when(
        F.col("low") == F.col("high"), F.col("low") * F.col("_parts") + i).otherwise(
        (F.col("low") + F.col("high") - F.col("piece")) * F.col("_parts") + i))
    placed = members.join(weight, cell).select("*", finer).withColumn("_other", F.explode(sides))
    placed = placed.select(
        "key", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"),
        F.col("_own").alias("piece"), F.col("_parts").alias("parts"), "id", "root", "main",
    ).withColumn("alike", F.col("low") == F.col("high"))
    sets = _full_sets(members.select("id").distinct(), docs, words).where(F.length("values") > 0)
    met = placed.join(sets, "id")
    return met.groupBy("key", "parts", "low", "high").applyInPandas(_linked_in_cell(percent), "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold."""
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, words)
    one = full.select(F.col("id").alias("a"), F.col("values").alias("x"))
    two = full.select(F.col("id").alias("b"), F.col("values").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_reach(x, y, percent))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield part.select(["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(
        check, "a bigint, b bigint"
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text, …)``: its set size, component and whether it stays.

    Links documents whose sets of ``words``-word shingles have 100 * intersection >= ``percent`` *
    union; ``component_id`` is the smallest id reachable. A text with fewer words is one shingle;
    one without words, or a null text, has an empty set and is alone. A row without an id is
    alone too, with a null component, and stays. Rows that repeat an id with another text are
    judged by their own text. Other columns are not read; an empty table gives an empty one.
    """
    return _near(docs, words, percent).drop("mark")


def _near(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """`near_duplicates`, with a hash of each row's text."""
    base = cut(sketches(docs, words))
    filled = base.where("n > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal sketches, so any row's will do.
    one_of = [F.first(c).alias(c) for c in ("keys", "marks", "kept", "whole")]
    classes = cut(
        filled.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), *one_of)
    )
    entries = classes.select("id", F.explode("keys").alias("key")).where("key <> 0")
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = cut(entries.join(lists, "key"))

    few = listed.where(F.col("size") <= SMALL).groupBy("key").agg(
        F.sort_array(F.collect_list("id")).alias("m")  # at most SMALL
    )
    pairs_of = F.transform("m", lambda x, i: F.transform(
        F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    near = few.select(F.inline(F.flatten(pairs_of)))
    many = listed.where(F.col("size") > SMALL).select("key", "id")
    # A few orders of the ids, so that lists of the same crowd share leaders, but not all one.
    order = F.struct(F.xxhash64("id", F.col("key").bitwiseAND(F.lit(ORDERS - 1))), "id")
    lead = many.groupBy("key").agg(F.min(order)["id"].alias("lead"))
    star = many.join(lead, "key").where("id <> lead")
    star = star.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    pairs = cut(near.unionByName(star).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = _only(classes, ends).select("id", "n", "kept", "whole")
    likely = (
        pairs.join(_side(known, "a"), "a").join(_side(known, "b"), "b")
        .where(_sizes("a_", "b_", percent) & _bound("a_", "b_", percent)).select("a", "b")
    )
    links = cut(verified(cut(likely), docs, words, percent))
    roots = cut(components(links))

    named = many.join(roots, "id", "left")
    named = cut(named.select("key", "id", F.coalesce("root", "id").alias("root")))
    shares = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = shares.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"),
        F.max(F.struct("c", "root"))["root"].alias("main"),
        F.ceil(F.sum("c") / BLOCK).cast("bigint").alias("blocks"),
    )
    open_lists = cut(named.join(main.where("roots > 1"), "key"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, "block").alias("low"), F.greatest(i, "block").alias("high")),
    )
    placed = open_lists.withColumn("block", own).withColumn("pair", F.explode(pair))
    wanted = _only(classes, open_lists.select("id")).select("id", "n", "marks", "kept", "whole")
    met = placed.join(wanted, "id").select(
        "key", "pair.low", "pair.high", F.col("block").alias("piece"), "id", "root", "main", "n", "marks", "kept", "whole"
    )
    met = met.withColumn("alike", F.col("low") == F.col("high"))
    left = cut(met.groupBy("key", "low", "high").applyInPandas(
        _with_likely_pairs(percent),
        "key bigint, low bigint, high bigint, piece bigint, id bigint, root bigint, main bigint, n bigint",
    ))
    if not left.isEmpty():
        more = linked_in_cells(left, docs, words, percent)
        stars = roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        roots = cut(components(stars.unionByName(more)))
    of = classes.select("f1", "f2", "n", "id").join(roots, "id", "left").select(
        "f1", "f2", "n", F.coalesce("root", "id").alias("root")
    )
    root = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    root = F.when(F.col("doc_id").isNotNull(), root)
    return base.select("doc_id", "mark", "n", "f1", "f2").join(of, ["f1", "f2", "n"], "left").select(
        "doc_id",
        "mark",
        F.col("n").alias("n_shingles"),
        root.alias("component_id"),
        F.col("doc_id").eqNullSafe(root).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; all columns stay.

    Rows that repeat an id are judged by their own texts. Rows without an id all stay.
    """
    keep = _near(docs, words, percent).where("kept AND doc_id IS NOT NULL")
    keep = keep.select(F.col("doc_id").alias("_key"), F.col("mark").alias("_mark")).distinct()
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark")
    row = docs.select(F.col("doc_id").alias("_key"), mark, F.struct("*").alias("_row"))
    known = row.join(keep, ["_key", "_mark"], "left_semi")
    return known.unionByName(row.where(F.col("_key").isNull())).select("_row.*")
