"""Ranked lexical search: best-first document intervals over range-maximum sparse tables.

Each task turns its documents, a shard at a time, into posting lists of integer impacts, with a sparse
table over each list. A query starts with the interval of all documents of the shard; an interval's
bound is the sum over the query's terms of the greatest impact inside it. The intervals with the highest
bounds are split at the document that holds the greatest of these impacts, which is then scored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import stored

#: Documents and postings of a shard, whichever comes first; bounds a task's memory.
SHARD, POSTINGS = 8192, 2_000_000
#: Intervals of at most so many documents are scored whole, and so many are looked at together.
LEAF, TOGETHER = 48, 32
#: Characters of queries that are answered in one pass over the documents.
BLOCK = 4_000_000
#: One document in so many is searched first, for a floor to each query's scores.
FIRST = 16
#: Bytes tokenised at once, cut between terms.
STEP = 1 << 20
#: Terms are what this leaves: ASCII letters (A-Z lowered), digits, and all bytes of other characters.
_BREAK = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256)).lower()
_NONE = -(2**63)
_HITS = "doc_id long, n long, terms binary, counts binary"
_FOUND = "item long, doc_id long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time: runs of ASCII letters, digits and all non-ASCII characters,
    with A-Z lowered."""
    data = (text or "").encode().translate(_BREAK)
    at = 0
    while at < len(data):
        end = at + STEP
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _hits(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: their number, and which of the vocabulary occur how often."""

    def run(batches):
        for batch in batches:
            ids, ns, which, counts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                n, seen = 0, Counter()
                for words in terms(text.as_py()):
                    n += len(words)
                    seen.update(map(vocabulary.get, words))
                if not n:
                    continue
                seen.pop(None, None)
                ids.append(doc_id)
                ns.append(n)
                which.append(np.fromiter(seen.keys(), "<i4", len(seen)).tobytes())
                counts.append(np.fromiter(seen.values(), "<i8", len(seen)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(which, pa.binary()),
                 pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _HITS)


def _holding(hits: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            parts = b"".join(batch["terms"].to_pylist())
            total += np.bincount(np.frombuffer(parts, "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"]
        )

    per = hits.select("terms").mapInArrow(run, "term long, df long")
    df = np.zeros(size, np.int64)
    for term, n in per.groupBy("term").agg(F.sum("df")).collect():  # no more than the queries' terms
        df[term] = n
    return df


class Shard:
    """Posting lists of some documents, each with a sparse table of where its greatest impacts are."""

    def __init__(self, ids, ns, which, counts, sizes, weights, n_docs: int, length: int):
        order = np.argsort(ids, kind="stable")  # equal scores go by id, so lower places come first
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        doc = np.repeat(place, sizes)
        m = 75 + (25 * np.repeat(ns, sizes) * n_docs) // length
        impact = weights[which] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))
        by = np.lexsort((doc, which))
        self.doc, self.impact = doc[by], impact[by]
        self.base = len(ids) + 1
        self.key = which[by].astype(np.int64) * self.base + self.doc
        self.begin = np.searchsorted(self.key, np.arange(len(weights) + 1) * self.base)
        longest = int(np.diff(self.begin).max(initial=1))
        self.table = np.zeros((max(1, longest.bit_length()), len(by)), np.int32)
        self.table[0] = np.arange(len(by))
        for j in range(1, len(self.table)):
            h = 1 << (j - 1)
            a = self.table[j - 1, : max(0, len(by) - 2 * h + 1)]
            b = self.table[j - 1, h : h + len(a)]
            self.table[j, : len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the greatest impact of each range of postings is, and its value; 0 if it is empty."""
        size = high - low
        some = size > 0
        j = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        last = max(0, len(self.doc) - 1)
        a = self.table[j, np.minimum(low, last)]
        b = self.table[j, np.clip(high - (1 << j), 0, last)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return at, np.where(some, self.impact[at], 0)

    def search(self, which: np.ndarray, times: np.ndarray, k: int, best: Best) -> None:
        """Add to ``best`` what this shard has for a query of terms ``which``, each so many times."""
        which, times = which[(some := self.begin[which] < self.begin[which + 1])], times[some]
        if not len(which):
            return
        offset = which * self.base
        low, high = self.begin[which][None, :], self.begin[which + 1][None, :]
        at, top = self.greatest(low, high)
        tops = top * times
        bound = int(tops.sum())
        state = {0: (low[0], high[0], int(self.doc[at[0, tops[0].argmax()]]))}
        queue, made = [(-bound, 0, len(self.ids), 0)], 1
        while queue:
            small, large = [], []
            while queue and len(small) + len(large) < TOGETHER:
                if not best.open(-queue[0][0], self.ids[queue[0][1]]):
                    # Bounds only fall from here; of equal bounds the lowest place comes first.
                    queue = []
                    break
                _, lo, hi, name = heapq.heappop(queue)
                (small if hi - lo <= LEAF else large).append((lo, hi, *state.pop(name)))
            if small:
                self._score(small, times, best)
            if not large:
                continue
            lows, highs = np.array([x[2] for x in large]), np.array([x[3] for x in large])
            split = np.array([x[4] for x in large])
            p = np.searchsorted(self.key, offset + split[:, None])
            here = np.minimum(p, len(self.key) - 1)
            held = (p < highs) & (self.key[here] == offset + split[:, None])
            best.add((np.where(held, self.impact[here], 0) * times).sum(axis=1), self.ids[split])
            lows, highs = np.concatenate((p + held, lows)), np.concatenate((highs, p))
            at, top = self.greatest(lows, highs)
            tops = top * times
            bounds = tops.sum(axis=1)
            cut_at = self.doc[at[np.arange(len(at)), tops.argmax(axis=1)]]
            ends = [(int(s) + 1, x[1]) for x, s in zip(large, split, strict=True)]
            ends += [(x[0], int(s)) for x, s in zip(large, split, strict=True)]
            for i, (lo, hi) in enumerate(ends):
                if bounds[i] > 0 and hi > lo and best.open(int(bounds[i]), self.ids[lo]):
                    state[made] = (lows[i], highs[i], int(cut_at[i]))
                    heapq.heappush(queue, (-int(bounds[i]), lo, hi, made))
                    made += 1

    def _score(self, intervals: list, times: np.ndarray, best: Best) -> None:
        """Score every document of short intervals from the postings inside them."""
        lo = np.array([x[0] for x in intervals])
        width = np.array([x[1] for x in intervals]) - lo
        first = np.cumsum(width) - width
        lows = np.concatenate([x[2] for x in intervals])
        sizes = np.concatenate([x[3] for x in intervals]) - lows
        at = np.repeat(lows - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        shift = np.repeat(np.repeat(first - lo, len(times)), sizes)
        score = np.zeros(width.sum(), np.int64)
        np.add.at(score, self.doc[at] + shift, self.impact[at] * np.repeat(np.tile(times, len(lo)), sizes))
        hit = np.flatnonzero(score)
        best.add(score[hit], self.ids[(np.repeat(lo - first, width) + np.arange(len(score)))[hit]])


class Best:
    """The k best (score, id) so far, equal scores by id; nothing below ``floor`` is wanted."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, floor)
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def open(self, bound: int, first_id: int) -> bool:
        """Whether documents of ids from ``first_id`` on, of at most this score, may still get in."""
        if bound < self.floor:
            return False
        if len(self.score) < self.k or bound > self.score[-1]:
            return True
        return bound == self.score[-1] and first_id <= self.ids[-1]

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        least = self.floor if len(self.score) < self.k else max(self.floor, int(self.score[-1]))
        if not (good := score >= least).any():
            return
        score, ids = np.concatenate((self.score, score[good])), np.concatenate((self.ids, ids[good]))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def _search(hits: DataFrame, asked: list, weights, n_docs: int, length: int, floors: list[int], k: int):
    """Each task's best documents of every query."""

    def shards(batches):
        held, rows, postings = [], 0, 0
        for batch in batches:
            # A batch may hold more than a shard.
            sizes = batch["bytes"].to_numpy() // 4
            at = 0
            while at < len(sizes):
                fits = np.searchsorted(np.cumsum(sizes[at:]), POSTINGS - postings, "right")
                end = min(len(sizes), at + SHARD - rows, at + max(int(fits), int(not rows)))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    rows, postings = rows + end - at, postings + int(sizes[at:end].sum())
                    at = end
                if at < len(sizes):
                    yield held
                    held, rows, postings = [], 0, 0
        if held:
            yield held

    def run(batches):
        best = [Best(k, floor) for floor in floors]
        for held in shards(batches):
            table = pa.Table.from_batches(held)
            which = np.frombuffer(b"".join(table["terms"].to_pylist()), "<i4").astype(np.int64)
            counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<i8")
            if not len(which):
                continue
            shard = Shard(
                table["doc_id"].fill_null(_NONE).to_numpy(), table["n"].to_numpy(), which, counts,
                table["bytes"].to_numpy() // 4, weights, n_docs, length,
            )
            for mine, (which, times) in zip(best, asked, strict=True):
                shard.search(which, times, k, mine)
        items = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(ids, mask=ids == _NONE),
             pa.array(np.concatenate([np.zeros(0, np.int64), *(b.score for b in best)]))],
            ["item", "doc_id", "score"])

    sized = hits.withColumn("bytes", F.octet_length("terms").cast("long"))
    found = sized.mapInArrow(run, _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every row of ``items``.

    ``documents(doc_id, text)``, ``items(item_id, text)``; other columns don't count. Terms, weights and
    scores are those of the contract of op11. A null or empty text holds no term: such an item has no
    rows, such a document isn't counted. Equal scores go by doc_id, null first. Rows that repeat an id
    are documents, or items, each of their own.

    Items are answered in blocks of BLOCK characters, a pass over the documents each; a block's items and
    the counts of their terms pass through the driver. Documents are never shuffled: tasks return k rows
    an item at most, and a first search over a part of them gives the least score worth returning.
    """
    spark = documents.sparkSession
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    parts = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("_b"))
    answers = None
    for block in range(blocks):
        found = _ranked(documents, parts.where(F.col("_b") == block).select("item_id", "text").collect(), k)
        if found is not None:
            answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return answers


def _ranked(documents: DataFrame, items: list, k: int) -> DataFrame | None:
    spark, vocabulary, asked = documents.sparkSession, {}, []
    for item in items:
        seen = Counter()
        for words in terms(item["text"]):
            seen.update(words)
        which = [vocabulary.setdefault(w, len(vocabulary)) for w in seen]
        asked.append((np.array(which, np.int64), np.array([*seen.values()], np.int64)))
    if not vocabulary:
        return None
    hits = stored(_hits(documents, vocabulary), "hits")
    n_docs, length = hits.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = _holding(hits, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    some = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0
    first = _search(hits.where(some), asked, weights, n_docs, length, [0] * len(asked), k)
    least = first.groupBy("item").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("low"))
    floors = dict(least.where(F.col("m") >= k).select("item", "low").collect())  # a row an item at most
    found = _search(
        hits, asked, weights, n_docs, length, [floors.get(i, 0) for i in range(len(asked))], k
    )
    names = spark.createDataFrame(
        [(i, item["item_id"]) for i, item in enumerate(items)], "item long, item_id long"
    )
    # The names are a block's items, which the driver holds.
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
