"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax.

Features of a text are its words, its pairs of neighbouring words and its runs of three and of
four bytes (letter case kept), each hashed to one of ``BUCKETS`` vectors. A word followed by
itself is one feature whatever the word, so that repetition can be learned. The document's vector
is the mean of the three kinds' means; two softmax outputs follow. Vectors and outputs are
learned together by stochastic gradient descent in numpy, in one task, on a sample of labelled
rows whose expected size is bounded; scoring is per row of the table, wherever it lies.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import fold
from earshot.llm.words import mix, utf8, word_hashes, word_places

BUCKETS, WIDTH = 1 << 16, 8
#: Labelled rows that training takes, on average; a hash of the id picks them.
SAMPLE = 4_000
EPOCHS, RATE, SEED = 6, 8.0, 7
#: Bytes of text turned into features at once; a longer text is taken in windows of it.
STEP = 1 << 20
_SAME = np.uint64(0x5851F42D4C957F2D)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(48)).astype(np.int64)


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: the buckets of all features, and the text that each is of."""
    runs = []
    wide = data.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16 if len(data) > 2 else wide[:0]
    for n in (3, 4):
        k = len(data) - n + 1
        if k <= 0:
            continue
        gram = code[:k].astype(np.uint64)
        if n == 4:
            gram |= wide[3:].astype(np.uint64) << np.uint64(24)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:k]
        inside = np.arange(k) + n <= at[1:][text]
        runs.append((_bucket(gram[inside] + np.uint64(n << 40)), text[inside]))
    chars = tuple(np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 2
    starts, ends, first = word_places(data, at)
    words = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    left, right = words[:-1], words[1:]
    pair = np.where(left == right, _SAME, mix(left + np.uint64(1)) + right)
    both = owner[:-1] == owner[1:]
    return [chars, (_bucket(words), owner), (_bucket(pair[both]), owner[:-1][both])]


def _windows(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes in stretches of about STEP: bytes, the places in them, the text of each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, "right")) - 1)
        if at[j] - at[i] <= STEP:
            yield data[at[i] : at[j]], at[i : j + 1] - at[i], np.arange(i, j)
        else:
            for a in range(int(at[i]), int(at[j]), STEP):
                part = data[a : min(a + STEP, at[j])]
                yield part, np.array([0, len(part)]), np.array([i])
        i = j


def logits(data: np.ndarray, at: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """The log odds of label 1 for each text; ``weight`` has each bucket's share in it."""
    sums, counts = np.zeros((3, len(at) - 1)), np.zeros((3, len(at) - 1))
    for part, places, texts in _windows(data, at):
        for kind, (bucket, owner) in enumerate(features(part, places)):
            sums[kind, texts] += np.bincount(owner, weight[bucket], len(texts))
            counts[kind, texts] += np.bincount(owner, minlength=len(texts))
    return (sums / np.maximum(counts, 1)).sum(0) / 3 + bias


def fit(column: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the buckets, the output weights and the output biases."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, 2)), np.zeros(2)
    rows = []
    for i in range(len(column)):
        counts = np.zeros((3, BUCKETS))
        for part, places, _ in _windows(*utf8(column[i : i + 1])):
            for kind, (bucket, _) in enumerate(features(part, places)):
                counts[kind] += np.bincount(bucket, minlength=BUCKETS)
        total = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).sum(0) / 3
        used = np.flatnonzero(total)
        # 16 bits tell the buckets apart, which keeps the whole sample small.
        rows.append((used.astype(np.uint16), total[used].astype(np.float32)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            used, share = rows[i][0].astype(np.int64), rows[i][1].astype(np.float64)
            vector = share @ vectors[used]
            z = vector @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            norm = max(float(share @ share), 1e-4)  # many small shares move as far as a few large
            out -= 0.05 * rate * np.outer(vector, p)
            bias -= 0.02 * rate * p
            vectors[used] -= min(rate, 0.5 / norm) * share[:, None] * back
    return vectors, out, bias


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
    folds: int = 5, held_out: int = 0,
) -> tuple[np.ndarray, float]:
    """Learn from labelled texts whose fold is not ``held_out``: bucket weights and a bias.

    Rows without an id, text or label 0 or 1 are passed over; a repeated label row counts once.
    Without any rows every text gets even odds.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & (fold("doc_id", folds) != held_out))
    known = known.where("doc_id IS NOT NULL").distinct()
    share = min(1.0, sample / max(1, known.count()))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    # About ``sample`` rows of two numbers.
    picked = F.broadcast(known.where(drawn))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got or not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got).sort_by(
            [("doc_id", "ascending"), ("_label", "ascending"), ("text", "ascending")]
        )
        model = fit(table["text"].combine_chunks(), table["_label"].to_numpy())
        file = io.BytesIO()
        np.savez(file, *(x.astype(np.float32) for x in model))
        yield pa.RecordBatch.from_pydict({"model": [file.getvalue()]})

    got = rows.repartition(1).mapInArrow(learn, "model binary").first()
    if got is None:
        return np.zeros(BUCKETS), 0.0
    vectors, out, bias = np.load(io.BytesIO(got[0])).values()
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text; null counts as empty.

    The text may be empty or very long; an input column named ``out`` gives way.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        f"`{out}` double"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = weights.value
        for batch in batches:
            data, at = utf8(batch["text"])
            odds = np.clip(logits(data, at, weight, bias), -40, 40)
            column = pa.array(1 / (1 + np.exp(-odds)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), column], [*names, out])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def drop_poor(
    docs: DataFrame, labels: DataFrame, least: float = 0.3, label: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``; all columns stay."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    rated = score(docs, train(docs, labels, label), name)
    return rated.where(F.col(name) >= least).drop(name)
