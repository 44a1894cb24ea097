"""Content vectors from lyrics: an encoder, and adding only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.catalogue import MIN_CHARS, gate_text, with_lyrics
from earshot.operators.merge import missing_vectors
from earshot.schemas import CONTENT_DIM
from earshot.session import cut, small_batches, spread


class Encoder(Protocol):
    """Turns ``(id, text)`` into ``(id, embedding)``; reads at most ``max_chars``.

    ``texts`` are the rows to encode, all of them also in ``corpus``.
    """

    max_chars: int | None

    def encode(self, texts: DataFrame, corpus: DataFrame) -> DataFrame: ...


#: Characters of a word, about; it says how many tasks count them.
WORD_CHARS = 6


def word_buckets(texts: DataFrame, dim: int) -> DataFrame:
    """``(id, bucket, n)``: how many words of each text fall in each of ``dim`` md5 buckets.

    Texts are partitioned by id before they are split, so that a task counts a bounded number of words
    and what follows by id stays where it is.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = spread(texts.select("id", "text"), "id", rows=chars // WORD_CHARS)
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    each = texts.select("id", F.explode(F.filter(words, lambda w: w != "")).alias("word"))
    digest = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint")
    return each.groupBy("id", (digest % dim).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def fit_rarity(corpus: DataFrame, dim: int = CONTENT_DIM) -> DataFrame:
    """``(bucket, rarity)`` for all buckets: ln((texts + 1) / (texts with the bucket + 1)).

    Publish it and give it to the encoder, so that vectors made later are comparable.
    """
    return _rarity(word_buckets(corpus.select("id", "text"), dim), corpus.count(), dim)


def _rarity(counted: DataFrame, n_texts: int, dim: int) -> DataFrame:
    held = counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    buckets = counted.sparkSession.range(dim).select(F.col("id").cast("int").alias("bucket"))
    share = F.lit(n_texts + 1) / (F.coalesce("held", F.lit(0)) + 1)
    return buckets.join(held, "bucket", "left").select("bucket", F.log(share).alias("rarity"))


def unit_vectors(dim: int):
    """Lists of buckets and weights to dense vectors of length one, a batch at a time."""

    @F.pandas_udf("array<float>")
    def make(buckets: pd.Series, weights: pd.Series) -> pd.Series:
        out = np.zeros((len(buckets), dim))
        for row, (at, x) in enumerate(zip(buckets, weights)):
            if at is not None and len(at):
                out[row, np.asarray(at, int)] = x
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list((out / np.where(length > 0, length, 1)).astype(np.float32)))

    return make


@dataclass(frozen=True)
class HashingEncoder:
    """Hashed word counts, weighted by rarity and scaled to length one; reads whole texts.

    Without a stored ``rarity(bucket, rarity)`` it is fitted on the corpus, which reads all of it.
    """

    dim: int = CONTENT_DIM
    rarity: DataFrame | None = None
    max_chars: int | None = None

    def encode(self, texts: DataFrame, corpus: DataFrame) -> DataFrame:
        rarity = self.rarity
        if rarity is None:
            # Fitting and weighing read the same counts.
            counted = cut(word_buckets(corpus, self.dim))
            rarity = cut(_rarity(counted, corpus.count(), self.dim))
            counted = counted.join(texts.select("id"), "id", "left_semi")
        else:
            counted = word_buckets(texts, self.dim)
        # ``dim`` rows.
        weighed = counted.join(F.broadcast(rarity), "bucket")
        entry = F.collect_list(F.struct("bucket", (F.col("n") * F.col("rarity")).alias("x")))
        held = weighed.groupBy("id").agg(entry.alias("_x"))  # at most ``dim`` entries
        held = texts.select("id").join(held, "id", "left")
        vector = unit_vectors(self.dim)(F.col("_x.bucket"), F.col("_x.x"))
        return held.select("id", vector.alias("embedding"))


@dataclass(frozen=True)
class BatchEncoder:
    """A model applied to batches of ``(id, text)`` inside tasks.

    ``make`` runs once per task and returns a function from a batch's texts to their
    vectors, so the model is loaded once, not per row. A model that reads ``window`` characters at
    most gets longer texts in windows of that length; their vectors are averaged.
    """

    make: Callable[[], Callable[[list[str]], list]]
    window: int | None = None
    max_chars: int | None = None

    def encode(self, texts: DataFrame, corpus: DataFrame) -> DataFrame:
        make, window = self.make, self.window

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for batch in batches:
                if not len(batch):
                    continue
                parts = [
                    [t[i : i + window] for i in range(0, max(len(t), 1), window)]
                    if window else [t]
                    for t in batch["text"]
                ]
                made = iter(model([p for ps in parts for p in ps]))
                vectors = [
                    np.mean([np.asarray(next(made), float) for _ in ps], axis=0).tolist() for ps in parts
                ]
                yield pd.DataFrame({"id": batch["id"], "embedding": vectors})

        return texts.mapInPandas(run, "id string, embedding array<float>")


def embed_text(
    songs: DataFrame,
    existing: DataFrame,
    encoder: Encoder = HashingEncoder(),
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Vectors of the songs with enough lyrics that have none yet."""
    small_batches(songs.sparkSession)
    lyrics = with_lyrics(songs).select("_id", F.col("lrclib_plain_lyrics").alias("text"))
    gated = gate_text(lyrics, "text", min_chars, encoder.max_chars)
    todo = missing_vectors(gated, existing)
    return encoder.encode(
        todo.select(F.col("_id").alias("id"), "text"),
        gated.select(F.col("_id").alias("id"), "text"),
    )
