"""Language identification by cross-parsing.

For each language a suffix automaton of sampled text of that language tells how far a text can be
followed before it leaves the sample. Cutting a text greedily into such longest matches, the
language that needs the fewest phrases, each weighed by the bits that name a place in its sample,
wins: that number over the length is the cross-parsing estimate of entropy.

Texts are lower-cased, and every run of characters that are no letters counts as one space. They are
read in windows of ``WINDOW`` symbols, all windows of a slice in step, one symbol at a time; a
phrase that a window's end cuts counts as ended, for all languages alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import fold
from earshot.llm.pieces import slices

#: Sampled rows per language, on average, and code points taken of each, from a place that a
#: hash picks in the whole text.
ROWS, PIECE = 250, 300
WINDOW, SLICE = 256, 4_000_000
#: How strongly a bit of difference per symbol speaks in ``score``.
SHARPNESS = 4.0


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class SuffixAutomaton:
    """Which strings occur in a sequence of symbols, as a table of transitions."""

    def __init__(self, symbols: list[int], width: int):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in moves[p]:
                moves[p][s] = new
                p = link[p]
            if p >= 0:
                q = moves[p][s]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(s) == q:
                        moves[p][s] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        # The start has no way back to it, so 0 can stand for "no transition".
        self.table = np.zeros((len(moves), width), np.int32)
        for state, row in enumerate(moves):
            for s, to in row.items():
                self.table[state, s] = to
        self.table = self.table.ravel()
        self.width = width


class CrossParser:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        seen = sorted({c for texts in samples.values() for t in texts for c in t.lower()})
        letters = [c for c in seen if c.isalpha()]
        #: 0 is a space, then letters of the samples, then any other letter, then the joint.
        self.symbol = np.zeros(0x110000, np.int16)
        self.symbol[_letters()] = len(letters) + 1
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = i + 1
        self.width = len(letters) + 3
        self.automata, self.bits = [], []
        for name in self.names:
            joined: list[int] = []
            for text in samples[name]:
                joined += [*self.symbols([text])[0].tolist(), self.width - 1]
            self.automata.append(SuffixAutomaton(joined, self.width))
            self.bits.append(np.log2(len(joined) + 2))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' symbols in a row, the number of each text's, and which texts have letters."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in low], np.int64)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        out = self.symbol[codes]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] > 0) | (out[:-1] > 0) | (owner[1:] != owner[:-1])
        some = np.bincount(owner[out > 0], minlength=len(low)) > 0
        return out[keep], np.bincount(owner[keep], minlength=len(low)), some

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases that each text needs, by language: an array of languages by texts."""
        start = np.cumsum(np.r_[0, sizes[:-1]])
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
        order = np.argsort(-length, kind="stable")
        owner, length, at = owner[order], length[order], (start[owner] + nth * WINDOW)[order]
        longest = int(length[0]) if len(length) else 0
        active = [int(np.searchsorted(-length, -t, "left")) for t in range(longest)]
        columns = [symbols[at[:k] + t].astype(np.int32) for t, k in enumerate(active)]
        out = np.zeros((len(self.names), len(sizes)))
        for i, automaton in enumerate(self.automata):
            table, width = automaton.table, automaton.width
            state = np.zeros(len(owner), np.int32)
            count = np.ones(len(owner), np.int32)
            for k, s in zip(active, columns, strict=True):
                to = table[state[:k] * width + s]
                ended = to == 0
                count[:k] += ended
                state[:k] = np.where(ended, table[s], to)
            out[i] = np.bincount(owner, count, len(sizes))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        symbols, sizes, some = self.symbols(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        rate = self.phrases(symbols, sizes) * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = rate.argmin(0)  # the first name among equals
        odds = np.exp(-SHARPNESS * (rate - rate.min(0)))
        score = np.where(some, 1 / odds.sum(0), 0.0)
        return [self.names[b] if s else "und" for b, s in zip(best, some)], score


def language_samples(
    docs: DataFrame, rows: int = ROWS, piece: int = PIECE, folds: int = 5, held_out: int = 0
) -> dict[str, list[str]]:
    """Pieces of labelled text per language, from rows whose fold is not ``held_out``.

    At most about ``rows`` times ``piece`` code points of each language reach the driver.
    """
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    known = known.where(fold("doc_id", folds) != held_out)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # One row per language, as many as there are labels.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(F.broadcast(counts), "lang").where(draw < rows / F.col("n"))
    pieces = F.greatest(F.lit(1), F.ceil(F.char_length("text") / piece))
    at = F.pmod(F.xxhash64("doc_id", F.lit(2)), pieces) * piece + 1
    taken = picked.select("lang", "doc_id", F.substring("text", at.cast("int"), F.lit(piece)).alias("t"))
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(taken.collect(), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
        out.setdefault(lang, []).append(text)
    return out


_PARSERS: dict[str, CrossParser] = {}


def identify(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text.

    A null text, and one without a letter, is ``und`` with score 0. Ties go to the first language
    by name. ``score`` is the winner's share when phrases per symbol are weighed exponentially.
    Without samples everything is ``und``. Repeated rows are scored each; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded per language
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _PARSERS.get(key)
        for batch in batches:
            if parser is None:
                _PARSERS.clear()
                parser = _PARSERS[key] = CrossParser(shared.value)
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE):
                names, score = parser.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
