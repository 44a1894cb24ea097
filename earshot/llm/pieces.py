"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, best score first and
leftmost among equals. The top pair merges; its neighbours' new pairs join the agenda. Symbols
that end as no piece become their bytes.

No piece holds a space mark after another character (checked when a vocabulary is read), so
merges never cross the place where a space follows a word. Each word with the spaces before
it is therefore encoded by itself, and once per worker while it stays in the worker's table.
Short words advance their agendas in step, as numpy arrays; long ones use a heap. New words of
a batch are checked against the sentencepiece library, which also decodes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words of more characters use the heap.
SHORT = 48
#: Bytes of a worker's table of short words; beyond, it starts anew. Words encoded in step at once.
TABLE, AT_ONCE = 64 << 20, 50_000
#: Bytes that a table entry takes besides its characters and ids.
ENTRY = 180
#: Characters of text encoded at once.
SLICE = 1_000_000
_NONE = np.int64(1) << np.int64(40)
_WORD = re.compile(" *[^ ]+| +")


class PieceEncoder:
    """Encodes words by one vocabulary."""

    def __init__(self, model: bytes):
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        usual = [
            i for i in ids
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
        ]
        if any(library.is_unused(i) for i in usual):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.piece = {library.id_to_piece(i): i for i in usual}
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes_of = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = library.unk_id()
        self.has_bytes = library.is_byte(self.bytes_of[0])
        self.symbol = dict(self.piece)
        for piece in self.piece:
            for char in piece:
                self.symbol.setdefault(char, len(ids) + len(self.symbol))
        # Words keep their spaces as such, which is smaller; a mark in a text is the same as a space.
        self.symbol[" "] = self.symbol.get(MARK, len(ids) + len(self.symbol))
        rank = {s: r for r, s in enumerate(sorted({-library.get_score(i) for i in usual}))}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, i in self.piece.items():
            for k in range(1, len(piece)):
                left, right = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if left is not None and right is not None:
                    self.merges[left, right] = rank[-library.get_score(i)], i
        self.width = len(ids) + len(self.symbol) + 2
        pairs = sorted((a * self.width + b, r, i) for (a, b), (r, i) in self.merges.items())
        self.pairs = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.ranks = np.array([p[1] for p in pairs] or [0], np.int64)
        self.made = np.array([p[2] for p in pairs] or [0], np.int64)
        self.pieces = len(ids)
        self.table: dict[str, bytes] = {}
        self.held = 0

    def _spell(self, symbols: list[int], chars: list[str]) -> bytes:
        """Ids of the final symbols; ``chars`` has the character of each that is no piece."""
        out: list[int] = []
        for s, char in zip(symbols, chars, strict=True):
            if s < self.pieces:
                out.append(s)
            elif self.has_bytes:
                out += [self.bytes_of[b] for b in char.replace(" ", MARK).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _symbols(self, word: str) -> list[int]:
        none = self.width - 1
        return [self.symbol.get(c, none) for c in word]

    def by_heap(self, word: str) -> bytes:
        """One word by a heap of (rank, place) and links to the neighbours."""
        sym, chars, n = self._symbols(word), list(word), len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        agenda = [
            (m[0], i, i + 1, sym[i], sym[i + 1], m[1])
            for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))
        ]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, a, b, made = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, sym[k])):
                    heapq.heappush(agenda, (m[0], i, k, made, sym[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((sym[h], made))):
                heapq.heappush(agenda, (m[0], h, i, sym[h], made, m[1]))
        left = [i for i in range(n) if sym[i] >= 0]
        return self._spell([sym[i] for i in left], [chars[i] for i in left])

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the piece of each pair; a huge rank where it forms none."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[at] == pair
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def in_step(self, words: list[str]) -> list[bytes]:
        """Many short words at once: each round pops the top of every word's agenda."""
        sizes = np.array([len(w) for w in words], np.int64)
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, back = np.unique(codes, return_inverse=True)
        sym = np.array(self._symbols("".join(map(chr, kinds))), np.int64)[back]
        word, char = np.repeat(np.arange(len(words)), sizes), np.arange(len(codes))
        out: list[bytes] = [b""] * len(words)
        rank = np.full(len(sym), _NONE)
        made = np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self._look(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            n = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            ended = best == _NONE
            if ended.any():
                over = np.repeat(ended, n)
                self._take(out, word[over], sym[over], char[over], text)
                keep = ~over
                sym, word, char, rank, made = (x[keep] for x in (sym, word, char, rank, made))
                continue
            top = np.flatnonzero(rank == np.repeat(best, n))
            top = top[np.r_[True, word[top][1:] != word[top][:-1]]]  # the leftmost
            sym[top] = made[top]
            keep = np.ones(len(sym), bool)
            keep[top + 1] = False
            at = np.cumsum(keep)[top] - 1
            sym, word, char, rank, made = (x[keep] for x in (sym, word, char, rank, made))
            new = np.r_[at, at[at > 0] - 1]
            new = new[(word[new] == word[np.minimum(new + 1, len(sym) - 1)]) & (new + 1 < len(sym))]
            rank[at] = _NONE
            rank[new], made[new] = self._look(sym[new], sym[new + 1])
        return out

    def _take(self, out, word, sym, char, text) -> None:
        """Put the ids of finished words in their places."""
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        packed, odd = sym.astype("<u4").tobytes(), sym >= self.pieces
        any_odd = np.logical_or.reduceat(odd, first)
        for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(sym)])):
            if any_odd[k]:
                out[word[a]] = self._spell(sym[a:b].tolist(), [text[c] for c in char[a:b]])
            else:
                out[word[a]] = packed[4 * a : 4 * b]

    def learn(self, words: set[str], check: bool) -> list[str]:
        """Encode words that the table lacks, and compare them with the library's.

        Returns the long ones: they may be of any size, so the caller takes them out again.
        """
        if self.held > TABLE:
            self.table.clear()
            self.held = 0
        fresh = [w for w in words if w not in self.table]
        for i in range(0, len(fresh), AT_ONCE):
            part = fresh[i : i + AT_ONCE]
            short = [w for w in part if len(w) <= SHORT]
            got = dict(zip(short, self.in_step(short), strict=True)) if short else {}
            got |= {w: self.by_heap(w) for w in part if len(w) > SHORT}
            if check:
                self._compare(got)
            self.table.update(got)
            self.held += sum(ENTRY + len(w) + len(got[w]) for w in short)
        return [w for w in fresh if len(w) > SHORT]

    def _compare(self, got: dict[str, bytes]) -> None:
        """The library puts a space mark first itself, so words go to it without their first."""
        words = [w for w in got if len(w) > 1]
        theirs = self.library.encode([w[1:] for w in words], num_threads=1)
        flat = np.fromiter(chain.from_iterable(theirs), "<u4").tobytes()
        sizes = [4 * len(ids) for ids in theirs]
        if flat == b"".join(got[w] for w in words) and sizes == [len(got[w]) for w in words]:
            return
        for w, ids in zip(words, theirs, strict=True):
            if np.array(ids, "<u4").tobytes() != got[w]:
                raise ValueError(f"the library encodes {w!r} as {ids}")

    def encode(self, texts: list[str], check: bool = True) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers, begin and end ids included."""
        begin = np.array([self.library.bos_id()], "<u4").tobytes()
        end = np.array([self.library.eos_id()], "<u4").tobytes()
        out: list[bytes] = []
        for a, b in slices([len(t) for t in texts], SLICE):
            cut = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts[a:b]]
            words = set().union(*cut)
            long = self.learn(words, check)
            find = self.table.__getitem__
            out += [b"".join((begin, *map(find, ws), end)) for ws in cut]
            for w in long:
                del self.table[w]
        return out


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes together stay near ``most``."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(model: bytes) -> PieceEncoder:
    """This worker's encoder of a vocabulary."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(model)
    return _ENCODERS[key]


def encode_decode(
    docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), packed: bool = False,
    check: bool = True,
) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded`` of every text of ``docs``.

    ``ids`` has the begin and end ids and is an array of integers, or with ``packed`` one binary
    of little-endian 32-bit integers. A null text is empty: begin and end ids, decoded to
    an empty text. With ``check`` every new word's ids are compared with the library's and
    a difference fails the job. Columns other than ``keep`` are dropped, those of it named
    ``ids`` or ``decoded`` too; an empty table gives an empty one.
    """
    with open(model_path, "rb") as file:  # on the driver: executors get its bytes
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    keep = tuple(c for c in keep if c not in ("ids", "decoded"))
    kind = "binary" if packed else "array<int>"
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        f"ids {kind}", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            sizes = pa.compute.utf8_length(batch["__text"]).to_pylist()
            for a, b in slices(sizes, SLICE):
                part = batch.slice(a, b - a)
                ids = enc.encode(part["__text"].to_pylist(), check)
                decoded = [enc.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                if packed:
                    column = pa.array(ids, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                kept = [part[c] for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, column, pa.array(decoded, pa.string())], [*keep, "ids", "decoded"]
                )

    return rows.mapInArrow(run, schema)
