"""Language-model scores by prediction by partial matching, with a word-count base.

The model is a trie of byte contexts. A text is preceded by start marks and followed by an end mark,
which are no UTF-8 bytes. In a context with total T and D distinct symbols, a symbol seen c times
has probability (2c - 1) / 2T; the rest, D / 2T, escapes to the next shorter context, where symbols
seen in the longer one are excluded. Below the empty context all unseen bytes are alike.

Two parts of the trie meet in a text. Contexts of up to two bytes, and those of three to ``ORDER``
that hold at least 1 in ``CONTEXTS`` of the training bytes, go to every task as tables of code
lengths. All other contexts, however rare, stay in a Spark table, and serve inside words: a word and
the byte that ends it are cut into units of ``UNIT`` bytes, and at place i of a unit, unless a
frequent context reaches back beyond the unit, the longest context known in training of at most i
bytes predicts the byte. Which context predicts depends on the bytes before it alone, so the
probabilities of all symbols sum to one. What the rare contexts add to a unit's code length is worked
out once for each distinct unit of the corpus, so that texts are joined with units, not with
contexts. Trie and units grow with the corpus.

With ``across`` nothing of this is cut: wherever a frequent context has fewer than ``ORDER`` bytes and
the unit holds no more before the place, the run of ``ORDER`` + 1 bytes that ends there is looked up, like
a unit, for its exact code length. Runs of all texts have one, worked out once each with the
whole trie. Then every byte is predicted by the longest context known in training.

The base score needs the corpus count of every word. Units that make up at least 1 in ``CACHE`` of
all, at most that many, go to the tasks in a table with their words' counts; a document's other
units are joined with the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import discard, fold, shared_folder, short_shuffles, stored
from earshot.llm.pieces import slices
from earshot.llm.words import mix, utf8, word_hashes, word_places
from earshot.session import cut

START, END = 0xFE, 0xFF
ORDER, CONTEXTS = 5, 1 << 17
CACHE, SLOTS = 1_000_000, 1 << 20
#: Bytes of text taken at once, and such slices whose counts are added up before they leave the task.
SLICE, TOGETHER = 1 << 20, 16
#: Bytes of a unit; rows that a group of contexts holds on average.
UNIT, BUCKET = 16, 1 << 19
#: A byte that no text holds, where a unit has nothing before it.
NOTHING = 0xFD
WORD, GRAM, TEXT, LONG, PIECE = 0, 1, 2, 3, 4
#: Slots of the table of frequent units and runs; what tells a run's key from a unit's.
CACHED, RUN = 1 << 21, np.uint64(1 << 62)


def _marked(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ORDER`` start marks, the text, an end mark, for each text; and where each begins."""
    n = len(at) - 1
    begin = at + (ORDER + 1) * np.arange(n + 1)
    out = np.full(begin[-1], START, np.uint8)
    out[begin[1:] - 1] = END
    inside = np.repeat(begin[:-1] + ORDER - at[:-1], np.diff(at)) + np.arange(len(data))
    out[inside] = data
    return out, begin


def _runs(marked: np.ndarray, size: int, upto: int) -> np.ndarray:
    """For each place from ``ORDER`` on, the ``size`` bytes that end ``upto`` places before it."""
    n = len(marked) - ORDER
    out = np.zeros(n, np.uint64)
    for k in range(size):
        first = ORDER - upto - size + 1 + k
        out = out << np.uint64(8) | marked[first : first + n]
    return out


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = utf8(column)
    for a, b in slices(np.diff(at).tolist(), SLICE):
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]


def _tally(keys: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Distinct keys with what belongs to them, and how often each occurs."""
    order = np.argsort(keys) if others else None
    keys = keys[order] if others else np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    n = np.diff(np.r_[first, len(keys)]).astype(np.uint32)  # a slice is small
    return [keys[first], *(x[order[first]] for x in others), n]


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Tallies as one, with 64-bit counts."""
    keys, *others, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    n = np.add.reduceat(n, first) if len(first) else n
    return [keys[first], *(x[order[first]] for x in others), n]


def _units(
    marked: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with the byte behind them, cut into units: word number, start, size, key, bytes as two numbers.

    A unit that is not full ends in white space or an end mark, so zeros behind it are no bytes of it.
    """
    parts = -(-sizes // UNIT)
    word = np.repeat(np.arange(len(sizes)), parts)
    offset = UNIT * (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts))
    begin, size = starts[word] + offset, np.minimum(UNIT, sizes[word] - offset)
    # Eight bytes from every place on, as one number each.
    padded = np.r_[marked, np.zeros(UNIT, np.uint8)]
    eight = np.ndarray(len(marked) + 8, ">u8", padded, strides=(1,))
    spare = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    first = eight[begin].astype(np.uint64) >> spare << spare
    second, able = np.zeros(len(word), np.uint64), np.flatnonzero(size > 8)
    spare = (8 * (UNIT - size[able])).astype(np.uint64)
    second[able] = eight[begin[able] + 8].astype(np.uint64) >> spare << spare
    return word, begin, size, mix(mix(first) + second), first, second


def _word_units(data: np.ndarray, at: np.ndarray, marked: np.ndarray, begin: np.ndarray) -> tuple:
    """Hash and text of every word, whether it is one unit, and the units of all."""
    starts, ends, first = word_places(data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    hashes = word_hashes(data, starts, ends)
    sizes = ends - starts + 1
    return hashes, owner, sizes <= UNIT, _units(marked, starts + (begin[:-1] + ORDER - at[:-1])[owner], sizes)


def _inside(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` places from ``ORDER`` on those that have ``ORDER`` bytes of their unit before them."""
    steps, most = np.zeros(n + 1, np.int8), size > ORDER
    steps[start[most]] += 1
    steps[(start + size)[most] - ORDER] -= 1
    return np.cumsum(steps[:-1]) > 0


def corpus_counts(rows: DataFrame, across: bool = False) -> DataFrame:
    """``(kind, key, more, n, asked)`` of ``rows(held_out, text)``.

    Of rows that are not held out: words by hash, those of more than one unit once more, runs of
    ``ORDER`` + 1 bytes, and the number of texts. Of all rows: units by their bytes. With
    ``across``, runs that some text holds outside its units are marked as ``asked``; those of
    the other rows are there too, counted as none.
    """

    def emptied(tallies: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for kind, parts in tallies.items():
            if parts:
                key, *others, n = _added(parts)
                key, more = others if others else (key, np.zeros(len(key), np.uint64))
                asked = np.zeros(len(key), np.uint64)
                if kind == GRAM:
                    key, asked = key >> np.uint64(1), key & np.uint64(1)
                if len(n):
                    yield _counted(kind, key, more, n, asked)
            parts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {kind: [] for kind in (WORD, GRAM, LONG, PIECE)}
        for batch in batches:
            for held in (False, True):
                part = batch.filter(pc.equal(batch["held_out"], held))
                for _, _, data, at in _batches(part["text"]):
                    marked, begin = _marked(data, at)
                    hashes, _, one, units = _word_units(data, at, marked, begin)
                    tallies[PIECE].append(_tally(*units[3:]))
                    if not held:
                        tallies[WORD].append(_tally(hashes))
                        tallies[LONG].append(_tally(hashes[~one]))
                    if across or not held:
                        gram = _runs(marked, ORDER + 1, 0)
                        asked = ~_inside(units[1], units[2], len(gram)) if across else np.zeros(len(gram), bool)
                        # Runs across two texts end in a start mark.
                        able = (gram & np.uint64(0xFF)) != START
                        able &= asked if held else True
                        gram, n = _tally(gram[able] << np.uint64(1) | asked[able])
                        tallies[GRAM].append([gram, np.zeros_like(n) if held else n])
                    if len(tallies[PIECE]) == TOGETHER:
                        yield from emptied(tallies)
                if not held:
                    zero = np.zeros(1, np.uint64)
                    yield _counted(TEXT, zero, zero, np.array([part.num_rows]), zero)
        yield from emptied(tallies)

    schema = "kind int, key bigint, more bigint, n bigint, asked boolean"
    # What a task emits is added up, and few of its keys occur again in it: they travel as they are.
    parts = rows.select("held_out", "text").mapInArrow(run, schema).repartition("kind", "key", "more")
    return parts.groupBy("kind", "key", "more").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))


def _counted(
    kind: int, keys: np.ndarray, more: np.ndarray, n: np.ndarray, asked: np.ndarray
) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
         pa.array(more.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(asked > 0)],
        ["kind", "key", "more", "n", "asked"],
    )


class ByteModel:
    """Code lengths, in decimal digits, of every symbol in every context of the trie.

    Only the counts are sent to the tasks; a worker makes the tables of them once.
    """

    #: The tables that this process made last, and of which model.
    _made: tuple[str, dict] = "", {}

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """``levels``: for 0 to ORDER bytes of context, sorted codes of context and symbol with counts."""
        self.name, self.levels = uuid.uuid4().hex, levels
        self._make()

    def _make(self) -> None:
        self.contexts = [np.unique(codes >> np.uint64(8)) for codes, _ in self.levels]
        if not len(self.contexts[0]):
            self.contexts[0] = np.zeros(1, np.uint64)
        sizes = [len(c) for c in self.contexts]
        # A column for each byte that training holds, and one for all others, which are alike everywhere.
        held = np.unique(self.levels[0][0] & np.uint64(0xFF)).astype(int)
        self.width = len(held) + 1
        self.column = np.full(256, len(held), np.int32)
        self.column[held] = np.arange(len(held))
        table, offset = np.empty((sum(sizes), self.width), np.float32), 0
        parent_counts = parent_below = None
        for k, ((codes, n), known) in enumerate(zip(self.levels, self.contexts, strict=True)):
            at = np.searchsorted(known, codes >> np.uint64(8))
            symbols = self.column[(codes & np.uint64(0xFF)).astype(int)]
            # The longest contexts are nobody's parents.
            counts, below = (np.zeros((len(known) if k < ORDER else 0, self.width), np.float32) for _ in range(2))
            if k:
                end = known & np.uint64((1 << 8 * (k - 1)) - 1)
                parent = np.searchsorted(self.contexts[k - 1], end)
            for a in range(0, len(known), 4_096):  # bounded temporary tables
                part = slice(a, a + 4_096)
                here = slice(*np.searchsorted(at, [a, a + 4_096]))
                held = np.zeros((len(known[part]), self.width), np.float32)
                held[at[here] - a, symbols[here]] = n[here]
                own = held.astype(np.float64)
                seen = own > 0
                if k == 0:
                    unseen = np.maximum(256 - seen.sum(1, keepdims=True), 1)
                    lower = np.repeat(1 / unseen, self.width, 1)
                else:
                    free = np.where(seen, 0, parent_counts[parent[part]])
                    lower = _chances(free, parent_below[parent[part]])
                if k < ORDER:
                    counts[part], below[part] = held, lower
                code = -np.log10(np.maximum(_chances(own, lower), 1e-30))
                table[offset + a : offset + a + len(own)] = code
            offset += len(known)
            parent_counts, parent_below = counts, below
            if k == 2:
                self.low = known, counts, below, self.column
        self.table = table.ravel()
        self.level_of = np.repeat(np.arange(ORDER + 1, dtype=np.uint8), sizes)
        self._found: tuple | None = None

    def __getstate__(self) -> dict:
        return {"name": self.name, "levels": self.levels}

    def __setstate__(self, state: dict) -> None:
        if ByteModel._made[0] != state["name"]:
            ByteModel._made = "", {}
            self.__dict__ = state
            self._make()
            self.levels = self.low = None
            ByteModel._made = self.name, self.__dict__
        self.__dict__ = ByteModel._made[1]

    def _finder(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For any three bytes the row of their longest known end; longer contexts by hash slots.

        Built where it is used. A slot that is taken passes a context on to the next one.
        """
        if self._found is None:
            rows = sum(len(c) for c in self.contexts[:4])
            short = np.zeros(1 << 24, np.uint16 if rows < 1 << 16 else np.int32)
            key_of, row_of = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
            offset = 1
            for k in range(1, ORDER + 1):
                known = self.contexts[k]
                rows = (np.arange(len(known)) + offset).astype(np.int32)
                offset += len(known)
                if k <= 3:
                    # One line per value of the bytes before the last k.
                    short.reshape(-1, 1 << 8 * k)[:, known.astype(int)] = rows
                    continue
                for key, slot, row in zip(*_slots(known, k), rows, strict=True):
                    while key_of[slot]:
                        slot = (slot + 1) % SLOTS
                    key_of[slot], row_of[slot] = key, row
            self._found = short, key_of, row_of
        return self._found

    def rows(self, marked: np.ndarray) -> np.ndarray:
        """The table row of the longest known context before each place from ORDER on."""
        return self.rows_of(_runs(marked, ORDER, 1))

    def rows_of(self, context: np.ndarray) -> np.ndarray:
        """The table row of the longest known end of each ``ORDER`` bytes."""
        short, key_of, row_of = self._finder()
        out = short[(context & np.uint64(0xFFFFFF)).astype(np.int32)].astype(np.int32)
        # A context is known only if its end is.
        able = np.flatnonzero(out >= sum(len(c) for c in self.contexts[:3]))
        for k in range(4, ORDER + 1):
            keys, slots = _slots(context[able] & np.uint64((1 << 8 * k) - 1), k)
            place, found = able, []
            while len(place):
                held = key_of[slots]
                hit = held == keys
                found.append(place[hit])
                out[found[-1]] = row_of[slots[hit]]
                left = np.flatnonzero(~hit & (held > 0))
                place, keys, slots = place[left], keys[left], (slots[left] + 1) % SLOTS
            able = np.concatenate(found) if found else able
        return out

    def costs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of the symbol at each place from ORDER on, and how long the context is."""
        rows = self.rows(marked)
        symbols = marked[ORDER:].astype(np.int32)
        cost = self.table[rows * self.width + self.column[symbols]].astype(np.float64)
        cost[symbols == START] = 0
        return cost, self.level_of[rows]


def _chances(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Symbol probabilities by escape method D; ``lower`` is for symbols without a count."""
    total = counts.sum(1, keepdims=True)
    distinct = (counts > 0).sum(1, keepdims=True)
    share = np.where(total > 0, distinct / np.maximum(2 * total, 1), 1)
    return np.where(counts > 0, (2 * counts - 1) / np.maximum(2 * total, 1), share * lower)


def _slots(contexts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of contexts of ``size`` bytes, and the hash slot where the search for each begins."""
    keys = contexts | np.uint64(size << 56)
    return keys, (mix(keys) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def byte_levels(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of symbols by context.

    To the driver come at most 2**24 numbers for contexts of up to two bytes, and those of at most
    CONTEXTS contexts for each longer size.
    """
    grams = counts.where((F.col("kind") == GRAM) & (F.col("n") > 0)).select("key", "n")
    whole = grams.agg(F.sum("n")).first()[0] or 0
    arrays = []
    for k in range(ORDER + 1):
        ends = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")
        if k > 2:
            # A context occurs no more often than its end, so each size takes up what the last one left.
            context = F.shiftright(ends, 8).alias("context")
            held = grams.groupBy(context).agg(F.sum("n").alias("held"))
            held = cut(held.where(F.col("held") * CONTEXTS >= whole).select("context"))
            grams = grams.select("key", "n", context).join(F.broadcast(held), "context").drop("context")
        table = grams.groupBy(ends).agg(F.sum("n").alias("n")).toArrow()
        keys = table["key"].to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        arrays.append((keys[order], table["n"].to_numpy()[order]))
    return arrays


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of units, a row each, and their sizes."""
    halves = np.stack([batch["key"].to_numpy(), batch["more"].to_numpy()], 1)
    data = halves.astype(">i8").view(np.uint8).reshape(-1, UNIT)
    last = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | (data == END)
    return data, np.where(last.any(1), last.argmax(1) + 1, UNIT)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units to ``(key, word, times)``; ``word`` hashes what stands before a unit's end."""
    for batch in batches:
        data, size = _bytes(batch)
        starts = np.arange(len(data)) * UNIT
        halves = data.view(">u8").astype(np.uint64)
        word = word_hashes(data.ravel(), starts, starts + size - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix(mix(halves[:, 0]) + halves[:, 1]).view(np.int64)),
             pa.array(word.view(np.int64)), batch["n"]],
            ["key", "word", "times"],
        )


def _places(model: ByteModel, batch: pa.RecordBatch, least: int = 3) -> pa.RecordBatch:
    """``(run, unit, cost)``: places of units, from ``least`` on, that a longer context than a frequent
    one may predict.

    ``run`` is context and byte with the context's length above; ``cost`` is the code length so far.
    """
    data, size = _bytes(batch)
    wide = np.full((len(data), ORDER + UNIT), NOTHING, np.uint8)
    wide[:, ORDER:] = data
    flat = np.r_[wide.ravel(), np.full(ORDER, NOTHING, np.uint8)]
    cost, level = (x.reshape(len(data), -1)[:, :UNIT] for x in model.costs(flat))
    run = _runs(flat, ORDER + 1, 0).reshape(len(data), -1)[:, :UNIT]
    place = np.arange(UNIT)
    reach = np.minimum(place, ORDER)
    i, j = np.nonzero((place >= least) & (place < size[:, None]) & (level < reach))
    held = reach[j].astype(np.uint64)
    run = run[i, j] & ((np.uint64(1) << (np.uint64(8) * held + np.uint64(8))) - np.uint64(1))
    halves = data.view(">u8").astype(np.uint64)
    key = mix(mix(halves[:, 0]) + halves[:, 1])
    return pa.RecordBatch.from_arrays(
        [pa.array((run | held << np.uint64(56)).view(np.int64)), pa.array(key[i].view(np.int64)),
         pa.array(cost[i, j])],
        ["run", "unit", "cost"],
    )


def _in(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys lie in sorted ones, and whether they do."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def _escape(count: np.ndarray, total: np.ndarray, distinct: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """``_chances`` of single symbols."""
    whole = np.maximum(2 * total, 1)
    share = np.where(total > 0, distinct / whole, 1)
    return np.where(count > 0, (2 * count - 1) / whole, share * lower)


def _gains(places: pa.Table, grams: pa.Table, low: tuple, model: ByteModel | None = None) -> pa.Table:
    """``(unit, d3, d4, d, seen)``: change of code length at places 3, 4 and later by all known contexts.

    All runs share hashes of the last three bytes of context, so longer contexts are complete here.
    With ``model`` all change is in ``d``, which also is the code length of each run asked for without a
    frequent context of ORDER bytes, with how often it was ``seen`` in training; of units that is null.
    """
    run, cost = places["run"].to_numpy().view(np.uint64), places["cost"].to_numpy()
    keys, n = grams["key"].to_numpy().view(np.uint64), grams["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at_unit, own, times = len(run), keys[:0], n[:0]
    if model is not None:
        row = model.rows_of(keys >> np.uint64(8))
        rare = (model.level_of[row] < ORDER) & grams["asked"].to_numpy()[order]
        own, times = keys[rare], n[rare]
        table = model.table[row[rare] * model.width + model.column[(own & np.uint64(0xFF)).astype(np.int32)]]
        run = np.r_[run, own | np.uint64(ORDER << 56)]
        cost = np.r_[cost, table.astype(np.float64)]
    chance = _chance_of(run, keys[n > 0], n[n > 0], low)
    code = np.where(chance > 0, -np.log10(np.maximum(chance, 1e-30)), cost)
    able = np.flatnonzero(chance[:at_unit] > 0)
    change = code[able] - cost[able]
    unit, at = np.unique(places["unit"].to_numpy()[able], return_inverse=True)
    column = np.minimum((run[able] >> np.uint64(56)).astype(int), 5) - 3
    sums = [np.bincount(at, np.where(column == c, change, 0), len(unit)).astype(float) for c in range(3)]
    seen = pa.array(np.r_[np.zeros(len(unit)), times].astype(np.int64), mask=np.arange(len(unit) + len(own)) < len(unit))
    if model is not None:
        return pa.table({
            "unit": np.r_[unit, mix(own | RUN).view(np.int64)], "d": np.r_[sum(sums), code[at_unit:]], "seen": seen,
        })
    return pa.table({"unit": unit, **dict(zip(("d3", "d4", "d"), sums, strict=True))})


def _chance_of(run: np.ndarray, keys: np.ndarray, n: np.ndarray, low: tuple) -> np.ndarray:
    """Probability of the last byte of each run after the longest known context of 3 bytes or more, 0
    without one. ``keys`` are the sorted training runs that share a run's last three bytes of context."""
    level = {ORDER: (keys, n)}
    for k in range(ORDER - 1, 2, -1):
        ends, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        level[k] = ends, np.bincount(at, n, len(ends))
    known2, counts2, below2, column = low

    def shortest(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, _ = _in(runs >> np.uint64(8) & np.uint64(0xFFFF), known2)
        return at, column[(runs & np.uint64(0xFF)).astype(int)]

    if not len(run) or not len(keys):
        return np.zeros(len(run))
    at, symbol = shortest(run)
    count = counts2[at, symbol].astype(np.float64)
    total, distinct = counts2.sum(1, dtype=np.float64)[at], (counts2 > 0).sum(1)[at]
    below, chance = below2[at, symbol].astype(np.float64), np.zeros(len(run))
    reach = run >> np.uint64(56)
    for k in range(3, ORDER + 1):
        have, m = level[k]
        context = have >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(have) else np.zeros(0, int)
        shorter = counts2[shortest(have)] if k == 3 else level[k - 1][1][
            _in(have & np.uint64((1 << 8 * k) - 1), level[k - 1][0])[0]]
        sums = [np.add.reduceat(x.astype(np.float64), first) if len(first) else x[:0] for x in (m, shorter)]
        here = run & np.uint64((1 << 8 * (k + 1)) - 1)
        at, known = _in(here >> np.uint64(8), context[first])
        known &= reach >= k
        if not known.any():
            break
        own_total, covered = sums[0][at], sums[1][at]
        own_distinct = np.diff(np.r_[first, len(have)])[at]
        at, seen = _in(here, have)
        own = np.where(seen, m[at], 0)
        below = np.where(known, _escape(count, total - covered, distinct - own_distinct, below), below)
        chance = np.where(known, _escape(own, own_total, own_distinct, below), chance)
        count, total, distinct = own, own_total, own_distinct
    return chance


def unit_table(counts: DataFrame, shared, low: tuple, buckets: int, across: bool = False) -> DataFrame:
    """``(key, n, d3, d4, d, times, seen)``: units, and words of more than one unit by their hash.

    ``n`` counts the word that a unit holds, ``d…`` are changes of code length by rare contexts. With
    ``across`` that is ``d`` alone, and there are runs too, ``seen`` so often in training, with their
    code length as ``d``. A run is in one group of contexts only, so runs are stored as they come.
    """
    units = counts.where(F.col("kind") == PIECE).select("key", "more", "n")
    grams = counts.where(F.col("kind") == GRAM).select("key", "n", "asked")
    low = counts.sparkSession.sparkContext.broadcast(low)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[0]
        for batch in batches:
            yield _places(model, batch, ORDER if across else 3)

    def bucket(run: str):
        # All runs with the same last three bytes of context meet.
        return F.pmod(F.xxhash64(F.shiftright(run, 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(buckets)).alias("bucket")

    left = units.mapInArrow(places, "run bigint, unit bigint, cost double").select("*", bucket("run"))
    right = grams.select("*", bucket("key"))
    changes = ["d"] if across else ["d3", "d4", "d"]
    gains = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(
        lambda a, b: _gains(a, b, low.value, shared.value[0] if across else None),
        "unit bigint" + "".join(f", {c} double" for c in changes) + ", seen bigint" * across,
    ).withColumnRenamed("unit", "key")
    if across:
        gains = stored(gains, "gains")
        runs = gains.where("seen is not null").select("key", "d", "seen")
        gains = gains.where("seen is null")
    gains = gains.groupBy("key").agg(*(F.sum(c).alias(c) for c in changes))
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    table = units.mapInArrow(_keys, "key bigint, word bigint, times bigint")
    table = table.join(words, "word", "left").join(gains, "key", "left")
    table = table.fillna(0, ["n", *changes, "times"])
    long = counts.where(F.col("kind") == LONG).select("key", "n")
    table = stored(table.drop("word").unionByName(long, allowMissingColumns=True), "units")
    table = table.withColumn("seen", F.lit(None).cast("bigint"))
    return table.unionByName(runs, allowMissingColumns=True).fillna(0, ["n"]) if across else table


def _cached(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - CACHED.bit_length() + 1)).astype(np.int64)


def _cache(table: DataFrame, units: int, runs: int) -> tuple[np.ndarray, ...]:
    """Frequent units and runs, as slots and what they hold; of two in a slot the rarer is left out."""
    often = F.when(F.col("seen").isNull(), F.col("times") * CACHE >= units)
    rows = table.where(often.otherwise((F.col("seen") > 0) & (F.col("seen") * CACHE >= runs)))
    rows = rows.withColumn("often", F.coalesce("seen", "times")).toArrow()
    keys, times = rows["key"].to_numpy().view(np.uint64), rows["often"].to_numpy()
    order = np.lexsort((keys, times))[::-1]
    slot, first = np.unique(_cached(keys[order]), return_index=True)
    order = order[first]
    return slot, keys[order], rows["n"].to_numpy()[order], *(
        rows[c].to_numpy()[order].astype(np.float32) for c in ("d3", "d4", "d") if c in table.columns)


def _in_slots(slot: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The columns with a place for every slot."""
    out = [np.zeros(CACHED, c.dtype) for c in columns]
    for held, new in zip(out, columns, strict=True):
        held[slot] = new
    return out


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, across: bool = False) -> DataFrame:
    """Base and model scores of every row of ``docs(doc_id, text, …)``.

    Learns from all rows whose crc32(id) modulo ``folds`` is not ``held_out``. Returns ``doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are decimal logarithms.
    Tokens are words with A-Z lowered, then one end. A null text is empty: one token. With nothing
    to learn from, base scores are 0 and bytes are all alike. Repeated rows are learned and
    scored each; a null id is the fold of an empty text. Other columns are not read. Rare
    contexts reach back over the start of a word only with ``across``, which is the whole model.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), text)
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    counted = shared_folder(spark, "counts")
    with short_shuffles(spark):
        counts = stored(corpus_counts(rows, across), "counts", counted)
        kinds = {r[0]: (r[1], r[2]) for r in counts.groupBy("kind").agg(
            F.count(F.lit(1)), F.sum("n")).collect()}
        ends = kinds.get(TEXT, (0, 0))[1]
        total = kinds.get(WORD, (0, 0))[1] + ends
        types = kinds.get(WORD, (0, 0))[0] + (1 if ends else 0)
        model = ByteModel(byte_levels(counts))
        shared = context.broadcast((model, ends))
        buckets = 1 + (kinds.get(GRAM, (0, 0))[0] + 4 * kinds.get(PIECE, (0, 0))[0]) // BUCKET
        table = unit_table(counts, shared, model.low, buckets, across)
        frequent = context.broadcast(_cache(table, *(kinds.get(k, (0, 0))[1] for k in (PIECE, GRAM))))
    # Units, words and runs are in tables of their own now.
    discard(spark, counted)
    kind = rows.schema["doc_id"].dataType
    # With ``across`` no place counts apart.
    changes = {"times": "d"} if across else {"e3": "d3", "e4": "d4", "times": "d"}
    numbers = ("words", *changes)
    # A text's own row has a base; its tokens and known ones are its words and times.
    schema = "row bigint, key bigint, " + "".join(f"{c} int, " for c in numbers)
    schema += f"doc_id {kind.simpleString()}, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, ends), (key_of, n_of, *change_of) = shared.value, _in_slots(*frequent.value)
        log_of = np.log10(n_of + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, at in _batches(batch["text"]):
                marked, begin = _marked(data, at)
                cost, level = model.costs(marked)
                hashes, owner, one, (word, start, size, keys, _, _) = _word_units(data, at, marked, begin)
                # What counts: the word, places 3 and 4 if no context reaches beyond the unit, the unit.
                parts = [one[word]]
                for i in () if across else (3, 4):
                    there = np.minimum(start + i, len(marked) - 1) - ORDER
                    parts.append((size > i) & (level[there] <= i))
                parts.append(np.ones(len(word), bool))
                long = np.flatnonzero(~one)
                keys = np.r_[keys, hashes[long]]
                parts = np.stack(parts).astype(np.int32)
                parts = np.hstack([parts, np.repeat((np.arange(len(parts)) == 0).astype(np.int32)[:, None], len(long), 1)])
                tokens = np.bincount(owner, minlength=b - a) + 1
                owner = np.r_[owner[word], owner[long]]
                if across:
                    # Places that a longer context may predict, and no unit holds whole.
                    able = (level < ORDER) & (marked[ORDER:] != START)
                    at_run = np.flatnonzero(able & ~_inside(start, size, len(cost)))
                    cost[at_run] = 0
                    keys = np.r_[keys, mix(_runs(marked, ORDER + 1, 0)[at_run] | RUN)]
                    owner = np.r_[owner, np.searchsorted(begin, at_run, "right") - 1]
                    parts = np.hstack([parts, np.repeat(np.array([[0], [1]], np.int32), len(at_run), 1)])
                slot = _cached(keys)
                hit = key_of[slot] == keys
                own, at_hit, has = owner[hit], slot[hit], parts[:, hit]
                base = np.bincount(own, log_of[at_hit] * has[0], b - a) + np.log10(ends + 1.0)
                known = np.bincount(own, (n_of[at_hit] > 0) * has[0], b - a).astype(np.int64) + (ends > 0)
                # A text's own symbols are the places from its first byte to its end mark.
                digits = np.add.reduceat(cost, begin[:-1])
                moved = sum(h * x[at_hit] for h, x in zip(has[1:], change_of, strict=True))
                digits += np.bincount(own, moved, b - a)
                # The others, once per text with their numbers.
                owner, keys, parts = owner[~hit], keys[~hit], parts[:, ~hit]
                # Keys that share their first bits may stay apart; they are added up later.
                order = np.argsort(owner.astype(np.uint64) << np.uint64(43) | keys >> np.uint64(21))
                owner, keys, parts = owner[order], keys[order], parts[:, order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
                at_new = np.flatnonzero(new)
                if len(at_new):
                    parts = np.add.reduceat(parts, at_new, 1, np.int32)
                own = np.zeros((len(numbers), b - a), np.int32)
                own[0], own[-1] = tokens, known
                number = row + np.arange(b - a)
                ids, none = batch.slice(a, b - a)["doc_id"], len(at_new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[row + owner[at_new], number]),
                        pa.array(np.r_[keys[at_new], mix(number.astype(np.uint64))].view(np.int64)),
                        *(pa.array(x) for x in np.hstack([parts, own])),
                        pa.concat_arrays([pa.nulls(none, ids.type), ids]),
                        *(pa.concat_arrays([pa.nulls(none, pa.float64()), pa.array(x)]) for x in (base, -digits)),
                    ],
                    ["row", "key", *numbers, "doc_id", "base", "score"],
                )
                row += b - a

    # What changes nothing needs no row.
    lacking = [F.coalesce(c, F.lit(0.0)).alias(c) for c in changes.values()]
    telling = table.select("key", "n", *lacking).where(" or ".join(f"{c} != 0" for c in ("n", *changes.values())))
    # A text's own row goes where its key's hash says, and meets nothing that counts.
    found = rows.select("doc_id", "text").mapInArrow(run, schema).join(telling, "key", "left")
    own, n, d = F.col("base").isNotNull(), F.coalesce("n", F.lit(0)), " + ".join(
        f"{e} * coalesce({d}, 0.0)" for e, d in changes.items())
    sums = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum(F.when(own, F.col("words")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(own, F.col("times")).when(n > 0, F.col("words")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.col("words") * F.log10(n + 1.0))).alias("base"),
        F.sum(F.coalesce("score", -F.expr(d))).alias("score"),
    )
    whole = float(np.log10(total + types + 1.0))
    return sums.select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )
