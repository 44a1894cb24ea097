"""Words and hashes of whole Arrow batches of text, in numpy.

A word is a run of bytes that are no ASCII white space (0x20, 0x09-0x0D), with A-Z lowered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the temporary arrays whatever the batch holds.
STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER = _powers(int(_BASE), STEP + 1)
_INVERSE = _powers(pow(int(_BASE), -1, 1 << 64), STEP + 1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 places where they begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and the number of words before each text (n + 1)."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[at] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[1:-1] = space[1:]
    edge[at] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def _poly(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _INVERSE[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + STEP, "right"))
        if j > i:
            out[i:j] = _poly(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
            i = j
            continue
        h = np.zeros(1, np.uint64)  # a word longer than STEP, piece by piece
        for k in range(int(a), int(ends[i]), STEP):
            piece = data[k : min(k + STEP, ends[i])]
            h = mix(h) + _poly(piece, np.zeros(1, np.int64), np.array([len(piece)]))
        out[i] = h[0]
        i += 1
    return mix(out + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``size`` words; of fewer words, the one run."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    runs = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        runs = mix(runs + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(runs)
