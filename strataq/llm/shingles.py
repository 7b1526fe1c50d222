"""Word-shingle sets of whole texts as sorted 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
PIECE = 1 << 22
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A value per byte; A to Z have those of a to z.
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_VALUE[65:91] = _VALUE[97:123]
_BASE = _U(0xD1342543DE82EF95)
_POWER = np.cumprod(np.full(64, _BASE, _U))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.cumprod(np.full(max(n, 2 * len(_POWER)), _BASE, _U))
    return _POWER[:n]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start and count, in one array."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, which ``bounds`` cuts out of the bytes ``data``, and the number of words of each."""
    word = ~_BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = bounds[:-1][np.diff(bounds) > 0]
    begins[edge] = word[edge]
    first = np.flatnonzero(begins)
    after = word.copy()
    after[:-1] &= ~word[1:]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    after[last] = word[last]
    size = np.flatnonzero(after) + 1 - first
    per_text = np.searchsorted(first, bounds[1:]) - np.searchsorted(first, bounds[:-1])
    out = np.empty(len(first), _U)
    # Runs of words with about PIECE bytes, or one longer word, bound the memory.
    ends = np.cumsum(size)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        s, n = first[at:to], size[at:to]
        places = ragged(np.zeros(len(s), np.int64), n)
        values = _VALUE[data[ragged(s, n)]] * _powers(int(n.max()))[places]
        out[at:to] = mix(np.add.reduceat(values, np.cumsum(n) - n) + n.astype(_U))
        at = to
    return out, per_text


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles, or of all its words together if it has fewer."""
    hashed, per_text = words(data, bounds)
    n = len(hashed)
    rolled = np.zeros(max(n - width + 1, 0), _U)
    for k in range(width):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + hashed[k : n - width + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled + _U(width))
    out = []
    at = 0
    for count in per_text.tolist():
        if count >= width:
            out.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            h = _U(0)
            with np.errstate(over="ignore"):
                for x in hashed[at : at + count]:
                    h = h * _U(0x9E3779B97F4A7C15) + x
            out.append(mix(np.array([h + _U(count)], _U)))
        else:
            out.append(np.zeros(0, _U))
        at += count
    return out


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string or binary column without nulls."""
    import pyarrow as pa

    arr = column.cast(pa.large_binary())
    bounds = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if arr.buffers()[2] is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]
