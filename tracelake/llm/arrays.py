"""Numpy helpers that work on many texts at once, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Units of text that are laid out in one array; a longer text is laid out alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads their bits."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WEIGHTS = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def _weights(n: int) -> np.ndarray:
    if len(_WEIGHTS[0]) < n:
        with np.errstate(over="ignore"):
            _WEIGHTS[0] = mix(np.arange(1, 2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _WEIGHTS[0]


def chunks(coded: list[bytes], sep: bytes, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lay encoded texts out behind each other, each followed by ``sep``.

    Yields (first text, end text, units, bounds): the units of text ``i`` are
    ``units[bounds[i - first]:bounds[i - first + 1] - 1]``; the last one of a
    range is the separator.
    """
    kind, width = {1: (np.uint8, 1), 2: (np.dtype("<u2"), 2), 4: (np.dtype("<u4"), 4)}[len(sep)]
    first = 0
    while first < len(coded):
        end, size = first, 0
        while end < len(coded) and (end == first or size + len(coded[end]) <= limit * width):
            size += len(coded[end])
            end += 1
        part = coded[first:end]
        units = np.frombuffer(sep.join(part) + sep, dtype=kind)
        bounds = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum([len(x) // width + 1 for x in part], out=bounds[1:])
        yield first, end, units, bounds
        first = end


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value must be false."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask)).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(units: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, whose units are those under ``mask``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    local = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(local, size)
    with np.errstate(over="ignore"):
        value = (units[mask].astype(np.uint64) + np.uint64(1)) * _weights(int(size.max()))[place]
        return mix(np.add.reduceat(value, local))


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds of each text's words within the words of a chunk."""
    return np.searchsorted(starts, bounds)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds, zero for an empty range."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VISIBLE = np.ones(256, dtype=bool)
_VISIBLE[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``n`` words, with A-Z as a-z; fewer words are one run, none give none."""
    out = []
    for first, end, units, bounds in chunks([(t or "").encode() for t in texts], b"\0"):
        low, visible = _FOLD[units], _VISIBLE[units]
        visible[bounds[1:] - 1] = False
        starts, ends = runs(visible)
        words = word_hashes(low, visible, starts, ends)
        many = max(0, len(words) - n + 1)
        run = np.zeros(many, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                run = mix(run + words[k : k + many])
            at = per_text(starts, bounds)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a >= n:
                    out.append(np.unique(run[a : b - n + 1]))
                else:
                    short = np.zeros(min(1, b - a), dtype=np.uint64)
                    for k in range(a, b):
                        short = mix(short + words[k])
                    out.append(short)
    return out
