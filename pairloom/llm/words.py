"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than space and the control signs 9 to 13. Hashes are sums of powers of an odd base
modulo 2^64, taken as differences of running sums, so that words and windows of words cost a few passes over arrays.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2 << 20
SLICE = 1 << 17  # bytes that are turned into numbers together
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words:
    """Starts and ends of all words, and the bounds of each text in them."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        size = len(data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        begins, finishes = inside.copy(), inside.copy()
        if size:
            begins[1:] &= ~inside[:-1] | edge[1:size]
            finishes[:-1] &= ~inside[1:] | edge[1:size]
        self.data = data
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """One hash for each word; ``fold`` takes A-Z as a-z."""
        out = np.empty(len(self.starts), np.uint64)
        edges = np.flatnonzero(np.diff(self.starts // SLICE)) + 1
        for a, b in zip([0, *edges], [*edges, len(out)] if len(out) else []):  # few bytes at a time, as 64-bit numbers
            low = self.starts[a]
            data = self.data[low : self.ends[b - 1]]
            values = data.astype(np.uint64)
            if fold:
                values += ((data >= 65) & (data <= 90)).astype(np.uint64) * np.uint64(32)
            values += np.uint64(1)
            out[a:b] = stretches(values, self.starts[a:b] - low, self.ends[a:b] - low)
        return out


_powers: dict[str, np.ndarray] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(max(2 * size, SLICE), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:size], _powers["down"][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` for all pairs, equal for equal stretches wherever they stand."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` neighbouring words; those at the end that are cut short are left out."""
    count = max(len(hashes) - width + 1, 0)
    starts = np.arange(count)
    return stretches(hashes, starts, starts + width)


def window_places(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that lie inside one text, and how many each text has."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    ends = np.cumsum(counts)
    shift = np.repeat(bounds[:-1] - (ends - counts), counts)
    return np.arange(len(shift)) + shift, counts


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of ``width`` values, from each value on that has so many."""
    place = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        reach += step
    return place
