"""Word hashes of a text, computed over its bytes with numpy."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that normalisation drops: ASCII that is neither a letter, a digit nor a space.
_DROPPED = np.array([c < 128 and not (chr(c).isalnum() or _SPACES[c]) for c in range(256)])

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes, normalise: bool = False) -> np.ndarray:
    """64-bit hashes of the words of ``data``, split at ASCII spaces.

    ``normalise`` ignores ASCII punctuation; words that consist of it alone vanish.
    Long data is worked off in parts that end at a space.
    """
    raw = np.frombuffer(data, np.uint8)
    if normalise:
        raw = raw[~_DROPPED[raw]]
    space = np.concatenate(([True], _SPACES[raw], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        first = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, first + (1 << 18), "right")))
        last = ends[stop - 1]
        power, inverse = _power_tables(int(last - first))
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_VALUE[raw[first:last]] * power[: last - first], out=total[1:])
        a, b = starts[done:stop] - first, ends[done:stop] - first
        hashes[done:stop] = mixed((total[b] - total[a]) * inverse[a])
        done = stop
    return hashes
