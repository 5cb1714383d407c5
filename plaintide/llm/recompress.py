"""The parse behind substring dedup: recompression of word sequences."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from plaintide.llm.tokens import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

ROUNDS = 7
_A, _B, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last round: names, first words, and the words [low, high) that settle them.

    ``words`` holds the word hashes of several documents one after the other, ``doc`` the
    number of the document of each. Runs of equal words get a name of word and length.
    In every round names fall into a left and a right class by a bit of their hash, and a left
    one followed by a right one becomes a pair with a name of its own. Names depend on
    nothing else, so they agree between documents without exchange.

    A symbol is settled by a stretch of words if no text outside the stretch could have
    changed it: a pair by its own two; a symbol left alone also by the neighbour that
    could have joined it. Where that would be the end of a document, the stretch reaches past it.
    """
    if not len(words):
        none = np.empty(0, np.int64)
        return words, none, none, none
    fresh = np.concatenate(([True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])))
    start = np.flatnonzero(fresh)
    length = np.diff(np.concatenate((start, [len(words)])))
    name, doc = words[start], doc[start]
    name = np.where(length > 1, mixed(name * _A + length.astype(np.uint64) * _K), name)
    low, high = start - 1, start + length + 1
    for k in range(rounds):
        right = (mixed(name ^ np.uint64((k + 1) * 0x9E3779B1)) & np.uint64(1)).astype(bool)
        same = np.concatenate((doc[1:] == doc[:-1], [False]))
        pair = ~right & np.concatenate((right[1:], [False])) & same
        second = np.concatenate(([False], pair[:-1]))
        before = np.concatenate(([False], same[:-1]))
        # Alone: a left symbol needs the one behind it, a right symbol the one before it.
        alone = ~pair & ~second
        next_high = np.where(same, np.concatenate((high[1:], [0])), high + 1)
        last_low = np.where(before, np.concatenate(([0], low[:-1])), low - 1)
        new_high = np.where(pair, np.maximum(high, next_high), np.where(alone & ~right, np.maximum(high, next_high), high))
        next_low = np.concatenate((low[1:], [0]))
        new_low = np.where(pair, np.minimum(low, next_low), np.where(alone & right, np.minimum(low, last_low), low))
        joined = mixed(name * _A + np.concatenate((name[1:], [np.uint64(0)])) * _B + np.uint64(k))
        name = np.where(pair, joined, name)
        keep = ~second
        name, doc, start, low, high = name[keep], doc[keep], start[keep], new_low[keep], new_high[keep]
    return name, start, low, high
