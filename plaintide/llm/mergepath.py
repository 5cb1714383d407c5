"""Merging the token ends of two tokenizers in pieces of equal work.

Two ascending lists of byte offsets, where the tokens of A and of B end, are merged. The merge
is a path through a grid; the point where it crosses a diagonal is found by binary search
in the two lists alone, so the path falls into pieces of equal length that know nothing of each
other. A stretch between two neighbouring ends belongs to one token of A and one of B: each
is a link. Where both lists end, a group of tokens closes; a group that goes on beyond a piece
is stitched to its beginning by the number of groups that closed before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

#: Steps of the merge in a piece.
PIECE = 1 << 16


def crossings(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many ends of A come before each diagonal, of equal ends the one of A first.

    Diagonals lie ``piece`` steps apart; the first one is 0, the last the whole path.
    """
    steps = len(a) + len(b)
    diagonal = np.concatenate((np.arange(0, steps, piece), [steps]))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        # Is the end of A at ``middle`` before the diagonal, that is not behind the end of B opposite?
        before = np.zeros(len(diagonal), bool)
        before[open_] = a[middle[open_]] <= b[diagonal[open_] - middle[open_] - 1]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)


def links(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the token of A, the token of B, and whether a group closes, for every link.

    Both lists ascend strictly and have the same last end.
    """
    split = crossings(a, b, piece)
    steps = len(a) + len(b)
    diagonal = np.concatenate((np.arange(0, steps, piece), [steps]))
    for i, j, i_end, j_end in zip(split, diagonal - split, split[1:], (diagonal - split)[1:]):
        own_a, own_b = a[i:i_end], b[j:j_end]
        if i and len(own_b) and own_b[0] == a[i - 1]:
            own_b = own_b[1:]  # the other half of a closing pair, whose link the piece before has
        ends = np.sort(np.concatenate((own_a, own_b)), kind="stable")
        ends = ends[np.concatenate(([True], ends[1:] != ends[:-1]))] if len(ends) else ends
        of_a = i + np.searchsorted(a[i:i_end], ends)
        of_b = j + np.searchsorted(b[j:j_end], ends)
        yield of_a, of_b, (a[of_a] == ends) & (b[of_b] == ends)
