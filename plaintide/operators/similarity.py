"""Character similarity of two normalised names, for already blocked pairs only."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Python workers get these helpers with the task, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common_subsequence(left: str, right: str) -> int:
    """Length of the longest common subsequence, one machine-word sweep per letter."""
    places: dict[str, int] = {}
    for position, letter in enumerate(left):
        places[letter] = places.get(letter, 0) | (1 << position)
    everything = (1 << len(left)) - 1
    open_places = everything
    for letter in right:
        hits = open_places & places.get(letter, 0)
        open_places = ((open_places + hits) | (open_places - hits)) & everything
    return len(left) - open_places.bit_count()


#: A digit of a word of which the shape alone is known.
HIDDEN = "\0"


def _laid_out(fixed: list[str], shapes: list[str]) -> tuple[str, list[tuple[str, list[int]]]] | None:
    """The sorted words as one string with hidden digits, and (shape, places of its digits); None if digits decide the order."""
    words = sorted([(w, w, w) for w in fixed] + [(w, w.replace("0", "9"), w.replace("0", HIDDEN)) for w in shapes])
    if any(before[1] > after[0] for before, after in zip(words, words[1:])):
        return None
    text, digits = "", []
    for _, _, word in words:
        start = len(text) + (text != "")
        text = f"{text} {word}" if text else word
        if HIDDEN in word:
            digits.append((word, [start + i for i, letter in enumerate(word) if letter == HIDDEN]))
    return text, digits


def _swept(hits_of: list[int], length: int) -> int:
    """Common subsequence of a text of this length and one whose letters have these hits in it."""
    everything = (1 << length) - 1
    open_places = everything
    for places in hits_of:
        hits = open_places & places
        open_places = ((open_places + hits) | (open_places - hits)) & everything
    return length - open_places.bit_count()


def class_bound(left_fixed: list[str], left_shapes: list[str], right_fixed: list[str], right_shapes: list[str]) -> float:
    """The most that edits can give two names of which some words and the shapes (digits made 0) of the others are known.

    The names have no word in common but fixed ones. A hidden digit may be any; two words of one shape
    differ, so in every alignment some digit of one has not the digit at the same place of the other.
    """
    shared = set(left_fixed) & set(right_fixed)
    left = _laid_out([w for w in left_fixed if w not in shared], left_shapes)
    right = _laid_out([w for w in right_fixed if w not in shared], right_shapes)
    if left is None or right is None or not left[0] or not right[0]:
        return 100.0
    (a, a_digits), (b, b_digits) = left, right

    def fits(x: str, y: str) -> bool:
        return x == y or (x == HIDDEN and y.isdigit()) or (y == HIDDEN and x.isdigit())

    by_letter = {y: sum(1 << i for i, x in enumerate(a) if fits(x, y)) for y in set(b)}
    hits_of = [by_letter[y] for y in b]
    kept = _swept(hits_of, len(a))
    for shape, own in a_digits:
        for other_shape, other in b_digits:
            if shape == other_shape:
                without = ([h & ~(1 << i) if at == j else h for at, h in enumerate(hits_of)] for i, j in zip(own, other))
                kept = min(kept, max(_swept(hits, len(a)) for hits in without))
    beside = len(" ".join(shared)) + (1 if shared else 0)
    return _likeness(len(a) + len(b) - 2 * kept, 2 * beside + len(a) + len(b))


@F.pandas_udf(DoubleType())
def class_score_bound(left_fixed: pd.Series, left_shapes: pd.Series, right_fixed: pd.Series, right_shapes: pd.Series) -> pd.Series:
    rows = zip(left_fixed, left_shapes, right_fixed, right_shapes)
    return pd.Series([class_bound(*map(list, row)) for row in rows], dtype="float64")


def _likeness(edits: int, total: int) -> float:
    return 100.0 if total == 0 else 100.0 - 100.0 * edits / total


def token_set_score(left: str, right: str) -> float:
    """0-100 similarity that ignores word order and repeated words.

    The words of both names split into common and one-sided ones. One side
    contained in the other scores 100. Otherwise the best of three insert/delete
    ratios counts: common words against common plus either remainder, which
    needs lengths only, and the two full strings against each other, which
    differ in their remainders alone.
    """
    words_left, words_right = set(left.split()), set(right.split())
    if not words_left or not words_right:
        return 0.0
    common = " ".join(sorted(words_left & words_right))
    rest_left = " ".join(sorted(words_left - words_right))
    rest_right = " ".join(sorted(words_right - words_left))
    if common and not (rest_left and rest_right):
        return 100.0
    gap = 1 if common else 0
    full_left = len(common) + gap + len(rest_left)
    full_right = len(common) + gap + len(rest_right)
    kept = common_subsequence(rest_left, rest_right)
    edits = len(rest_left) + len(rest_right) - 2 * kept
    scores = [_likeness(edits, full_left + full_right)]
    if common:
        scores.append(_likeness(gap + len(rest_left), len(common) + full_left))
        scores.append(_likeness(gap + len(rest_right), len(common) + full_right))
    return max(scores)


@F.pandas_udf(DoubleType())
def pair_score(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(a, b) for a, b in zip(left, right)], dtype="float64")


def _letters_of(texts: list[str]) -> np.ndarray:
    """Code points, one text a row, filled up with zeros."""
    width = max(map(len, texts))
    whole = "".join(text.ljust(width, "\0") for text in texts)
    return np.frombuffer(whole.encode("utf-32-le"), "<u4").reshape(len(texts), width)


def block_edits(lefts: list[str], rights: list[str], common: list[str]) -> np.ndarray:
    """Edits between the words of names beside the common ones: rows are names of the right, columns of the left.

    The sweep of ``common_subsequence``, for all pairs at once.
    """
    shared = set(common)
    own, other = ([" ".join(sorted(set(name.split()) - shared)) for name in side] for side in (lefts, rights))
    lengths = np.array([len(t) for t in other])[:, None] + np.array([len(t) for t in own])[None, :]
    size = max(map(len, own))
    if size == 0 or not any(other):
        return lengths
    if size > 64:
        return lengths - 2 * np.array([[common_subsequence(a, b) for a in own] for b in other])
    mine, theirs = _letters_of(own), _letters_of(other)
    if max(mine.max(), theirs.max()) > 127:
        _, codes = np.unique(np.concatenate([[0], mine.ravel(), theirs.ravel()]), return_inverse=True)
        mine, theirs = codes[1 : mine.size + 1].reshape(mine.shape), codes[mine.size + 1 :].reshape(theirs.shape)
    word = np.uint32 if size <= 32 else np.uint64
    places = np.zeros((max(128, mine.max() + 1, theirs.max() + 1), len(own)), word)
    for at in range(size):
        places[mine[:, at], np.arange(len(own))] |= word(1 << at)
    places[0] = 0
    open_places = np.full((1, len(own)), (1 << size) - 1, word)
    alike = (theirs == theirs[0]).all(axis=0)
    for at in range(theirs.shape[1]):
        hits = open_places & (places[theirs[:1, at]] if alike[at] else places[theirs[:, at]])
        open_places = (open_places + hits) | (open_places - hits)
    kept = np.bitwise_count(~open_places & word((1 << size) - 1)).astype("int64")
    return lengths - 2 * kept


def _shared_rare(left_rares: list[list[str]], right_rares: list[list[str]]) -> list[tuple[int, int]]:
    places: dict[str, list[int]] = {}
    for at, words in enumerate(left_rares):
        for word in words:
            places.setdefault(word, []).append(at)
    return [(r, l) for r, words in enumerate(right_rares) for word in words for l in places.get(word, ())] if places else []


#: Pairs that are handed on at a time.
_AT_A_TIME = 1 << 19


def pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of names of two blocks that may count, as two more columns of lists.

    ``pairs`` has their places (place of the right times names of the left, plus place of the left) and ``edits`` their edits.
    Pairs with a rare word in common are left out. Where ``by_words`` the edits do not matter and are 0. Else they are at most
    ``most``, and pairs with as many count only if the words in common ``covers`` them.
    """
    for batch in batches:
        pairs, edits, start, size = [], [], 0, 0

        def handed_on(end: int) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(column), pa.int32())) for column in (pairs, edits)]
            taken = batch.slice(start, end - start)
            columns = [taken.column(c) for c in taken.schema.names if c not in _WEIGHED_BY]
            names = [c for c in taken.schema.names if c not in _WEIGHED_BY]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=[*names, "pairs", "edits"])

        weighed_by = zip(*(batch.column(c).to_pylist() for c in _WEIGHED_BY[:4]))
        for at, (shared, by_words, most, covers) in enumerate(weighed_by):
            mine, theirs, own, other = (batch.column(c)[at].as_py() for c in ("lefts", "rights", "left_rares", "right_rares"))
            if by_words:
                found = np.zeros((len(theirs), len(mine)), "int64")
            else:
                found = np.minimum(block_edits(mine, theirs, shared), most)
            counted = np.ones(found.shape, bool) if by_words or covers else found < most
            for place in _shared_rare(own, other):
                counted[place] = False
            counted = counted.ravel()
            pairs.append(np.flatnonzero(counted).astype("int32"))
            edits.append(found.ravel()[counted].astype("int32"))
            size += len(pairs[-1])
            if size >= _AT_A_TIME:
                yield handed_on(at + 1)
                pairs, edits, start, size = [], [], at + 1, 0
        if pairs:
            yield handed_on(batch.num_rows)


#: What blocks are weighed by and what is not handed on.
_WEIGHED_BY = ["common", "by_words", "most", "covers", "left_rares", "right_rares", "lefts"]
