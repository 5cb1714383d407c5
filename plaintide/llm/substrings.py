"""Substring dedup: words covered by a window of words that also starts elsewhere.

Recompression (``recompress``) turns every text into a short sequence of symbols whose
names are the same wherever the same words stand, whatever surrounds them, and tells for
each symbol which stretch of words settles it. Three rounds over the cluster follow.

1. Names are counted over all texts. A name that occurs once proves that no window that
   holds the symbol's stretch occurs twice. Only these unique symbols go back to their
   texts, by key, with the map tasks combining counts, so frequent passages cost little.
2. Equal texts become one with a multiplicity. What no unique symbol rules out are the
   candidate windows; shared symbols lie under nearly all of them. Their exact word
   sequences are hashed to 96 bits and counted with the multiplicities.
3. Candidates that occur once go back; the others are repeats, and their words go.

No name, window or text is collected; all joins are on the text's key, which has one row
on either side. A collision of names only adds candidates.

Defined cases: null is the empty text, with no words; texts shorter than a window keep all
words; rows that repeat a document are texts that occur twice; overlapping repeats inside
one text count; an empty table gives no rows. Columns other than id and text are left aside.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.common import whole_text
from plaintide.llm.recompress import recompress
from plaintide.llm.tokens import mixed, word_hashes
from plaintide.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

WINDOW = 35
ROUNDS = 6
#: Words that are parsed together.
_PART_WORDS = 1 << 17
#: Rows per batch that goes back.
_BATCH = 1 << 16


def _emit(columns: list[list[np.ndarray]], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    joined = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    for at in range(0, len(joined[0]), _BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _BATCH], t) for c, t in zip(joined, types)], names=names)


def _parts(words: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are parsed together."""
    first, held = 0, 0
    for i, w in enumerate(words):
        held += len(w)
        if held >= _PART_WORDS:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(words):
        yield first, len(words)


def _parsed(words: list[np.ndarray], rounds: int):
    """Symbols of several texts: the text's number, its first word, and the parse."""
    sizes = np.array([len(w) for w in words])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(words)), sizes)
    name, start, low, high = recompress(np.concatenate([*words, np.empty(0, np.uint64)]), owner, rounds)
    text = owner[start]
    base = offsets[text]
    inside = (low >= base) & (high <= offsets[text + 1]) & (high - low <= WINDOW)
    return name, text, start - base, low - base, high - base, inside


def _symbols(window: int, rounds: int):
    """Texts (k1, k2, text) to the symbols that a window can hold: (name, k1, place).

    A place is the start and, in its lowest 16 bits, k2: these rows are the bulk of what is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words = [word_hashes(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in _parts(words):
                name, text, start, _, _, inside = _parsed(words[a:b], rounds)
                name, text, start = name[inside], text[inside] + a, start[inside]
                for held, values in zip(out, (name.view(np.int64), k1[text], start << 16 | k2[text])):
                    held.append(values)
            yield from _emit(out, ["name", "k1", "place"], [pa.int64(), pa.int64(), pa.int64()])

    return run


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        texts = [squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["k1", "k2", "z"])


def candidates(n_words: int, low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows that hold none of the stretches [low, high)."""
    n = n_words - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    latest = np.full(n_words + 1, -1, np.int64)
    np.maximum.at(latest, high, low)
    latest = np.maximum.accumulate(latest)  # the last start of a stretch that ends by then
    starts = np.arange(n)
    return starts[latest[starts + window] < starts]


def _ends(starts: np.ndarray) -> np.ndarray:
    """Sorted numbers as runs: first and last of each, one after the other."""
    if not len(starts):
        return np.empty(0, np.int32)
    cut = np.flatnonzero(np.diff(starts) > 1)
    first, last = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
    return np.stack((first, last), axis=1).astype(np.int32).ravel()


def _starts(ends: np.ndarray) -> np.ndarray:
    """The numbers of such runs."""
    first, size = ends[::2].astype(np.int64), (ends[1::2] - ends[::2] + 1).astype(np.int64)
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _answer(words: list[bytes], starts: np.ndarray, window: int, with_text: bool) -> tuple[int, str, str | None]:
    """Number of removed words, hash and text of the kept ones."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    return int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None


def _judged(window: int, rounds: int, with_text: bool):
    """Texts with their unique symbols to their candidates, or to the answer where there is none to settle.

    A text that occurs twice loses all its words, and one without candidates none. The
    compressed text goes on only with candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        none = np.empty(0, np.int64)
        for batch in batches:
            packed = batch.column("z").to_pylist()
            words = [word_hashes(expand(z)) for z in packed]
            unique, copies = batch.column("unique"), batch.column("copies").to_pylist()
            ends, kept_z, answers = [], [], []
            for a, b in _parts(words):
                name, text, start, low, high, inside = _parsed(words[a:b], rounds)
                edges = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(a, b):
                    own = slice(edges[i - a], edges[i - a + 1])
                    once = unique[i].values
                    mark = np.isin(start[own], once.to_numpy()) & inside[own] if once is not None else np.zeros(own.stop - own.start, bool)
                    found = candidates(len(words[i]), low[own][mark], high[own][mark], window)
                    ends.append(_ends(found))
                    kept_z.append(packed[i] if len(found) else None)
                    if copies[i] > 1 and len(words[i]) >= window:
                        answers.append((len(words[i]), hashlib.sha256(b"").hexdigest(), "" if with_text else None))
                    elif len(found):
                        answers.append((None, None, None))
                    else:
                        answers.append(_answer(expand(packed[i]).split(), none, window, with_text))
            removed, digests, texts = zip(*answers) if answers else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"), batch.column("k2"), batch.column("copies"), pa.array([len(w) for w in words], pa.int64()),
                    pa.array(kept_z, pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                ],
                names=["k1", "k2", "copies", "n_words", "z", "ends", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _windows(window: int):
    """Candidate windows: two hashes of the words, the copies of the text, its number and the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        odd = [np.random.default_rng(seed).integers(0, 2**63, window, np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]
        for batch in batches:
            rid, copies = batch.column("rid").to_numpy(), batch.column("copies").to_numpy()
            out: list[list[np.ndarray]] = [[] for _ in _NAMES]
            held = 0
            for i, z in enumerate(batch.column("z").to_pylist()):
                starts = _starts(batch.column("ends")[i].values.to_numpy())
                words = word_hashes(expand(z))
                first, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
                for k in range(window):
                    w = words[starts + k]
                    first += w * odd[0][k]
                    second += (w ^ (w >> np.uint64(29))) * odd[1][k]
                n = len(starts)
                values = (mixed(first).view(np.int64), (mixed(second) >> np.uint64(33)).astype(np.int32), np.full(n, copies[i]), np.full(n, rid[i]), starts.astype(np.int32))
                for to, v in zip(out, values):
                    to.append(v)
                held += n
                if held >= _BATCH:
                    yield from _emit(out, _NAMES, _TYPES)
                    out, held = [[] for _ in _NAMES], 0
            yield from _emit(out, _NAMES, _TYPES)

    return run


_NAMES = ["h1", "h2", "copies", "rid", "start"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]


def _cut(window: int, with_text: bool):
    """Judged texts and their single candidates to their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            answers = []
            for i, z in enumerate(batch.column("z").to_pylist()):
                starts, single = _starts(batch.column("ends")[i].values.to_numpy()), batch.column("single")[i].values
                if single is not None:
                    starts = np.setdiff1d(starts, single.to_numpy(), assume_unique=True)
                answers.append(_answer(expand(z).split(), starts, window, with_text))
            removed, digests, texts = zip(*answers) if answers else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=_ANSWER,
            )

    return run


_ANSWER = ["k1", "k2", "n_words", "n_removed", "kept_sha256", "kept_text"]


def dedup_substrings(documents: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless asked for).

    Texts are told apart by 80 bits of hash. Numbers of texts (``rid``) are read from the written table.
    """
    k1, k2 = F.xxhash64("text"), F.xxhash64(F.lit("key"), "text").bitwiseAND(F.lit(0xFFFF)).cast("int")
    docs = documents.select("doc_id", whole_text().alias("text"))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    symbols = keyed.mapInArrow(_symbols(window, rounds), "name bigint, k1 bigint, place bigint")
    once = symbols.groupBy("name").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "place")]).where("n = 1")
    once = once.select("k1", F.col("place").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("k2"), F.shiftright("place", 16).cast("int").alias("start"))
    once = once.groupBy("k1", "k2").agg(F.collect_list("start").alias("unique"))
    texts = keyed.mapInArrow(_zip, "k1 bigint, k2 int, z binary").groupBy("k1", "k2").agg(F.first("z").alias("z"), F.count("*").alias("copies"))
    texts = texts.join(once, ["k1", "k2"], "left").select("k1", "k2", "copies", "z", "unique")
    answer = "n_removed bigint, kept_sha256 string, kept_text string"
    judged = texts.mapInArrow(_judged(window, rounds, with_text), f"k1 bigint, k2 int, copies bigint, n_words bigint, z binary, ends array<int>, {answer}")
    judged = settle(judged.withColumn("rid", F.monotonically_increasing_id()), "substrings")
    windows = judged.where("z IS NOT NULL").select("rid", "copies", "z", "ends")
    windows = windows.mapInArrow(_windows(window), "h1 bigint, h2 int, copies bigint, rid bigint, start int")
    counted = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n"), F.min("rid").alias("rid"), F.min("start").alias("start"))
    single = counted.where("n = 1").groupBy("rid").agg(F.collect_list("start").alias("single"))
    open_ = judged.where("n_removed IS NULL").select("rid", "k1", "k2", "n_words", "z", "ends").join(single, "rid", "left")
    cut = open_.select("k1", "k2", "n_words", "z", "ends", "single").mapInArrow(_cut(window, with_text), f"k1 bigint, k2 int, n_words bigint, {answer}")
    answers = settle(judged.where("n_removed IS NOT NULL").select(*_ANSWER).union(cut), "substrings-cut")
    ids = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    return ids.join(answers, ["k1", "k2"]).select("doc_id", *_ANSWER[2:])
