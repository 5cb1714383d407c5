"""Benchmark decontamination by spaced seeds.

Words are lower-cased and stripped of ASCII punctuation. A seed is a fixed mask over
consecutive words that looks at some positions and ignores the others, so a
substituted word at an ignored position does no harm; several masks cover one another's
blind spots. The hashes of all masked windows of the benchmark are set in a bit field of
fixed size that every task holds; windows of documents that pass it are hits. Hits are
joined with the benchmark's hashes, which is exact, and every hit is then extended: on
its diagonal the words of document and item around the hit are compared position by
position, and the longest stretch with enough equal words is the overlap.

The bit field has a fixed size, whatever the benchmark's; when it fills up more hits reach
the join, and the result stays the same. Only hits and the words around them leave a scan.

The masks leave no gap: every overlap from five words on with both ends and four of five words
equal holds a window of one of them, whichever words are substituted (a test goes through
all patterns). Items of five to twelve words have shorter masks, shorter ones are found by their
whole word sequence; those masks are looked for only where such items are.

Defined cases: null texts are empty; an item without words never matches; an item of less than
five words is reported, but no reason to drop a document; of overlaps of equal length the one
with more equal words is reported, then the first in the document, then in the item; repeated
documents and items are reported each, equal rows once; an empty table gives no rows. Only ids
and texts are read; ``decontaminate`` keeps extra columns of any name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.common import packed, same, whole_text
from plaintide.llm.tokens import mixed, word_hashes
from plaintide.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

#: Looked-at positions of each mask.
MASKS = (
    (0, 1, 2, 3, 4, 5),
    (0, 1, 2, 4, 5, 7),
    (0, 1, 3, 4, 6, 7),
    (0, 2, 3, 5, 7, 8),
    (0, 1, 2, 6, 8, 9),
)
#: The same for items that are shorter than an overlap has to be, down to ``SHORTEST`` words.
SHORT_MASKS = ((0, 1, 2), (0, 1, 3, 4))
SHORTEST = 5
#: An overlap has at least so many words, or all of a shorter item, and so many of them are equal.
OVERLAP = 13
SIMILARITY = 0.8
#: Words compared to either side of a hit.
REACH = 64
FILTER_BITS = 1 << 24
_SPAN = max(m[-1] for m in MASKS) + 1
_ODD = np.random.default_rng(7).integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass"), normalise=True)


def window_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, len(mask) * 1000 + mask[-1], np.uint64)
    for at, odd in zip(mask, _ODD):
        total += words[at : at + n] * odd
    return mixed(total)


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """The masks by which an item of that many words is looked for."""
    if length < SHORTEST:
        return (tuple(range(length)),) if length else ()
    return MASKS if length >= OVERLAP else SHORT_MASKS


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words, hashes, places = batch.column(0), [], [], []
        for text in batch.column(1).to_pylist():
            w = words_of(text)
            found = [window_hashes(w, m) for m in masks_of(len(w))]
            words.append(w.tobytes())
            hashes.append(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))
            places.append(np.concatenate([*[np.arange(len(f), dtype=np.int32) for f in found], np.empty(0, np.int32)]))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(words, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            names=["item_id", "item_words", "hashes", "places"],
        )


def _field(shingles: DataFrame) -> np.ndarray:
    """The bit field of the hashes; its words are combined on the cluster, at most FILTER_BITS / 64 reach the driver."""
    low = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = shingles.select(F.explode(F.array(low, high)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    rows = words.toPandas()
    field = np.zeros(FILTER_BITS // 64, np.int64)
    field[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(field.view(np.uint8), bitorder="little").view(bool)


def _segments(field_bits: bytes, masks: tuple[tuple[int, ...], ...]):
    """Documents to segments around their hits: words, and the hits' hashes and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(np.frombuffer(field_bits, np.uint8), bitorder="little").view(bool)
        last = np.uint64(FILTER_BITS - 1)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                found_at, found = [], []
                for mask in masks:
                    h = window_hashes(words, mask)
                    at = np.flatnonzero(field[h & last])
                    at = at[field[(h[at] >> np.uint64(32)) & last]]
                    found_at.append(at)
                    found.append(h[at])
                at = np.concatenate([*found_at, np.empty(0, np.int64)])
                h = np.concatenate([*found, np.empty(0, np.uint64)])
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                key = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)
                key -= (key >> 63) << 64  # signed, as the engine has it
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * REACH) + 1):
                    start = max(0, int(at[part[0]]) - REACH)
                    stop = min(len(words), int(at[part[-1]]) + _SPAN + REACH)
                    rows.append((i, key, start, words[start:stop].tobytes(), h[part].view(np.int64), at[part].astype(np.int32)))
            pick, key, start, held, hashes, at = zip(*rows) if rows else ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(pick, pa.int64())), pa.array(key, pa.int64()), pa.array(start, pa.int64()),
                    pa.array(held, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_key", "start", "words", "hashes", "places"],
            )

    return run


def longest_overlap(equal: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The longest stretch with at least that share of true values, without false ends: (start, length)."""
    balance = np.concatenate(([0.0], np.cumsum(equal - similarity + 1e-9)))
    least = np.minimum.accumulate(balance)
    most = np.maximum.accumulate(balance[::-1])[::-1]
    a = b = start = stop = 0
    while b < len(balance):
        if least[a] <= most[b]:
            if b - a > stop - start:
                start, stop = a, b
            b += 1
        else:
            a += 1
            b = max(a, b)
    while start < stop and not equal[start]:
        start += 1
    while stop > start and not equal[stop - 1]:
        stop -= 1
    return start, stop - start


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, length, matched, at_doc, at_item = [], [], [], [], []
        columns = [batch.column(n).to_pylist() for n in ("words", "start", "item_words", "shifts")]
        for i, (doc, start, item, shifts) in enumerate(zip(*columns)):
            doc, item = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
            best = None
            for shift in sorted(shifts):  # item position = document position - shift
                low, high = max(start, shift), min(start + len(doc), shift + len(item))
                if high <= low:
                    continue
                equal = doc[low - start : high - start] == item[low - shift : high - shift]
                a, n = longest_overlap(equal)
                if n >= min(OVERLAP, len(item)) and (best is None or n > best[0]):
                    best = (n, int(equal[a : a + n].sum()), low + a, low + a - shift)
            if best:
                for to, v in zip((length, matched, at_doc, at_item), best):
                    to.append(v)
                keep.append(i)
        taken = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [taken.column("doc_id"), taken.column("text_key"), taken.column("item_id"), *[pa.array(v, pa.int64()) for v in (length, matched, at_doc, at_item)]],
            names=["doc_id", "text_key", "item_id", "n_words", "n_equal", "doc_start", "item_start"],
        )


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: the longest overlap, in words of each.

    ``text_key`` tells apart rows that repeat a document id.
    """
    kind = dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", whole_text().alias("text")).mapInArrow(
        _items, f"item_id {kind}, item_words binary, hashes array<bigint>, places array<int>"
    )
    items = settle(items.distinct(), "benchmark-items")
    shingles = items.select("item_id", "item_words", F.arrays_zip("hashes", "places").alias("z"))
    shingles = shingles.select("item_id", F.inline("z").alias("hash", "place"))
    lengths = items.select(F.least(F.length("item_words") / 8, F.lit(OVERLAP)).cast("int").alias("n")).distinct().collect()
    masks = tuple(sorted({m for r in lengths for m in masks_of(r.n)}))  # of at most OVERLAP + 1 lengths
    field = np.packbits(_field(shingles), bitorder="little").tobytes()
    kind = dict(documents.dtypes)["doc_id"]
    segments = documents.select("doc_id", "text").mapInArrow(
        _segments(field, masks),
        f"doc_id {kind}, text_key bigint, start bigint, words binary, hashes array<bigint>, places array<int>",
    )
    segments = settle(segments, "segments").withColumn("seg", F.struct("doc_id", "text_key", "start"))
    hits = segments.select("seg", F.inline(F.arrays_zip("hashes", "places")).alias("hash", "at"))
    pairs = hits.join(shingles, "hash").select("seg", "item_id", (F.col("at") - F.col("place")).cast("bigint").alias("shift"))
    pairs = pairs.groupBy("seg", "item_id").agg(F.collect_set("shift").alias("shifts"))
    p, s, i = pairs.alias("p"), segments.drop("hashes", "places").dropDuplicates(["seg"]).alias("s"), items.alias("i")
    verified = (
        p.join(s, same(F.col("p.seg"), F.col("s.seg")))
        .join(i.select("item_id", "item_words"), same(F.col("p.item_id"), F.col("i.item_id")))
        .select("s.doc_id", "s.text_key", "p.item_id", "p.shifts", "s.words", "s.start", "i.item_words")
    )
    schema = f"doc_id {kind}, text_key bigint, item_id {dict(items.dtypes)['item_id']}, n_words bigint, n_equal bigint, doc_start bigint, item_start bigint"
    found = verified.mapInArrow(_verify, schema)
    best = F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))
    found = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(best).alias("b"))
    return found.select(
        "doc_id", "text_key", "item_id", "b.n_words", "b.n_equal", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, least: int = SHORTEST) -> DataFrame:
    """The documents that overlap no benchmark item in at least that many words."""
    found = contaminated(documents, benchmark).where(F.col("n_words") >= least)
    hit = settle(found.select("doc_id", "text_key").distinct(), "contaminated").alias("h")
    d = packed(documents).alias("d")
    key = F.xxhash64(whole_text("d.row.text"))
    match = same(F.col("d.row.doc_id"), F.col("h.doc_id")) & (key == F.col("h.text_key"))
    return d.join(hit, match, "left_anti").select("row.*")
