"""SimHash near-duplicates: fingerprints, links within a radius, connected components.

Fingerprints. A document's words, lower-cased in A-Z, give shingles; each is hashed to
64 bits, and a bit of the fingerprint is 1 if it is set in over half the hashes. The
text is read once; from there on rows are (id, 64 bits).

Links. Equal fingerprints collapse first, so copies cost one row. The 64 bits are cut
into ``radius + 3`` blocks: two fingerprints that differ in at most ``radius`` bits agree
in at least three of them, so every link falls into a bucket of some choice of three
blocks. Rows of a bucket are put into chunks of bounded size; every pair of chunks is a
unit of work of its own, so that a bucket of any size is spread and nothing is cut off.

Comparison. A task holds many units side by side as 64 bit planes. For a shift ``d`` it
compares row ``i`` with row ``i + d`` of all units at once: planes are xor-ed with
themselves shifted, and carry-save counters over the planes count the differing bits of
64 pairs per machine word. Once all pairs of a block have gone beyond the radius, the
block is abandoned. A unit returns a spanning forest of its links, never all pairs.

Similarity. For a similarity of shingles (Jaccard of their sets) the distance names only
candidates, with a radius that a pair at the similarity exceeds in a few of 10,000 cases; a
unit holds the shingles of its rows, and only pairs that have the similarity are merged.

Components. Stars on the smallest id: every vertex links its larger neighbours to its
smallest one, then its smaller neighbours to the smallest, in turn until nothing changes.
Each round is a written table; links are never collected.

Defined cases: a null or empty text has no words, and its fingerprint is zero, which is
linked like any other; fewer words than a shingle give one shingle of all of them; a row
without an id makes no links and takes the component of an equal fingerprint, if a named
document has it, else null; rows that repeat an id are one document in the links and rows
of their own in the result; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.common import WORD, packed, same, shuffle_tasks, whole_text
from plaintide.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

SEED = 42
WORDS = 4
RADIUS = 4
CHUNK = 2048
#: Rows that a task holds as bit planes at a time.
BLOCK_ROWS = 1 << 18
#: Shingle hashes that are counted at a time.
_PART = 1 << 15
#: Orders of shingles whose first one is a key; two documents of similarity s share none with probability (1 - s)^6.
_ORDERS = np.random.default_rng(3).integers(0, 2**63, 6, np.uint64) * np.uint64(2) + np.uint64(1)
SIMILARITY = 0.8
#: Share of the pairs at the similarity itself that may lie beyond the radius of candidates.
MISSED = 0.0005
#: Sets of fewer shingles are compared whatever their distance, whose spread is wider for them.
FEW = 64
#: Rows of a unit from which on a row with a link is compared with all others first.
SPREAD = 32
#: Bytes of shingles in a chunk, in the rows of a task at a time, and shingles of pairs that are compared at a time.
CHUNK_BYTES, BLOCK_BYTES, _PAIRED = 8 << 20, 32 << 20, 1 << 21


# --- fingerprints ------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    return sketch(text, words, _ORDERS[:0])[0]


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, part by part."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PART):
        pairs = zip(starts[at : min(n, at + _PART)].tolist(), last[at : at + _PART].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def _summed(parts: Iterator[np.ndarray], orders: np.ndarray) -> tuple[int, np.ndarray]:
    """The fingerprint of hashes, and the least one under each of the orders (all zero without hashes)."""
    least = np.full(len(orders), np.iinfo(np.uint64).max, np.uint64)
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        if len(orders):
            least = np.minimum(least, [(hashes * odd).min() for odd in orders])
        for shift in range(16):  # four counters of 16 bits to a word
            sums = int(np.bitwise_and(hashes >> np.uint64(shift), np.uint64(0x0001000100010001)).sum())
            for lane in range(4):
                counts[16 * lane + shift] += (sums >> (16 * lane)) & 0xFFFF
    if not n:
        return 0, np.zeros(len(orders), np.uint64)
    bits = np.where(2 * counts > n, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))
    return int(np.bitwise_or.reduce(bits)), least


def sketch(text: str | None, words: int = WORDS, orders: np.ndarray = _ORDERS) -> tuple[int, np.ndarray]:
    """The fingerprint, and the least shingle hash under each of the orders (all zero without words)."""
    return _summed(_hashes(text, words), orders)


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of the shingles as a set, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashes(text, words)]))


def set_sketch(text: str | None, words: int) -> tuple[int, int, np.ndarray]:
    """Of the set of shingles: the fingerprint, a hash of the set, and the least hash under each of the orders."""
    held = distinct_shingles(text, words)
    fp, least = _summed((held[at : at + _PART] for at in range(0, len(held), _PART)), _ORDERS)
    return fp, xxhash.xxh64_intdigest(held.tobytes(), SEED), least


def with_fingerprint(documents: DataFrame, words: int = WORDS, column: str = "fp") -> DataFrame:
    """The documents and their fingerprint as a signed 64-bit number."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
        return pd.Series(prints.view(np.int64))

    return documents.withColumn(column, of(F.col("text")))


def candidate_radius(similarity: float, missed: float = MISSED) -> int:
    """Bits beyond which no more than that share of the pairs of the similarity differ, if bits differ independently."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    beyond, radius = 1.0, -1
    while beyond > missed and radius < 64:
        radius += 1
        beyond -= math.comb(64, radius) * p**radius * (1 - p) ** (64 - radius)
    return radius


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links ---------------------------------------------------------------------------------------


def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks of every choice of three of the ``radius + 3`` blocks, as signed numbers."""
    edges = np.linspace(0, 64, radius + 4).round().astype(int).tolist()
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit ``i`` of row ``b`` is bit ``b`` of fingerprint ``i``."""
    padded = np.zeros(-(-len(fps) // 64) * 64 + 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within_radius(planes: np.ndarray, by: int, radius: int, live: np.ndarray) -> np.ndarray:
    """Bits of the rows ``i`` in ``live`` whose row ``i + by`` differs in at most ``radius`` bits.

    Counters of weight 1, 2 and 4 take up the differences of eight planes at a time; what
    overflows them, or exceeds the radius, stays marked as beyond. Words in which no pair is
    left are dropped on the way.
    """
    result = np.zeros_like(live)
    chosen = np.flatnonzero(live)
    skip, rest = divmod(by, 64)
    end = planes.shape[1] - 1
    low = np.zeros((radius.bit_length(), len(chosen)), np.uint64)
    beyond = ~live[chosen]
    for first in range(0, 64, 8):
        mine = planes[first : first + 8]
        other = mine[:, np.minimum(chosen + skip, end)] >> np.uint64(rest)
        if rest:
            other |= mine[:, np.minimum(chosen + skip + 1, end)] << np.uint64(64 - rest)
        other ^= mine[:, chosen]
        for carry in other:
            for level in range(len(low)):
                carry, low[level] = low[level] & carry, low[level] ^ carry
            beyond |= carry
        beyond |= _above(low, radius)
        alive = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not alive.any():
            return result
        if alive.mean() < 0.5:
            chosen, beyond, low = chosen[alive], beyond[alive], low[:, alive]
    result[chosen] = ~beyond
    return result


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Bits whose counter exceeds the radius."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            equal = equal & counter[level]
        else:
            above, equal = above | (equal & counter[level]), equal & ~counter[level]
    return above


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of rows a and b; a label is the smallest row of its component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


class _Shingles:
    """The sets of shingles of rows, and which pairs of rows have the similarity."""

    def __init__(self, sets: list[bytes], similarity: float):
        self.flat = np.frombuffer(b"".join(sets), np.uint32)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets)) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.few = self.sizes < FEW
        self.similarity = similarity

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """The shingles of rows, below the number of the row in the list."""
        sizes = self.sizes[rows]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - first, sizes)
        return np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(32), sizes) | self.flat[at]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a and b have at least the similarity."""
        s, x, y = self.similarity, self.sizes[a], self.sizes[b]
        result = np.minimum(x, y) >= s * np.maximum(x, y) - 1e-9
        left = np.flatnonzero(result)
        part = np.cumsum(x[left] + y[left]) // _PAIRED
        for own in np.split(left, np.flatnonzero(np.diff(part)) + 1):
            keys = np.sort(np.concatenate((self._keys(a[own]), self._keys(b[own]))), kind="stable")
            common = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(own))
            result[own] = common * (1 + s) >= s * (x[own] + y[own]) - 1e-9
        return result


def spanning_links(unit: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int, shingles: _Shingles | None = None) -> np.ndarray:
    """Component label of every row, from links inside its unit.

    Rows of a unit stand together. Where ``side`` is 1 and 2 only pairs across the sides
    count, where it is 0 all pairs do. With shingles, pairs must have their similarity too.
    """
    label = np.arange(len(unit))
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(unit)])))
    size_of = np.repeat(sizes, sizes)
    place = np.arange(len(unit)) - np.repeat(starts, sizes)
    tried = np.zeros(len(unit), bool)

    def spread(ends: np.ndarray) -> None:
        """Compare rows that have a link with all others of their unit at once.

        Copies are mostly like one text and less like each other: once that text is found, all its copies are linked,
        and pairs of them need no comparison.
        """
        for e in ends.tolist():
            low, high = e - place[e], e - place[e] + size_of[e]
            tried[e] = True
            other = low + np.flatnonzero(label[low:high] != label[e])
            other = other[(side[other] == 0) | (side[other] != side[e])]
            near = (np.bitwise_count(fps[other] ^ fps[e]) <= radius) | (shingles.few[other] & shingles.few[e])
            other = other[near]
            if len(other):
                same_text = np.full(len(other), e)
                like = shingles.alike(same_text, other)
                _merge(label, same_text[like], other[like])

    least = 1
    while least < (sizes.max() if len(sizes) else 0):
        # Units of similar size are compared together, so that a shift is of use to most rows.
        rows = np.flatnonzero((size_of > least) & (size_of <= 2 * least))
        if len(rows):
            own, own_place, own_size, own_side = fps[rows], place[rows], size_of[rows], side[rows]
            planes = _planes(own)
            for by in range(1, 2 * least):
                pair = own_place + by < own_size
                if not pair.any():
                    break
                ahead = np.minimum(np.arange(len(rows)) + by, len(rows) - 1)
                pair &= (own_side == 0) | (own_side != own_side[ahead])
                linked = label[rows] != label[rows[ahead]]
                pair &= linked
                if not pair.any():
                    continue
                live = np.zeros(planes.shape[1] * 8, np.uint8)
                packed = np.packbits(pair, bitorder="little")
                live[: len(packed)] = packed
                hits = within_radius(planes, by, radius, live.view(np.uint64))
                found = np.unpackbits(hits.view(np.uint8), bitorder="little")[: len(rows)].view(bool)
                if shingles is not None:
                    found |= pair & shingles.few[rows] & shingles.few[rows[ahead]]
                found = np.flatnonzero(found)
                if shingles is not None and len(found):
                    found = found[shingles.alike(rows[found], rows[found + by])]
                if len(found):
                    _merge(label, rows[found], rows[found + by])
                    if shingles is not None and least >= SPREAD:
                        ends = np.unique(np.concatenate((rows[found], rows[found + by])))
                        spread(ends[~tried[ends]])
        least *= 2
    return label


def _link_units(radius: int, similarity: float | None = None):
    """Rows of (bucket, lo, hi, side, fp, id), sorted by unit, to rows of links (a, b); with a similarity also of (shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = size = 0

        def links(frame: pd.DataFrame) -> pa.RecordBatch:
            change = np.zeros(len(frame), bool)
            for c in ("mask", "bucket", "lo", "hi"):
                v = frame[c].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            shingles = None if similarity is None else _Shingles(frame["shingles"].tolist(), similarity)
            label = spanning_links(np.cumsum(change), frame["side"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), radius, shingles)
            ids = frame["id"].to_numpy()
            far = np.flatnonzero(label != np.arange(len(label)))
            a, b = ids[far], ids[label[far]]
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        def key(frame: pd.DataFrame, at: int) -> tuple:
            return tuple(frame[c].iat[at] for c in ("mask", "bucket", "lo", "hi"))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.to_pandas())
            rows += batch.num_rows
            size += batch.nbytes
            if rows < BLOCK_ROWS and (similarity is None or size < BLOCK_BYTES):
                continue
            frame = pd.concat(held, ignore_index=True)
            last = np.ones(len(frame), bool)  # the last unit may go on in the next batch
            for c, v in zip(("mask", "bucket", "lo", "hi"), key(frame, -1)):
                last &= frame[c].to_numpy() == v
            yield links(frame[~last].reset_index(drop=True))
            held, rows, size = [frame[last]], int(last.sum()), 0
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return run


def links(vertices: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b), a < b, that connect whatever lies within the radius.

    ``vertices`` has distinct ids and distinct fingerprints (id, fp).
    """
    masks = F.array(*[F.lit(m) for m in block_masks(radius)])
    rows = vertices.select("id", "fp", F.posexplode(masks).alias("mask", "bits"))
    return links_in_buckets(rows.select("id", "fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("bucket")), radius, chunk)


def links_in_buckets(rows: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links that connect what lies within the radius and shares a bucket: rows (id, fp, mask, bucket)."""
    tasks = shuffle_tasks(rows.sparkSession)
    rows = settle(rows, "simhash-keys")
    sizes = rows.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = rows.join(sizes, ["mask", "bucket"]).withColumn("part", _part(parts)).withColumn("other", _others(parts))
    ordered = _in_units(rows.select("id", "fp", "mask", "bucket", "part", F.explode("other").alias("other")), tasks, [])
    return ordered.mapInArrow(_link_units(radius), "a bigint, b bigint").distinct()


def _part(parts: Column) -> Column:
    """A bucket beyond a chunk is cut by a hash of the id into k parts; unit (i, j) compares part i with part j."""
    return F.when(parts > 1, F.pmod(F.xxhash64("id"), parts)).otherwise(0).cast("int")


def _others(parts: Column) -> Column:
    return F.sequence(F.lit(0), parts - 1)


def _in_units(rows: DataFrame, tasks: int, more: list[str]) -> DataFrame:
    """Rows (id, fp, mask, bucket, part, other) sorted by unit."""
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    rows = rows.select(
        "mask", "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
        side.cast("int").alias("side"), "fp", "id", *more,
    )
    unit = ["mask", "bucket", "lo", "hi"]
    return rows.repartition(tasks, *unit).sortWithinPartitions(*unit, "id")


def similar_links(documents: DataFrame, vertices: DataFrame, words: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Links that connect what has the similarity and shares a least shingle: vertices (id, text_hash, fp, n, fresh, least).

    Only where a bucket holds several vertices, and a fresh one among them, their texts are read again, for the shingles.
    """

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(distinct_shingles(t, words).astype(np.uint32)).tobytes() for t in texts])

    tasks = shuffle_tasks(documents.sparkSession)
    keys = settle(vertices.select("id", "text_hash", "fp", "n", "fresh", F.posexplode("least").alias("mask", "bucket")), "simhash-keys")
    sizes = keys.groupBy("mask", "bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("n_all"), F.max("fresh").alias("any_fresh"))
    sizes = sizes.where("rows > 1 AND any_fresh")
    parts = F.ceil(F.greatest(F.col("rows") / chunk, 4 * F.col("n_all") / CHUNK_BYTES)).cast("int")
    keys = keys.drop("n").join(sizes, ["mask", "bucket"])
    keys = keys.select("id", "text_hash", "fp", F.struct("mask", "bucket", _part(parts).alias("part"), parts.alias("parts")).alias("key"))
    shared = settle(keys.groupBy("id", "text_hash", "fp").agg(F.collect_list("key").alias("keys")), "simhash-shared").alias("v")
    d = documents.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text")).alias("d")
    rows = d.join(shared, (F.col("d.doc_id") == F.col("v.id")) & (F.col("d.text_hash") == F.col("v.text_hash")))
    rows = rows.select("v.id", "v.text_hash", "fp", "keys", "text").dropDuplicates(["id", "text_hash"])
    rows = rows.select("id", "fp", "keys", shingles("text").alias("shingles")).select("id", "fp", "shingles", F.inline("keys"))
    rows = rows.withColumn("other", F.explode(_others(F.col("parts"))))
    ordered = _in_units(rows, tasks, ["shingles"])
    return ordered.mapInArrow(_link_units(candidate_radius(similarity), similarity), "a bigint, b bigint").distinct()


# --- components ------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (a, b): root is the smallest id it can reach."""
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours of a vertex move to its smallest one.
        large = both.where("b > a").join(least, "a").select(F.col("b"), F.col("m").alias("a")).where("a <> b").distinct()
        # Then a vertex and its smaller neighbours move to the smallest of those.
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(smallest, "b")
        small = joined.select(F.col("a").alias("b"), F.col("m").alias("a")).union(joined.select("b", F.col("m").alias("a")))
        following = settle(small.where("a <> b").distinct(), "edges")
        # Done when every edge points to a root, and every vertex to one root only.
        inner = following.join(following.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        torn = following.groupBy("b").count().where("count > 1")
        if inner.isEmpty() and torn.isEmpty():
            break
        edges = following
    roots = following.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    return following.select(F.col("b").alias("id"), F.col("a").alias("root")).union(roots)


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest id it can reach."""
    prints = settle(with_fingerprint(documents.select("doc_id", "text"), words).select("doc_id", "fp"), "simhash")
    vertices = prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL")
    vertices = settle(vertices, "simhash-vertices")
    return _named(prints, vertices, links(vertices, radius), ["fp"]).select("doc_id", "fp", "component_id")


def sketched(documents: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, text_hash, n, fp, shape, least) of the sets of shingles, written down."""

    @F.pandas_udf("fp bigint, shape bigint, least array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        made = [set_sketch(t, words) for t in texts]
        prints, shapes = (np.fromiter((m[i] for m in made), np.uint64, len(made)).view(np.int64) for i in (0, 1))
        return pd.DataFrame({"fp": prints, "shape": shapes, "least": [m[2].view(np.int64) for m in made]})

    n_words = F.regexp_count(F.col("text"), F.lit(WORD))
    hashed = documents.select("doc_id", whole_text().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), n_words.cast("bigint").alias("n"), of(F.col("text")).alias("s")
    )
    return settle(hashed.select("doc_id", "text_hash", "n", "s.*"), "simhash")


def similar_documents(documents: DataFrame, words: int = 5, similarity: float = SIMILARITY, prints: DataFrame | None = None) -> DataFrame:
    """The same, and text_hash, for a similarity of shingle sets, whose radius is too wide for blocks of bits.

    Documents of equal sets are one vertex. Others are compared where they share the first
    shingle of one of six orders, which similar ones do; the bit-sliced distance names the
    candidates, and their shingles decide. With ``prints``, sketches of the documents that have
    a column ``fresh``, documents that are not fresh are known to be unlike each other.
    """
    prints = sketched(documents, words).withColumn("fresh", F.lit(True)) if prints is None else prints
    least = [F.min(F.get("least", F.lit(i))).alias(f"l{i}") for i in range(len(_ORDERS))]
    first = F.min(F.struct(F.col("doc_id").alias("id"), "text_hash", "n")).alias("first")
    vertices = prints.where("doc_id IS NOT NULL").groupBy("fp", "shape").agg(first, F.max("fresh").alias("fresh"), *least)
    vertices = vertices.select("fp", "shape", "fresh", "first.*", F.array(*[f"l{i}" for i in range(len(_ORDERS))]).alias("least"))
    vertices = settle(vertices, "simhash-vertices")
    found = similar_links(documents, vertices, words, similarity)
    return _named(prints.select("doc_id", "text_hash", "fp", "shape"), vertices, found, ["fp", "shape"]).drop("shape")


def _named(prints: DataFrame, vertices: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Documents with the component of their vertex."""
    roots = components(found)
    named = vertices.join(roots, "id", "left").select(*by, F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, by, "left")


def keep_one(documents: DataFrame, words: int = 5, similarity: float = SIMILARITY, originals: DataFrame | None = None) -> DataFrame:
    """The documents that stay: the smallest id of every component.

    Of rows that repeat this id, the one with the smallest text hash stays. A row without an
    id stays unless another such row has its text hash or a named document its shingles.
    Documents without words are alike, and one of them stays. Extra columns of any name are kept.

    ``originals`` (doc_id, text) are the documents as they were before an earlier stage cut
    them. Documents are then compared as they were first, and what stays as it is now: copies
    whose common lines have gone from all but one are found like others. A repeated id goes
    in the first step only if all its originals go; an id without an original stays in it.
    """
    if originals is None:
        return _kept(documents, similar_documents(documents, words, similarity))
    d, o = packed(documents).alias("d"), originals.select("doc_id", whole_text().alias("text")).alias("o")
    before = o.join(documents.select("doc_id").distinct().alias("i"), F.col("o.doc_id") == F.col("i.doc_id"), "left_semi")
    first = sketched(before, words)
    classes = similar_documents(before, words, similarity, first.withColumn("fresh", F.lit(True)))
    gone = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    gone = settle(gone.select("doc_id"), "like-originals").alias("g")
    left = d.join(gone, F.col("d.row.doc_id") == F.col("g.doc_id"), "left_anti").select("row.*")
    # What is left is sketched again only where the text is no longer that of the original.
    now = left.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    as_before = first.withColumn("fresh", F.lit(False)).dropDuplicates(["doc_id", "text_hash"])
    same_text = as_before.join(now.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")
    changed = now.join(as_before.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
    prints = same_text.unionByName(sketched(changed, words).withColumn("fresh", F.lit(True)))
    return _kept(left, similar_documents(left, words, similarity, settle(prints, "simhash-now")))


def _kept(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents whose id is that of their class, once each."""
    # Rows without an id are told apart by their text.
    text = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("text_hash")
    kept = settle(classes.where(same(F.col("doc_id"), F.col("component_id"))).select("doc_id", text).distinct(), "kept").alias("k")
    d = packed(documents).withColumn("hash", F.xxhash64(whole_text("row.text"))).alias("d")
    own = F.when(F.col("d.row.doc_id").isNull(), F.col("d.hash"))
    rows = d.join(kept, same(F.col("d.row.doc_id"), F.col("k.doc_id")) & same(own, F.col("k.text_hash")), "left_semi")
    one = Window.partitionBy("row.doc_id", F.when(F.col("row.doc_id").isNull(), F.col("hash"))).orderBy("hash")
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
