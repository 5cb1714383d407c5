"""Compression of vectors to codes: a codebook for each part, entries found by Orchard's search.

A component x becomes the whole number floor(1024 x), so that all sums and distances are exact
and agree between runs, however the rows are dealt out. Vectors are cut into equal consecutive
parts; each part has a codebook of at most 256 entries, which starts as the parts of the
smallest ids. A round reads the vectors once: tasks assign their parts (``orchard``) and
return counts and sums per entry, at most 1,024 rows each however many vectors they hold; the
summed rows, one per entry, move the entries. Codebooks are all that the driver ever
holds, 256 entries of the width of a vector.

Defined cases: rows whose vector is null or holds a null or a number that is not finite are
dropped; a vector of another length than that of the smallest id, which no codebook
fits, stays with a null code and error; rows that repeat an id are rows of their own, ordered by
their vectors; a null id comes last; with fewer rows than entries the codebook is that
small; an empty table gives no rows. Lengths that do not divide by the number of parts are
cut as evenly as they go. Numbers beyond 2^21 are counted in Python's integers, slower. Columns
named ``code``, ``error`` or ``label_error`` are replaced, other columns are kept.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plaintide.llm.common import same
from plaintide.llm.orchard import ENTRIES, Codebook
from plaintide.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

PARTS = 4
ROUNDS = 4
SCALE = 1024
#: Bytes of vectors that a task assigns at a time.
_AT_ONCE = 16 << 20


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector can be coded."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(column).isNotNull() & F.coalesce(whole, F.lit(False)))


def _whole(batch: pa.ListArray, width: int) -> np.ndarray:
    """Rows of floor(1024 x)."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * SCALE).reshape(len(batch), width)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        return np.array([[int(x) for x in row] for row in scaled.tolist()], object)
    return scaled.astype(np.int64)


def edges(width: int, parts: int = PARTS) -> list[int]:
    return [width * p // parts for p in range(parts + 1)]


def _fits(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False) == width


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``_AT_ONCE`` bytes, so that more queries share a product."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("vector").nbytes
        if size >= _AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _largest(books: list[np.ndarray], rows: np.ndarray) -> int:
    return max([int(np.abs(x).max()) for x in (*books, rows) if x.size] or [0])


def _searchers(books: list[np.ndarray], rows: np.ndarray, known: dict) -> list[Codebook]:
    """Codebooks ready for rows of that size; built once for sizes up to a power of two."""
    bound = 1 << _largest(books, rows).bit_length()
    if bound not in known:
        known[bound] = [Codebook(book, bound) for book in books]
    return known[bound]


def _summing(books: list[np.ndarray], width: int):
    """Vectors to counts and sums per (part, entry)."""
    cuts = edges(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        counts = np.zeros((len(books), ENTRIES), np.int64)
        totals = np.zeros((ENTRIES, width), object)
        for batch in _together(batches):
            rows = _whole(batch.filter(pa.array(_fits(batch, width))).column("vector"), width)
            for p, searcher in enumerate(_searchers(books, rows, known)):
                own = rows[:, cuts[p] : cuts[p + 1]]
                code, _ = searcher.nearest(own)
                counts[p] += np.bincount(code, minlength=ENTRIES)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    totals[used, cuts[p] : cuts[p + 1]] += np.add.reduceat(own[order], first, axis=0)
        part, entry = np.nonzero(counts)
        sums = [totals[e, cuts[p] : cuts[p + 1]].tolist() for p, e in zip(part, entry)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array([[str(v) for v in s] for s in sums], pa.list_(pa.string()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def learn(vectors: DataFrame, column: str, key: str, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after the rounds: one array of entries (whole numbers) per part."""
    rows = usable(vectors, column).select(F.col(key).alias("key"), F.col(column).alias("vector"))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return []
    width = len(first[0].vector)
    rows = rows.where(F.size("vector") == width)
    start = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()
    whole = _whole(start.column("vector").combine_chunks(), width)
    cuts = edges(width, parts)
    books = [whole[:, a:b] for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        moved = rows.select("vector").mapInArrow(_summing(books, width), "part int, entry int, n bigint, sums array<string>")
        moved = moved.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
        moved = moved.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
        books = [book.copy() for book in books]
        for row in moved.collect():  # one row for each component of the codebooks
            value = int(row.total) // row.n
            if abs(value) >= 2**62 and books[row.part].dtype != object:
                books[row.part] = books[row.part].astype(object)
            books[row.part][row.entry, row["at"]] = value
    return books


def _coding(books: list[np.ndarray], width: int):
    """Rows (row, vector) to (row, code, error)."""
    cuts = edges(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in _together(batches):
            fits = _fits(batch, width)
            rows = _whole(batch.filter(pa.array(fits)).column("vector"), width)
            error = np.zeros(len(rows), np.int64)
            codes = np.zeros((len(rows), len(books)), np.uint8)
            for p, searcher in enumerate(_searchers(books, rows, known)):
                codes[:, p], distance = searcher.nearest(rows[:, cuts[p] : cuts[p + 1]])
                error += distance
            text = np.full(len(fits), None, object)
            text[fits] = [c.tobytes().hex() for c in codes]
            all_errors = np.zeros(len(fits), np.int64)
            all_errors[fits] = error
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(text, pa.string()), pa.array(all_errors, mask=~fits)], names=["row", "code", "error"]
            )

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], column: str) -> DataFrame:
    """The usable rows with ``code`` and ``error`` (squared distances summed over the parts)."""
    rows = usable(vectors.drop("code", "error"), column)
    if not books:
        return rows.select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    packed = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), F.col(column).alias("vector"))
    schema = StructType([packed.schema["row"], StructField("code", StringType()), StructField("error", LongType())])
    return packed.mapInArrow(_coding(books, sum(b.shape[1] for b in books)), schema).select("row.*", "code", "error")


def compressed(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """The coded rows with ``label_error``, the errors summed over equal labels, and the codebooks.

    A label may hold most rows: errors are summed in the tasks, and the sums joined, whose
    large side adaptive execution splits where they are not small.
    """
    vectors = vectors.drop("label_error")
    books = learn(vectors, column, key)
    coded = settle(encode(vectors, books, column), "codes")
    sums = coded.groupBy(F.col(label).alias("label")).agg(F.sum("error").alias("label_error")).alias("s")
    rows = coded.alias("c").join(sums, same(F.col(f"c.{label}"), F.col("s.label")), "left")
    return rows.select("c.*", "s.label_error"), books
