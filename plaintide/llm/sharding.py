"""Sharding by histogram sort: shards of near equal bytes from exact counts below key boundaries.

Order. Documents are put in the order of a hash of their text, then a hash of their id:
copies stand side by side, and neither a source nor a group of copies stays in one
place that ids alone would give it. The key columns are written once; texts are read
for that and not again.

Splitters. The boundary between two shards should lie where the bytes below it are a whole
number of shard sizes. Each round counts the exact bytes, over all partitions, below 256
evenly spaced probes inside every interval that holds a wanted boundary, and keeps the one
cell that does; a round sends 256 sums per open interval to the driver, at most 255 times
the number of shards, whatever the input. A boundary is settled at a probe that meets
the tolerance (a share of a shard), or at the nearer end of a single document. An interval of one
text goes on in the hashes of the ids, so only a group of copies beyond the tolerance is
ever cut; rows that repeat both go on in a number written down with the row.

Exchange. A row compares its key with the splitters in place, so nothing moves before the
one exchange, which is by cells of the order inside a shard. A cell beyond ``CELL_ROWS`` (a
large group of copies) is cut by the hash of the ids. Slots are the place in the cell after
the rows of the cells before; no shard passes through one task.

Defined cases: a null text is empty and has size 8; a null id is an id; rows that repeat
an id and a text are rows of their own with slots of their own; a document above the size
of a shard fills one, and its neighbours may stay empty; an empty table gives no rows.
Columns that ``shards`` adds replace input columns of their names; other columns of the
input are kept by ``write_shards`` alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.common import whole_text
from plaintide.session import settle

SHARDS = 24
OVERHEAD = 8
#: Bytes by which a boundary may be off, as a share of a shard.
TOLERANCE = 0.001
#: Bits that a round of probes adds to a boundary.
STEP = 8
#: Rows from which on a cell of the order is cut further.
CELL_ROWS = 1 << 20

_LEVELS = ("text_key", "id_key", "row_key")
_LOWEST = -(1 << 63)
_WIDTH = 64 * len(_LEVELS)


def sizes(documents: DataFrame) -> DataFrame:
    """Rows of doc_id, size, text_crc32 and the three parts of the key."""
    text = whole_text()
    return documents.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64("doc_id").alias("id_key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row_key"),
    )


@dataclass(frozen=True)
class _Interval:
    """Keys whose first ``depth`` bits are ``start``; ``below`` bytes lie before them."""

    start: int
    depth: int
    below: int

    def holds(self) -> Column:
        tests = [F.lit(True)]
        for i, name in enumerate(_LEVELS):
            bits = min(max(self.depth - 64 * i, 0), 64)
            if bits:
                part = (self.start >> (self.depth - 64 * i - bits)) & ((1 << bits) - 1)
                tests.append(_top_bits(F.col(name), bits) == _signed_low(part, bits))
        return reduce(lambda a, b: a & b, tests)

    def cell(self) -> Column:
        """The next bits of a key inside."""
        level, used = divmod(self.depth, 64)
        return _top_bits(F.col(_LEVELS[level]), used + STEP).bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")


def _top_bits(key: Column, bits: int) -> Column:
    """The first bits of a key, whose signed order is that of the bits."""
    flipped = key.bitwiseXOR(F.lit(_LOWEST))
    return flipped if bits == 64 else F.shiftrightunsigned(flipped, 64 - bits)


def _signed_low(part: int, bits: int) -> int:
    return part - (1 << 64) if bits == 64 and part >> 63 else part


def _histogram(keys: DataFrame, intervals: list[_Interval]) -> dict[int, list]:
    """Exact bytes and rows of every probed cell of every interval, in order."""
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, interval in enumerate(intervals):
        inside = interval.holds()
        which, cell = F.when(inside, i).otherwise(which), F.when(inside, interval.cell()).otherwise(cell)
    spans = [f(name).alias(f"{f.__name__}_{name}") for name in _LEVELS for f in (F.min, F.max)]
    counted = (
        keys.withColumns({"_which": which, "_cell": cell})
        .where("_which IS NOT NULL")
        .groupBy("_which", "_cell")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"), *spans)
    )
    found: dict[int, list] = {}
    for row in counted.collect():  # at most 2**STEP cells for each interval
        found.setdefault(row["_which"], []).append(row)
    return {which: sorted(rows, key=lambda row: row["_cell"]) for which, rows in found.items()}


def _narrowed(interval: _Interval, row, below: int) -> _Interval:
    """The interval of a cell, with all further bits that its keys have in common by level."""
    depth = interval.depth + STEP
    start = (interval.start << STEP) | row["_cell"]
    level = (depth - 1) // 64
    while level < len(_LEVELS) and row[f"min_{_LEVELS[level]}"] == row[f"max_{_LEVELS[level]}"]:
        whole = row[f"min_{_LEVELS[level]}"] - _LOWEST
        start, depth = ((start >> (depth - 64 * level)) << 64) | whole, 64 * (level + 1)
        level += 1
    return _Interval(start, depth, below)


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """The keys, as numbers of 192 bits, at which the second and all further shards begin."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = {k: _Interval(0, 0, 0) for k in range(1, shards)} if total else {}
    settled: dict[int, int] = {}
    while wanted:
        intervals = list(dict.fromkeys(wanted.values()))
        cells = _histogram(keys, intervals)
        for k, interval in list(wanted.items()):
            below, target = interval.below, total * k / shards
            for row in cells[intervals.index(interval)]:
                if target <= below + row["bytes"]:
                    break
                below += row["bytes"]
            start = (interval.start << STEP) | row["_cell"]
            rest = _WIDTH - interval.depth - STEP
            before, behind = target - below, below + row["bytes"] - target
            inner = _narrowed(interval, row, below)
            near = min(before, behind) <= tolerance * total / shards
            if near or row["n_rows"] == 1 or inner.depth >= _WIDTH:
                settled[k] = (start if before <= behind else start + 1) << rest
                del wanted[k]
            else:
                wanted[k] = inner
    return [settled[k] for k in sorted(settled)]


def _reaches(boundary: int) -> Column:
    """Whether a key is the boundary or behind it."""
    if boundary >> _WIDTH:
        return F.lit(False)
    reached = None  # None: whatever the parts that follow are
    for i, name in enumerate(reversed(_LEVELS)):
        part = ((boundary >> (64 * i)) & ((1 << 64) - 1)) + _LOWEST
        key = F.col(name)
        if reached is not None:
            reached = (key > part) | ((key == part) & reached)
        elif part > _LOWEST:
            reached = key >= part
    return F.lit(True) if reached is None else reached


def shard_of(boundaries: list[int]) -> Column:
    """The shard of a row from the parts of its key."""
    return reduce(lambda a, b: a + b, [_reaches(b).cast("int") for b in boundaries], F.lit(0))


def _cell_bits(rows: int, cell_rows: int) -> int:
    return min(max((rows // cell_rows).bit_length(), 1), 24)


def _cut(placed: DataFrame, stretch: list[str], key: str, part: str, cell_rows: int) -> DataFrame:
    """Rows with ``part``: a stretch of too many rows is cut by the first bits of a key, others are not."""
    held = placed.groupBy(*stretch).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    crowded = settle(held.select(*stretch, F.ceil(F.log2(F.col("n") / cell_rows)).cast("int").alias("bits")), "crowded")
    if crowded.isEmpty():
        return placed.withColumn(part, F.lit(0).cast("bigint"))
    cut = F.expr("coalesce(shiftrightunsigned(_bits_of, 64 - bits), 0L)")
    flipped = F.col(key).bitwiseXOR(F.lit(_LOWEST))
    return placed.join(crowded, stretch, "left").withColumn("_bits_of", flipped).withColumn(part, cut).drop("_bits_of", "bits")


def shards(documents: DataFrame, count: int = SHARDS, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, and slot, its place in the shard from 0."""
    keys = settle(sizes(documents), "shard-keys")
    placed = keys.withColumn("shard", shard_of(splitters(keys, count, tolerance)))
    placed = placed.withColumn("cell", _top_bits(F.col("text_key"), _cell_bits(keys.count(), cell_rows)))
    # Copies of a text are cut by their ids, and rows that repeat both by the number written down.
    placed = _cut(placed, ["shard", "cell"], "id_key", "part", cell_rows)
    placed = _cut(placed, ["shard", "cell", "part"], "row_key", "rest", cell_rows)
    stretch = ["shard", "cell", "part", "rest"]
    ahead = Window.partitionBy("shard").orderBy(*stretch[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*stretch).agg(F.count("*").alias("n"))
    offsets = offsets.select(*stretch, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*stretch).orderBy(*_LEVELS)
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, stretch).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("bigint").alias("slot")
    )


def write_shards(documents: DataFrame, path: str, count: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """The documents as Parquet, a folder ``shard=k`` for each shard; files hold stretches of the order.

    A column ``shard`` of the input is replaced.
    """
    keys = settle(sizes(documents), "shard-keys")
    own = F.struct(*[F.col(c) for c in documents.columns if c != "shard"]).alias("row")
    placed = documents.select(own).select(
        "row", F.xxhash64(whole_text("row.text")).alias("text_key"), F.xxhash64("row.doc_id").alias("id_key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row_key"),
    )
    placed = placed.withColumn("shard", shard_of(splitters(keys, count, tolerance)))
    cell = _top_bits(F.col("text_key"), _cell_bits(keys.count(), CELL_ROWS))
    spread = placed.repartition("shard", cell, F.pmod("id_key", F.lit(16)))
    spread.sortWithinPartitions("shard", *_LEVELS).select("row.*", "shard").write.partitionBy("shard").parquet(path)
