"""Document fingerprints: a homomorphic multiset hash of the paragraphs.

A document is the multiset of its lines. Every line has a wide vector, and a document's
vector is the sum of those of its lines, lane by lane modulo 2**32. Order does not matter,
and a line is added to or taken from a fingerprint without reading the rest (``add``,
``remove``).

Eight lanes are hashes of the whole line; they tell multisets apart. 128 more lanes hold
what the line's pieces of at most 32 characters contribute: each piece adds one hash bit
per lane, and one lane counts pieces. Twice a bit lane minus the count is a sum of random
signs, so the cosine of two such vectors estimates how much of the text two documents
share, whatever their lengths.

The sums are plain aggregates over exploded lines and pieces. Edited texts need the
document that follows in descending order of the id: documents are range-cut at exact
quantiles of the id, the first document of a cut is lent to the cut above it, and one
window per cut finds neighbours; the same exchange serves the aggregates.

Defined cases: null text is the empty text, one empty line; rows that repeat an id follow
each other in the order of their texts; after a null id follows the document with the
largest one; a document without any other, or among null ids only, follows itself; an empty table gives no rows; likeness is 1 for equal fingerprints, 0 where one
side has no piece. Columns other than id and text are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.common import shuffle_tasks, whole_text

HASHES = 4
PIECE_HASHES = 2
PIECE = 32
#: 32 words of two counters of 32 bits hold the 64 bit counts of a hash.
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF
CUTS_PER_TASK = 4


def elements(text: Column) -> Column:
    """Lines, marked by a leading line break, and pieces of lines, which have none."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.concat(F.lit("\n"), line))
    pieces = F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.concat(lines, pieces)


def _sums(element: Column) -> list[Column]:
    """Aggregates over the elements of one text, two lanes of 32 bits to a word."""
    is_line = element.startswith("\n")
    sums = []
    for k in range(HASHES):
        h = F.xxhash64(F.lit(f"line {k}"), element)
        sums.append(F.sum(F.when(is_line, h.bitwiseAND(F.lit(_LOW))).otherwise(0)))
        sums.append(F.sum(F.when(is_line, F.shiftrightunsigned(h, 32)).otherwise(0)))
    sums.append(F.sum(F.when(is_line, 0).otherwise(1)).cast("bigint"))
    for k in range(PIECE_HASHES):
        h = F.when(~is_line, F.xxhash64(F.lit(f"piece {k}"), element))
        sums += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))) for i in range(32)]
    return sums


def _lanes(words: list[Column]) -> Column:
    """Sums to the vector: 8 line lanes, the piece count, the bit lanes, each modulo 2**32."""
    whole = [F.coalesce(w, F.lit(0)).bitwiseAND(F.lit(_LOW)) for w in words[: 2 * HASHES + 1]]
    pairs = F.array(*[F.coalesce(w, F.lit(0)) for w in words[2 * HASHES + 1 :]])
    low = F.transform(pairs, lambda w: w.bitwiseAND(F.lit(_LOW)))
    high = F.transform(pairs, lambda w: F.shiftrightunsigned(w, 32))
    return F.concat(F.array(*whole), low, high)


def add(left: Column, right: Column) -> Column:
    """The fingerprint vector of two multisets together."""
    return F.zip_with(left, right, lambda a, b: (a + b).bitwiseAND(F.lit(_LOW)))


def remove(whole: Column, part: Column) -> Column:
    """The fingerprint vector of what is left when ``part`` is taken out."""
    return F.zip_with(whole, part, lambda a, b: (a - b).bitwiseAND(F.lit(_LOW)))


def as_text(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def _signs(lanes: Column) -> Column:
    """The bit lanes as sums of random signs."""
    count = F.get(lanes, F.lit(2 * HASHES))
    bits = F.slice(lanes, 2 * HASHES + 2, 64 * PIECE_HASHES)
    return F.transform(bits, lambda v: (2 * v - count).cast("double"))


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def likeness(left: Column, right: Column, left_signs: Column, right_signs: Column, left_square: Column, right_square: Column) -> Column:
    """0 to 1: the cosine of the piece counts, estimated from the lanes."""
    scale = F.sqrt(left_square * right_square)
    cosine = F.when(scale > 0, _dot(left_signs, right_signs) / scale).otherwise(0.0)
    return F.when(left == right, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(documents: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per distinct value of ``keys``: the vector of all its texts together."""
    rows = documents.select(*keys, F.explode(elements(whole_text(text))).alias("_element"))
    sums = [s.alias(f"_s{i}") for i, s in enumerate(_sums(F.col("_element")))]
    words = [F.col(f"_s{i}") for i in range(len(sums))]
    return rows.groupBy(*keys).agg(*sums).select(*keys, _lanes(words).alias("lanes"))


def _in_cuts(documents: DataFrame, cuts: int) -> tuple[DataFrame, bool]:
    """Rows (cut, lent, doc_id, text), and whether there are null ids.

    Cut ``k`` holds the ids above bound ``k - 1`` up to bound ``k``. Bounds are ids of the
    table, so the first document of a cut, in descending order, is its upper bound: its rows
    are lent to the next cut, the largest id to the lowest one. Documents without an id are
    dealt by hash to cuts of their own, each with the rows of the largest id. As many bounds
    as there are cuts reach the driver, as for any range partitioning.
    """
    shares = [i / cuts for i in range(1, cuts)] or [0.5]
    seen = documents.agg(
        F.percentile_approx("doc_id", shares, 10_000).alias("bounds"), F.max("doc_id").alias("top"),
        F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)).alias("nulls"),
    ).first()
    rows = documents.select("doc_id", whole_text().alias("text"))
    bounds = sorted({int(b) for b in seen.bounds or []})
    if not bounds:
        deal = F.pmod(F.xxhash64("text"), F.lit(cuts)).cast("int")
        return rows.select((-1 - deal).alias("cut"), F.lit(False).alias("lent"), "doc_id", "text"), seen.nulls
    # Two steps find the cut: among every ``step``-th bound, then among the bounds in between.
    step = max(1, int(len(bounds) ** 0.5))
    every = F.expr("array(%s)" % ",".join(f"{b}L" for b in bounds))
    coarse = F.expr("array(%s)" % ",".join(f"{b}L" for b in bounds[step - 1 :: step]))
    rows = rows.withColumn("block", F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * step)
    inside = F.slice(every, F.col("block") + 1, F.lit(step))
    own = F.col("block") + F.size(F.filter(inside, lambda b: b < F.col("doc_id")))
    hidden = -1 - F.pmod(F.xxhash64("text"), F.lit(cuts)).cast("int")
    rows = rows.withColumn("own", F.when(F.col("doc_id").isNull(), hidden).otherwise(own))
    is_bound = F.get(every, F.col("own")) == F.col("doc_id")
    wrapped = F.array(F.lit(0), *[F.lit(-1 - i) for i in range(cuts) if seen.nulls])
    lent = F.concat(
        F.when(is_bound & (F.col("own") >= 0), F.array(F.col("own") + 1)).otherwise(F.expr("cast(array() AS array<int>)")),
        F.when(F.col("doc_id") == seen.top, wrapped).otherwise(F.expr("cast(array() AS array<int>)")),
    )
    places = F.concat(
        F.array(F.struct(F.col("own").alias("cut"), F.lit(False).alias("lent"))),
        F.transform(lent, lambda c: F.struct(c.alias("cut"), F.lit(True).alias("lent"))),
    )
    return rows.select(F.inline(places).alias("cut", "lent"), "doc_id", "text"), seen.nulls


def compare_neighbours(documents: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them and neighbours.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first
    as many of the document that follows in descending order of the id; after the last
    document follows the first, after one without an id the first too.
    """
    rows, nulls = _in_cuts(documents, CUTS_PER_TASK * shuffle_tasks(documents.sparkSession))
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy("cut").orderBy("lent", F.col("doc_id").desc(), "text")
    following = F.lead("text").over(order)
    if nulls:
        alone = F.last(F.when(F.col("lent"), F.col("text")), ignorenulls=True).over(order.rowsBetween(*whole))
        following = F.when(F.col("cut") < 0, alone).otherwise(following)
    rows = rows.select("*", F.row_number().over(order).alias("n"), F.coalesce(following, F.col("text")).alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    rows = rows.select("cut", "n", "lent", "doc_id", "text", F.when(~F.col("lent"), edited).alias("edited"))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.filter(F.array("text", "edited"), lambda t: t.isNotNull())
    rows = rows.select("cut", "n", "lent", "doc_id", "n_chars", "edited_sha256", F.posexplode(both).alias("which", "text"))
    keys = ["cut", "n", "which", "lent", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(rows, *keys).withColumn("signs", _signs(F.col("lanes")))
    prints = prints.withColumn("square", _dot(F.col("signs"), F.col("signs")))
    # Text and edited text of a document stand next to each other, then the next text.
    order = Window.partitionBy("cut").orderBy("n", "which")
    own = F.struct("lanes", "signs", "square")
    after = F.lead(own, 2).over(order)
    if nulls:
        alone = F.last(F.when(F.col("lent"), own), ignorenulls=True).over(order.rowsBetween(*whole))
        after = F.when(F.col("cut") < 0, alone).otherwise(after)
    prints = prints.select("*", F.lead(own, 1).over(order).alias("e"), after.alias("f"))
    prints = prints.where((F.col("which") == 0) & ~F.col("lent"))

    def near(other: str) -> Column:
        alike = likeness(F.col("lanes"), F.col(f"{other}.lanes"), F.col("signs"), F.col(f"{other}.signs"), F.col("square"), F.col(f"{other}.square"))
        return F.when(F.col(other).isNull(), 1.0).otherwise(alike)  # it follows itself

    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("e.lanes")).alias("edited_fingerprint"), near("e").alias("near_edited"), near("f").alias("near_next"),
    )
