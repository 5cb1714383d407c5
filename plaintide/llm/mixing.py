"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words. A document of a source is expected
``target / source size`` times. The documents of a source stand in a fixed order,
longest first; their expected copies are summed up, one random offset per source
is added, and a document is emitted once for every integer boundary that its share
of the sum crosses. Long documents meet the same offset one after the other, so the
error of a source stays below the size of its longest document.

No source passes through one task: an order is a cell of equal size, then a salt of
the document id, then the id. Positions inside a cell come from a window over
(source, size, salt); what precedes a cell is summed over the aggregated cells.

Defined cases: a null text has size 0; a null source is a source of its own, placed
last; rows that repeat a document id are separate documents; an empty table gives an
empty mix; a source without words has target 0 and its documents are not taken.
Columns of the input other than the named ones are kept only by ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.common import WORD, packed, same, whole_text
from plaintide.session import settle

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
_HEX32 = 2.0**32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: its size and its target, from rows of (source, size).

    A target stops at ``most`` times the size; what lies above is shared again by
    weight among the others. In the order of cap / weight the capped sources come
    first, and the level at which all is shared out is the largest of the levels
    met when the sources are capped one by one. The relation has one row per
    source; its windows run in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / heavy)
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "source_size", "target")


def copies(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of (doc_id, source, size) with source_size, target and copies."""
    word = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.withColumn("salt", F.substring(word, 1, 2))
    cells = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    by_size = by_size.drop("n")
    inside = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    c, s, t = cells.alias("c"), by_size.alias("s"), targets.alias("t")
    starts = (
        c.join(s, same(F.col("c.source"), F.col("s.source")) & (F.col("c.size") == F.col("s.size")))
        .join(t, same(F.col("c.source"), F.col("t.source")))
        .select("c.source", "c.size", "c.salt", (F.col("ahead") + F.col("within")).alias("start"), "source_size", "target")
    )
    number = Window.partitionBy("source", "size", "salt").orderBy(F.col("doc_id").asc_nulls_last())
    r, o = rows.withColumn("place", F.row_number().over(number)).alias("r"), starts.alias("o")
    keys = same(F.col("r.source"), F.col("o.source")) & (F.col("r.size") == F.col("o.size")) & (F.col("r.salt") == F.col("o.salt"))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("r.source"), F.lit("\u0000"))))
    offset = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / _HEX32
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("start") + F.col("place")
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return r.join(o, keys).select(
        "r.doc_id", "r.source", "r.size", "o.source_size", "o.target", crossed.cast("bigint").alias("copies")
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """One row per document: size, source_size, target and the number of copies taken."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint")
    sized = settle(documents.select("doc_id", "source", size.alias("size")), "mix-sizes")
    targets = settle(source_targets(sized, weights, most), "mix-targets")
    return copies(sized, targets, seed)


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every taken document, once per copy, with its copy number.

    Rows that repeat a document id are taken together: the copies of the first of
    them, in the order of the mix, hold for each. A column ``copy`` of the input is replaced.
    """
    taken = mix(documents, **options).groupBy("doc_id").agg(F.max("copies").alias("copies")).alias("t")
    d = packed(documents.drop("copy")).alias("d")
    rows = d.join(taken, same(F.col("d.row.doc_id"), F.col("t.doc_id")) & (F.col("t.copies") > 0))
    return rows.select("d.row.*", F.explode(F.sequence(F.lit(1), F.col("t.copies").cast("int"))).alias("copy"))
