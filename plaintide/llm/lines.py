"""Line dedup: only the first document that holds a line keeps it.

Lines longer than a floor are hashed to 128 bits, range-partitioned by (hash, salt of
the document) and sorted by document and position inside. One pass over each sorted
group streams its first document; the heads of the groups, one row per hash and salt,
settle the first document of the hash. There are as many salts as shuffle partitions, so a
line that a third of all documents share is spread over all of them. The answer is a bitmap per document instead of text:
64 lines to a word, and only words that drop a line are kept. Texts are read once more
where the bitmaps are applied.

Defined cases: a null or empty text is one empty line; a line whose key is shorter
than the floor always stays; a key repeated in one document only always stays; rows
that repeat a document id count as one document; a null document id is one document
that comes after all others; an empty table gives no rows. Extra columns of any name are
kept, but for those of the results' names, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.common import packed, same, shuffle_tasks, whole_text
from plaintide.session import settle

FLOOR = 10
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without spaces at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _UPPER.lower())


def keep_bitmaps(documents: DataFrame, floor: int = FLOOR, salts: int | None = None) -> DataFrame:
    """Documents that lose lines: (doc_id, text_hash, dropped), dropped an array of 64-line words.

    Bit ``i % 64`` of element ``i DIV 64`` is set when line ``i`` goes; words past the
    last dropped line are left out. ``salts``: the shuffle partitions, if not given.
    """
    tasks = shuffle_tasks(documents.sparkSession)
    salts = salts or tasks
    lines = documents.select(
        "doc_id", F.xxhash64(whole_text()).alias("text_hash"),
        F.posexplode(F.split(whole_text(), "\n", -1)).alias("at", "line"),
    ).select("doc_id", "text_hash", "at", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= floor).select(
        F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "text_hash", "at",
    )
    spread = lines.repartitionByRange(tasks, "h", "salt")
    group = Window.partitionBy("h", "salt", "g").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "at")
    streamed = spread.select(
        "*", F.first("doc_id").over(group).alias("local"), F.row_number().over(group).alias("n"),
        F.last("doc_id").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("latest"),
    )
    streamed = settle(streamed, "lines")
    # Heads of groups: at most one row per hash and salt.
    key = Window.partitionBy("h", "g")
    heads = streamed.where("n = 1").select(
        "h", "g", "salt", F.min("local").over(key).alias("first"), F.max("latest").over(key).alias("last"),
        F.max(F.col("latest").isNull()).over(key).alias("in_null"),
    )
    shared = heads.where((F.col("first") < F.col("last")) | (F.col("in_null") & F.col("first").isNotNull()))
    later = streamed.join(shared.select("h", "g", "salt", F.col("first")), ["h", "g", "salt"]).where(
        F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))
    )
    words = later.groupBy("doc_id", "text_hash", F.expr("at DIV 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits")
    )
    packed = words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    dense = F.expr(
        "flatten(transform(w, (x, i) -> concat("
        "array_repeat(0L, cast(x.word - if(i = 0, -1L, w[cast(i - 1 AS int)].word) - 1 AS int)), array(x.bits))))"
    )
    return packed.select("doc_id", "text_hash", dense.alias("dropped"))


def dedup_lines(documents: DataFrame, floor: int = FLOOR) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` (before) and ``n_dropped``, which replace columns of that name."""
    documents = documents.drop("kept_text", "n_lines", "n_dropped")
    b = settle(keep_bitmaps(documents, floor), "line-bitmaps").alias("b")
    d = packed(documents).withColumn("text", whole_text("row.text")).alias("d")
    match = same(F.col("d.row.doc_id"), F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.text_hash"))
    rows, text, dropped = d.join(b, match, "left"), F.col("d.text"), F.col("b.dropped")
    kept = F.array_join(
        F.filter(
            F.split(text, "\n", -1),
            lambda line, i: F.coalesce(F.getbit(F.get(dropped, F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0,
        ),
        "\n",
    )
    gone = F.aggregate(dropped, F.lit(0), lambda n, w: n + F.bit_count(w))
    return rows.select(
        "d.row.*",
        F.when(dropped.isNull(), text).otherwise(kept).alias("kept_text"),
        F.size(F.split(text, "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_dropped"),
    )
