"""The corpus pipeline: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for
the next. All but the last return the columns of ``documents``.

Defined cases, the same in every stage unless it says otherwise: a null text is an empty one; texts
are worked on whole, however long; rows that repeat each other are documents of their own until
near-duplicates are dropped, which leaves one row for each id; a null id is an id, and a null
source or language a value of its own; columns beyond those of ``documents`` are kept whatever their
names, but for ``copy``, which the last stage replaces; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm import decontaminate, language, lines, mixing, simhash
from plaintide.llm.common import packed, table
from plaintide.session import settle

#: Near-duplicate stages on shingles take five words and this similarity.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject. Those without a letter go, null texts among them."""
    rows = packed(docs).select("row", F.col("row.text").alias("text"))
    return language.identified(rows, language.learn(docs)).where(~F.col("language.rejected")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; n_chars follows the text.

    A document whose lines all stand in earlier ones stays, with an empty text. Ties go to the smallest id.
    """
    kept = lines.dedup_lines(packed(docs).select("row", "row.doc_id", "row.text"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    The stage before takes shared lines from all copies but one, so copies are told by their texts in ``documents``
    first; what is left is compared as it is now. Documents without words are alike, and one of them stays.
    """
    originals = table(spark, sf_dir, "documents")
    return simhash.keep_one(docs, SHINGLE_WORDS, SIMILARITY, originals)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every taken document once per copy, with its copy number."""
    return mixing.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("benchmarks", remove_benchmarks),
    ("mix", mix_sources),
]

#: Language identification and fingerprints cannot be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
