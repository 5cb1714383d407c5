"""Landed JSON pages of the search and institution feeds, and extract operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.operators.aggregates import column_population
from plaintide.schemas import INSTITUTION_FIELDS, INSTITUTION_PAGE, NARRATIVE_FIELD, SEARCH_PAGE


def read_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """Page files, one JSON document per line."""
    return spark.read.schema(schema).json(path)


def search_hits(pages: DataFrame, place: str | None = None) -> DataFrame:
    """Records of search pages, one row per hit.

    ``place`` names a column to add: the page file and the position of the hit in it, which
    order the records as they were landed.
    """
    if place is None:
        return pages.select(F.explode("hits.hits").alias("hit")).select("hit._source.*")
    rows = pages.select(F.col("_metadata.file_path").alias("_file"), F.posexplode("hits.hits").alias("_at", "hit"))
    return rows.select("hit._source.*", F.struct("_file", "_at").alias(place))


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    return search_hits(read_pages(spark, path, SEARCH_PAGE))


def read_institution_pages(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """Institution records of the feed, active charters only by default."""
    rows = read_pages(spark, path, INSTITUTION_PAGE).select(F.explode("data").alias("d"))
    rows = rows.select(*[F.col(f"d.data.{name}").alias(name) for name in INSTITUTION_FIELDS])
    return rows.where(F.col("ACTIVE") == "1") if active_only else rows


def first_seen(new: DataFrame, key: str, place: list[str], history: DataFrame | None = None) -> DataFrame:
    """New records with a key, the first by ``place`` of each key, that earlier runs have not stored.

    Records of equal place are told apart by their other columns, so the survivor is
    the same in every run. Map tasks send one record per key.
    """
    others = [c for c in new.columns if c not in place]
    first = F.min_by(F.struct(*new.columns), F.struct(*place, *others))
    fresh = new.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_first")).select("_first.*")
    return fresh if history is None else fresh.join(history.select(key), key, "left_anti")


def narratives(df: DataFrame, key: str = "complaint_id", text: str = NARRATIVE_FIELD) -> DataFrame:
    """Side table of the non-blank texts, whole and trimmed."""
    return df.select(key, F.regexp_replace(text, r"^\s+|\s+$", "").alias(text)).where(F.col(text) != "")


def without_narrative(df: DataFrame, text: str = NARRATIVE_FIELD) -> DataFrame:
    return df.drop(text)


def rejoin_narratives(lean: DataFrame, side: DataFrame, key: str = "complaint_id") -> DataFrame:
    return lean.join(side, key, "left")


def limited(df: DataFrame, rows: int, *order) -> DataFrame:
    """The first rows of a stated order (top-k per task, then merged)."""
    return df.orderBy(*order).limit(rows)


def manifest(df: DataFrame) -> DataFrame:
    """Row count and share populated per column of the whole extract."""
    return column_population(df)
