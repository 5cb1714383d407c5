"""CSV sources: declared all-string scans and the bulk export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.functions.taxonomy import PRODUCT_SCOPE
from plaintide.schemas import NARRATIVE_FIELD, RAW_COLUMNS

# Names the bulk export uses for columns of the extract.
BULK_ALIASES = {
    "consumer_complaint_narrative": NARRATIVE_FIELD,
    "timely_response?": "timely",
}


def scan_strings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and quoted line breaks, every column as text."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def scan_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Bulk export with its own header names, as text.

    Quoted line breaks keep a file in one piece, so a file is one task: an export is landed as
    a folder of files, or passes through ``land_bulk`` once.
    """
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def land_bulk(spark: SparkSession, path: str, target: str, pieces: int) -> DataFrame:
    """Convert an export to Parquet in ``pieces`` files, once; later scans split and prune it."""
    scan_bulk(spark, path).repartition(pieces).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def normalise_header(df: DataFrame) -> DataFrame:
    """Lower-case names with ``_`` for blanks and dashes, aliases renamed."""
    plain = [re.sub(r"[ -]", "_", name.strip().lower()) for name in df.columns]
    return df.toDF(*[BULK_ALIASES.get(name, name) for name in plain])


def in_scope(
    df: DataFrame, first_day: str, last_day: str, products: list[str] = PRODUCT_SCOPE
) -> DataFrame:
    """Rows received within the closed date range and belonging to the products."""
    received = F.col("date_received").try_cast("date")
    day_range = received.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    return df.where(day_range & F.col("product").isin(products))


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order; an absent one is null text."""
    present = set(df.columns)
    return df.select(
        *[F.col(n) if n in present else F.lit(None).cast("string").alias(n) for n in names]
    )


def bulk_extract(
    df: DataFrame, first_day: str, last_day: str, products: list[str] = PRODUCT_SCOPE
) -> DataFrame:
    """Bulk rows narrowed to the scope, in extract columns plus the narrative."""
    scoped = in_scope(normalise_header(df), first_day, last_day, products)
    return with_columns(scoped, [*RAW_COLUMNS, NARRATIVE_FIELD])
