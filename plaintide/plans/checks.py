"""Integrity checks and null profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integrity_checks(
    facts: DataFrame,
    companies: DataFrame,
    expected_rows: int | Column | None,
    first_day: str,
    last_day: str,
    min_leading_zero: int = 0,
) -> DataFrame:
    """Seven checks as (check_name, passed). Facts are read once, plus a key-only anti-join."""
    orphans = (
        facts.select("company")
        .distinct()
        .join(companies.select("company"), "company", "left_anti")
        .agg(F.count("*").alias("n"))
        .scalar()
    )
    types = dict(facts.dtypes)
    received = F.col("date_received")
    outside = (received < F.lit(first_day).cast("date")) | (received > F.lit(last_day).cast("date"))
    one = facts.agg(
        F.count("*").alias("n"),
        F.countDistinct("complaint_id").alias("ids"),
        F.count_if(F.col("zip3").like("0%")).alias("zeros"),
        F.count_if(outside).alias("outside"),
    )
    expected = F.col("n") if expected_rows is None else F.lit(expected_rows)  # a column stays one
    checks = {
        "row_count": F.col("n") == expected,
        "complaint_id_unique": F.col("n") == F.col("ids"),
        "zip3_keeps_leading_zeros": F.col("zeros") > min_leading_zero,
        "dates_are_dates": F.lit(types["date_received"] == "date"),
        "flags_are_booleans": F.lit(types["got_monetary_relief"] == "boolean"),
        "dates_inside_window": F.col("outside") == 0,
        "every_company_known": orphans == 0,
    }
    rows = F.array(
        *[F.struct(F.lit(k).alias("check_name"), v.alias("passed")) for k, v in checks.items()]
    )
    return one.select(F.inline(rows))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column as (column_name, nulls), in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns]
    )
    return one.select(F.inline(rows))


def before_after(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows, nulls and distinct companies and products of both stages."""

    def totals(df: DataFrame, stage: str) -> DataFrame:
        nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), start=F.lit(0))
        # Distinct values are counted over cells, so that facts are not multiplied.
        cells = df.groupBy("company", "product").agg(F.count("*").alias("row_count"), F.sum(nulls).alias("total_nulls"))
        return cells.agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("total_nulls"), F.lit(0)).alias("total_nulls"),
            F.countDistinct("company").alias("distinct_companies"),
            F.countDistinct("product").alias("distinct_products"),
        ).select(F.lit(stage).alias("stage"), F.lit(len(df.columns)).alias("column_count"), "*")

    return totals(raw, "before").unionByName(totals(clean, "after"))
