"""Grouped measures over complaint facts.

Company and state reports first collapse facts to one row per (group, attribute
values) inside the map tasks, so a company holding a third of all rows reaches
the shuffle as a few small rows. Distinct counts are then taken over these
cells, never over facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.functions.numbers import rounded
from plaintide.operators.sketches import group_quantiles


def counted(*flags: str, **renamed: str) -> list[Column]:
    """``count_if`` per boolean column; keywords rename: ``relief="got_relief"``."""
    return [F.count_if(F.col(f)).alias(f) for f in flags] + [
        F.count_if(F.col(f)).alias(name) for name, f in renamed.items()
    ]


def summed(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def lag_parts() -> list[Column]:
    """Sum and count of the routing lag without the long-lag rows."""
    usable = F.when(~F.col("dq_long_routing_lag"), F.col("days_to_company"))
    return [F.sum(usable).alias("lag_sum"), F.count(usable).alias("lag_n")]


def lag_mean(places: int) -> Column:
    return rounded(F.try_divide(F.col("lag_sum"), F.col("lag_n").cast("double")), places)


def group_percentiles(
    df: DataFrame, by: list[str], value: str, points: dict[str, float], places: int = 3, approximate: bool = False
) -> DataFrame:
    """Interpolated percentiles per group, exact unless ``approximate`` asks for sketches.

    Facts first collapse to (group, value) counts, spread over the cluster by
    both columns; the last step merges one entry per distinct value. The lag has
    three decimals, so a group has at most a thousand entries per day of range.
    """
    if approximate:
        return group_quantiles(df, by, value, points, places)
    weights = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_w"))
    shares = F.array(*[F.lit(p) for p in points.values()])
    found = weights.groupBy(*by).agg(F.percentile(F.col(value), shares, F.col("_w")).alias("_p"))
    return found.select(
        *by, *[rounded(F.get("_p", F.lit(i)), places).alias(name) for i, name in enumerate(points)]
    )


def column_population(df: DataFrame) -> DataFrame:
    """Rows, non-null values and percentage populated per column, in one pass."""
    names = df.columns
    one = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(n)).alias(n) for n in names])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("populated")) for n in names]
    )
    return one.select("_rows", F.explode(pairs).alias("p")).select(
        "p.column_name",
        F.col("_rows").alias("row_count"),
        F.col("p.populated").alias("populated"),
        rounded(100.0 * F.try_divide(F.col("p.populated").cast("double"), F.col("_rows").cast("double")), 1).alias(
            "pct_populated"
        ),
    )
