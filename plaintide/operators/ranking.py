"""Exact global ranks whose cost is bounded in every task.

A window without PARTITION BY moves its whole input into one task. The operators here
give the same numbers at any size from stretches of the order of the values:

* ``value_positions`` ranks *distinct values*. Rows collapse into a ``value -> ties``
  histogram (with map-side combine, so one value held by most rows costs nothing). A value
  falls into a stretch that follows from the value alone; each stretch is ordered on its
  own, and only the list of stretches that hold values, 1.5 million at the very most and a
  few thousand for counts and rates, sees a further window.
* ``global_row_number`` numbers rows with a unique name: by value, and rows that tie by the
  first letters of their names, then by name.

A stretch is a property of the value, so a repeated task sees the same stretches, and
nothing has to be sampled or written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches for a factor of e in the distance from -1 or 1: values in one differ by a thousandth.
STRETCHES = 1024
#: Letters of a name that stretches of tied rows have in common.
_LETTERS = 4


def _stretch(value: Column) -> Column:
    """Number of the stretch of a double; never falls as the value grows. NaN comes last, as in an order."""
    size = F.floor(F.least(F.log1p(F.abs(value)), F.lit(710.0)) * STRETCHES).cast("long")
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value >= 0, size).otherwise(-size - 1)


def value_positions(df: DataFrame, value: str, by: list[str] | None = None, sums: bool = False) -> DataFrame:
    """One row per distinct non-null ``value`` (a double) in each ``by`` group.

    Adds ``ties`` (rows holding the value), ``rows_before``, ``values_before``
    and ``rows_total``, all counted in ascending order of the value; with ``sums`` also
    ``sum_before`` and ``sum_total``, the values of those rows added up.
    """
    by = by or []
    histogram = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    histogram = histogram.withColumns({"_part": _stretch(F.col(value)), "_one": F.lit(1), "_sum": F.col(value) * F.col("ties")})
    counted = {"rows": "ties", "values": "_one"} | ({"sum": "_sum"} if sums else {})
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = histogram.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in counted.items()])
    stretches = stretches.select(
        *by,
        "_part",
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_base") for name in counted],
        *[F.sum(f"_{name}").over(Window.partitionBy(*by)).alias(f"{name}_total") for name in counted],
    )
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{name}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in counted.items()}
    rows = histogram.withColumns(before).join(stretches, [*by, "_part"])
    return rows.select(
        *by,
        value,
        "ties",
        *[(F.col(f"_{name}_base") + F.col(f"{name}_before")).alias(f"{name}_before") for name in counted],
        "rows_total",
        *(["sum_total"] if sums else []),
    )


@dataclass(frozen=True)
class Position:
    """Rank columns of one measure, read from the positions of its value."""

    ties: Column
    rows_before: Column
    values_before: Column
    rows_total: Column

    def rank(self) -> Column:
        return (self.rows_before + 1).cast("long")

    def dense_rank(self) -> Column:
        return (self.values_before + 1).cast("long")

    def average_rank(self) -> Column:
        """Mean of the places tied rows share (1-based)."""
        return self.rows_before + (self.ties + 1) / 2

    def percent_rank(self) -> Column:
        """(rank - 1) / (rows - 1); zero for a single row, as in SQL."""
        return F.when(self.rows_total == 1, F.lit(0.0)).otherwise(
            F.try_divide(self.rows_before.cast("double"), (self.rows_total - 1).cast("double"))
        )

    def percentile(self) -> Column:
        """Average rank over the number of non-null rows, in (0, 1]."""
        return self.average_rank() / self.rows_total


_FIELDS = ["ties", "rows_before", "values_before", "rows_total"]


def placed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Non-null rows with the position fields of ``value`` per ``by`` group."""
    known = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return known.join(value_positions(known, value, by), [*by, value])


def with_positions(df: DataFrame, key: str, measures: dict[str, Column]) -> tuple[DataFrame, dict[str, Position]]:
    """Place every row of a settled relation within each named measure.

    ``measures`` maps a name to the number to rank by, ascending; negate it for
    a descending rank. Rows with a null measure get null positions. All measures
    travel in one long relation, so the number of shuffles does not grow with the
    number of measures.
    """
    positions = {
        name: Position(*[F.col(f"_{name}_{field}") for field in _FIELDS]) for name in measures
    }
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), number.cast("double").alias("value"))
            for name, number in measures.items()
        ]
    )
    long = (
        df.select(key, F.explode(entries).alias("e"))
        .select(key, "e.measure", "e.value")
        .where("value IS NOT NULL")
    )
    found = long.join(value_positions(long, "value", ["measure"]), ["measure", "value"])
    wide = found.groupBy(key).agg(
        *[
            F.max(F.when(F.col("measure") == name, F.col(field))).alias(f"_{name}_{field}")
            for name in measures
            for field in _FIELDS
        ]
    )
    return df.join(wide, key, "left"), positions


def global_row_number(df: DataFrame, value: Column, name: str) -> tuple[DataFrame, Position]:
    """The rows of a settled relation with ``row_number``, by ``value`` ascending, then by name, and the position of the value.

    Also adds ``running_sum``, the values added up in that order, and ``sum_total``. ``value`` is never
    null and ``name`` unique. Tied rows are numbered in stretches of names with the same first letters.
    """
    valued = df.withColumns({"_value": value.cast("double"), "_letters": F.substring(name, 1, _LETTERS)})
    placed = valued.join(value_positions(valued, "_value", sums=True), "_value")
    earlier = Window.partitionBy("_value").orderBy("_letters").rowsBetween(Window.unboundedPreceding, -1)
    offsets = valued.groupBy("_value", "_letters").agg(F.count("*").alias("_n"))
    offsets = offsets.select("_value", "_letters", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_value", "_letters").orderBy(name))
    among = F.col("_base") + F.col("_local")
    numbered = placed.withColumn("_local", local).join(offsets, ["_value", "_letters"])
    numbered = numbered.withColumns(
        {"row_number": (F.col("rows_before") + among).cast("long"), "running_sum": F.col("sum_before") + F.col("_value") * among}
    )
    return numbered.drop("_value", "_letters", "_base", "_local", "sum_before"), Position(*[F.col(f) for f in _FIELDS])


def ntile(tiles: int, row_number: Column, rows_total: Column) -> Column:
    """SQL NTILE from a row number: the first ``rows % tiles`` tiles get one row more."""
    size = F.floor(rows_total / tiles)
    extra = rows_total % tiles
    long_rows = extra * (size + 1)
    return (
        F.when(row_number <= long_rows, F.ceil(row_number / (size + 1)))
        .otherwise(extra + F.ceil((row_number - long_rows) / F.greatest(size, F.lit(1))))
        .cast("long")
    )
