"""Numeric column helpers shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of a double that count in rounding: 1.005 is a tie, whatever its binary form.
_EXACT = "decimal(38,12)"


def rounded(value: Column, places: int) -> Column:
    """Rounding as a double, ties away from zero, decided on the decimal value."""
    return F.round(value.cast(_EXACT), places).cast("double")


def ratio(top: Column, bottom: Column, places: int) -> Column:
    """``top / bottom`` rounded; null when the denominator is zero or null."""
    return rounded(F.try_divide(top.cast("double"), bottom.cast("double")), places)


def percent_of(top: Column, bottom: Column, places: int = 2) -> Column:
    """``top`` as a percentage of ``bottom``; null for an empty denominator."""
    return rounded(F.try_divide(F.lit(100.0) * top, bottom.cast("double")), places)


def flag(condition: Column) -> Column:
    """A boolean that is false, never null, when its inputs are null."""
    return F.coalesce(condition, F.lit(False))


def number_or_zero(text: Column) -> Column:
    """Parse text as an exact amount; anything unparseable counts as zero."""
    return F.coalesce(text.try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))


def banded(value: Column, bands: list[tuple[float, str]], top: str, closed: bool) -> Column:
    """Label a number by the first upper bound it fits under.

    ``closed`` bounds include the bound itself. Null stays null.
    """
    label = F.lit(None).cast("string")
    chain = F.when(value.isNull(), label)
    for bound, name in bands:
        chain = chain.when(value <= bound if closed else value < bound, name)
    return chain.otherwise(top)


def quoted(words) -> str:
    """Constant texts as a SQL literal list."""
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


def constant_map(table: dict[str, str]) -> Column:
    """A constant lookup table as one map literal."""
    return F.expr(f"map({quoted(part for pair in table.items() for part in pair)})")
