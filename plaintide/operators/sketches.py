"""Mergeable approximate aggregates, used only where a caller asks for them.

Exact counts and percentiles stay the default. A sketch is a small binary column that tasks
build in one scan and that merges upward, so cells kept for one report answer at every level
above without the facts:

* quantiles (KLL): the rank of an answer is off by at most ``QUANTILE_ERROR`` of the rows, in 99 cases of 100;
* distinct values (HLL): a count is off by ``DISTINCT_ERROR`` of itself (one standard error); counts of a few
  dozen values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.functions.numbers import rounded

#: Size of a quantile sketch, and the rank error that goes with it.
QUANTILE_K, QUANTILE_ERROR = 800, 0.005
#: Logarithm of the size of a distinct-count sketch, and its standard error.
DISTINCT_LG_K, DISTINCT_ERROR = 12, 0.0163


def quantile_sketch(value: Column | str) -> Column:
    """A sketch of the non-null values of a group."""
    return F.kll_sketch_agg_double(value, F.lit(QUANTILE_K))


def merged_quantile_sketch(sketch: str) -> Column:
    return F.kll_merge_agg_double(sketch, F.lit(QUANTILE_K))


def read_quantiles(sketch: str, points: dict[str, float], places: int = 3) -> dict[str, Column]:
    """The named quantiles of a sketch column; null where it holds no value."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    kept = F.when(some, F.col(sketch))
    return {name: rounded(F.kll_sketch_get_quantile_double(kept, F.lit(share)), places) for name, share in points.items()}


def distinct_sketch(value: Column | str) -> Column:
    """A sketch of the distinct non-null values of a group; leave a value out by making it null."""
    return F.hll_sketch_agg(value, F.lit(DISTINCT_LG_K))


def merged_distinct(sketch: str) -> Column:
    """The number of distinct values over all sketches of a group."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("long")


def group_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], places: int = 3) -> DataFrame:
    """Approximate percentiles per group in one aggregation: a group is one sketch in every task."""
    found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(quantile_sketch(F.col(value)).alias("_sketch"))
    return found.select(*by, *[c.alias(name) for name, c in read_quantiles("_sketch", points, places).items()])


def distinct_rollup(cells: DataFrame, levels: dict[str, list[str]], sketches: list[str]) -> DataFrame:
    """Distinct counts of every level of sketched cells: (level, keys of all levels, one count for each sketch).

    Keys that a level does not have are null. The cells are small, and read once for each level.
    """
    keys = list(dict.fromkeys(k for by in levels.values() for k in by))
    kinds = dict(cells.dtypes)
    parts = []
    for level, by in levels.items():
        counted = cells.groupBy(*by).agg(*[merged_distinct(s).alias(s) for s in sketches])
        own = [F.col(k) if k in by else F.lit(None).cast(kinds[k]).alias(k) for k in keys]
        parts.append(counted.select(F.lit(level).alias("level"), *own, *sketches))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
