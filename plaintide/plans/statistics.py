"""Association tests, rank correlation, spike attribution and sensitivity."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions.numbers import banded, percent_of, ratio, rounded
from plaintide.operators.chi_tail import chi_square_tail
from plaintide.operators.ranking import placed, with_positions
from plaintide.session import settle

# Strength bands of Cramer's V.
EFFECT_BANDS = [(0.10, "negligible"), (0.20, "weak"), (0.30, "moderate")]
RELIEF, NO_RELIEF = "Monetary relief", "No monetary relief"
CORRELATED = [
    "total_complaints", "total_assets_b", "complaints_per_1b_assets", "monetary_relief_rate",
    "untimely_rate", "avg_days_to_company",
]


def with_outcome(facts: DataFrame, in_window: bool = False) -> DataFrame:
    """Resolved facts with a two-valued ``outcome``."""
    scope = facts.where("is_resolved AND in_trend_window" if in_window else "is_resolved")
    return scope.withColumn("outcome", F.when(F.col("got_monetary_relief"), RELIEF).otherwise(NO_RELIEF))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per ``row`` with one column per given value; absent cells are zero."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.where(F.col(row).isNotNull()).groupBy(row).agg(*counts)


def _with_expected(table: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """A settled crosstab with row sums and one expected count per cell, and its column sums.

    The crosstab has a row per group; it is written once, and so are its sums.
    """
    row_sum = sum((F.col(v) for v in values[1:]), start=F.col(values[0]))
    table = settle(table.withColumn("_r", row_sum).where("_r > 0"), "crosstab")
    sums = settle(
        table.agg(F.count("*").alias("rows"), F.sum("_r").alias("n"), *[F.sum(v).alias(f"c{i}") for i, v in enumerate(values)]),
        "crosstab-sums",
    )
    n = sums.select("n").scalar()
    expected = {
        f"_e{i}": F.col("_r") * sums.select(f"c{i}").scalar().cast("double") / n for i in range(len(values))
    }
    return table.withColumns(expected), sums


def chi_square(table: DataFrame, values: list[str]) -> DataFrame:
    """Independence test of a crosstab: one row.

    Sums (o - e)^2 / e directly, which keeps its digits at any number of rows. No
    continuity correction is made for 2 x 2 tables.
    """
    table, sums = _with_expected(table, values)
    cells = [
        F.coalesce(F.try_divide(F.pow(F.col(v) - F.col(f"_e{i}"), 2), F.col(f"_e{i}")), F.lit(0.0))
        for i, v in enumerate(values)
    ]
    parts = table.select(sum(cells[1:], start=cells[0]).alias("part"))
    used = sum((F.when(F.col(f"c{i}") > 0, 1).otherwise(0) for i in range(len(values))), start=F.lit(0))
    one = sums.withColumn("statistic", F.coalesce(parts.agg(F.sum("part")).scalar(), F.lit(0.0)))
    one = one.withColumn("dof", ((F.col("rows") - 1) * (used - 1)).cast("long"))
    smaller = F.least(F.col("rows"), used.cast("long")) - 1
    v = F.sqrt(F.try_divide(F.col("statistic"), (F.col("n") * smaller).cast("double")))
    return one.select(
        rounded(F.col("statistic"), 6).alias("statistic"),
        "dof",
        "n",
        rounded(v, 6).alias("cramers_v"),
        banded(v, EFFECT_BANDS, "strong", closed=False).alias("strength"),
    )


def with_p_value(test: DataFrame) -> DataFrame:
    return test.withColumn("p_value", chi_square_tail("statistic", "dof"))


def large_groups(df: DataFrame, key: str, floor: int) -> DataFrame:
    """Rows of groups with at least ``floor`` rows (semi-join on the qualifying keys)."""
    keys = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= floor).select(key)
    return df.join(settle(keys, "large-groups"), key, "left_semi")


def large_rows(table: DataFrame, values: list[str], floor: int) -> DataFrame:
    """The same restriction on an already counted crosstab, without a join."""
    return table.where(sum((F.col(v) for v in values[1:]), start=F.col(values[0])) >= floor)


def residuals(table: DataFrame, row: str, values: list[str]) -> DataFrame:
    """Observed, expected and Pearson residual (o - e) / sqrt(e) of every cell."""
    table, _ = _with_expected(table, values)
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("outcome"), F.col(v).alias("observed"), F.col(f"_e{i}").alias("expected"))
            for i, v in enumerate(values)
        ]
    )
    score = F.try_divide(F.col("observed") - F.col("expected"), F.sqrt("expected"))
    return table.select(row, F.inline(cells)).withColumn("residual", score)


def extreme_residuals(cells: DataFrame, row: str, each_side: int = 4) -> DataFrame:
    """The lowest and the highest residuals with their direction."""
    low = cells.orderBy("residual", row, "outcome").limit(each_side)
    high = cells.orderBy(F.desc("residual"), row, "outcome").limit(each_side)
    direction = F.when(F.col("residual") > 0, "MORE than expected").otherwise("FEWER than expected")
    return (
        low.unionByName(high)
        .withColumn("direction", direction)
        .withColumn("beyond_two", F.abs("residual") > 2)
    )


def rate_spread(table: DataFrame, row: str) -> DataFrame:
    """Lowest, median and highest relief rate of a crosstab and who holds them."""
    rate = F.try_divide(
        100.0 * F.col(RELIEF), (F.col(RELIEF) + F.col(NO_RELIEF)).cast("double")
    )
    rates = table.select(row, rounded(rate, 6).alias("rate"))
    one = rates.agg(
        F.count("*").alias("groups"),
        F.min("rate").alias("min_rate"),
        F.min_by(row, F.struct("rate", row)).alias("min_group"),
        F.percentile("rate", F.lit(0.5)).alias("_median"),
        F.max("rate").alias("max_rate"),
        F.min_by(row, F.struct(-F.col("rate"), F.col(row))).alias("max_group"),
    )
    return one.select(
        "groups",
        "min_rate",
        "min_group",
        rounded(F.col("_median"), 6).alias("median_rate"),
        "max_rate",
        "max_group",
        ratio(F.col("max_rate"), F.greatest(F.col("_median"), F.lit(0.01)), 4).alias("max_to_median"),
    )


def _spearman_pairs(
    companies: DataFrame, pairs: list[tuple[str, str]], key: str
) -> DataFrame:
    """Long relation (pair, x, y) -> rank correlation of each pair on complete rows."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("measure_a"),
                F.lit(b).alias("measure_b"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for a, b in pairs
        ]
    )
    names = ["measure_a", "measure_b"]
    long = companies.select(key, F.inline(entries)).where("x IS NOT NULL AND y IS NOT NULL")
    rank = F.col("rows_before") + (F.col("ties") + 1) / 2
    fields = ["ties", "rows_before", "values_before", "rows_total"]
    first = placed(long, "x", names).withColumn("rank_x", rank).drop(*fields)
    both = placed(first, "y", names).withColumn("rank_y", rank)
    return both.groupBy(*names).agg(
        F.count("*").alias("n"), rounded(F.corr("rank_x", "rank_y"), 6).alias("rho")
    )


def spearman_matrix(
    companies: DataFrame, measures: list[str] = CORRELATED, key: str = "company"
) -> DataFrame:
    """Upper triangle of the rank-correlation matrix, pairwise complete."""
    companies = settle(companies.select(key, *measures))
    return _spearman_pairs(companies, list(combinations_with_replacement(measures, 2)), key)


def score_redundancy(
    companies: DataFrame, first: str, second: str, key: str = "company"
) -> DataFrame:
    """Rank correlation and mean absolute gap of two candidate score components."""
    companies = settle(companies.select(key, first, second))
    gap = rounded(F.avg(F.abs(F.col(first) - F.col(second))), 4)
    return _spearman_pairs(companies, [(first, second)], key).withColumn(
        "mean_gap", companies.agg(gap.alias("g")).scalar()
    )


def rank_contrast(companies: DataFrame) -> DataFrame:
    """Volume rank against rate rank of matched companies and their gap."""
    companies = settle(companies.select("company", "total_complaints", "complaints_per_1b_assets"))
    ranked, at = with_positions(
        companies,
        "company",
        {"volume": -F.col("total_complaints"), "size": -F.col("complaints_per_1b_assets")},
    )
    return ranked.select(
        "company",
        "total_complaints",
        "complaints_per_1b_assets",
        at["volume"].rank().alias("volume_rank"),
        at["size"].rank().alias("size_rank"),
        (at["volume"].rank() - at["size"].rank()).alias("gap"),
    )


def spike_attribution(df: DataFrame, group: str, period: Column, before: str, after: str, top: int = 6) -> DataFrame:
    """Largest increases between two periods and their share of the total change.

    Both periods are counted in one scan, which is the full outer alignment of
    two count tables with absent groups as zero.
    """
    counts = (
        df.withColumn("_period", period)
        .where(F.col("_period").isin(before, after) & F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count_if(F.col("_period") == after).alias("n_after"),
            F.count_if(F.col("_period") == before).alias("n_before"),
        )
    )
    counts = settle(counts.withColumn("increase", F.col("n_after") - F.col("n_before")))
    change = counts.agg(F.sum("increase").alias("d")).scalar()
    return (
        counts.orderBy(F.desc("increase"), group)
        .limit(top)
        .withColumn("spike_size", change)
        .withColumn("pct_of_spike", percent_of(F.col("increase"), change, 1))
    )


def daily_peak(df: DataFrame, day: Column) -> DataFrame:
    """Busiest day against the median day: one row."""
    daily = df.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return daily.agg(
        F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("peak_day"),
        F.max("n").alias("peak_n"),
        F.percentile("n", F.lit(0.5)).alias("median_day_n"),
        F.count("*").alias("days"),
    )


def dominant_categories(df: DataFrame, by: list[str], top: int = 4) -> DataFrame:
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *by).limit(top)


def sensitivity(
    cells: DataFrame, enriched: DataFrame, month: str, floor: int = 500
) -> DataFrame:
    """Per-$1B rate and rank of each matched company with and without one month.

    ``cells`` are those of ``enrichment.outcome_cells`` by month, from which ``enriched`` comes too.
    """
    n = F.col("total_complaints")
    counts = (
        cells.where("in_trend_window")
        .groupBy("company")
        .agg(
            F.sum(n).alias("n_with"),
            F.sum(F.when(F.col("year_month") != month, n).otherwise(0)).alias("n_without"),
        )
    )
    assets = enriched.where("matched").select("company", "total_assets_b")
    rates = settle(
        counts.where(F.col("n_with") >= floor)
        .join(assets, "company")
        .withColumn("rate_with", ratio(F.col("n_with"), F.col("total_assets_b"), 2))
        .withColumn("rate_without", ratio(F.col("n_without"), F.col("total_assets_b"), 2))
        .withColumn("pct_from_month", percent_of(F.col("n_with") - F.col("n_without"), F.col("n_with"), 1))
    )
    ranked, at = with_positions(
        rates, "company", {"with": -F.col("rate_with"), "without": -F.col("rate_without")}
    )
    return ranked.select(
        *rates.columns,
        at["with"].rank().alias("rank_with"),
        at["without"].rank().alias("rank_without"),
        (at["with"].rank() == at["without"].rank()).alias("keeps_rank"),
    )


def sensitivity_summary(shifts: DataFrame, material_pct: float = 5.0) -> DataFrame:
    return shifts.agg(
        F.count("*").alias("companies"),
        F.count_if("keeps_rank").alias("keeping_rank"),
        F.count_if(F.col("pct_from_month") > material_pct).alias("material"),
    )


def centred_average(series: DataFrame, order: str, value: str) -> DataFrame:
    """Three-row centred mean, null at both ends. The series is one row per period."""
    around = Window.orderBy(order).rowsBetween(-1, 1)
    full = F.count(value).over(around) == 3
    return series.withColumn("centred_avg", F.when(full, rounded(F.avg(value).over(around), 4)))


def window_change(series: DataFrame, order: str, value: str) -> DataFrame:
    """First, last and percentage change between them, and the peak period."""
    one = series.agg(
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
        F.min_by(order, F.struct(-F.col(value), F.col(order))).alias("peak_period"),
        F.max(value).alias("peak_value"),
    )
    change = percent_of(F.col("last_value") - F.col("first_value"), F.col("first_value"), 2)
    return one.withColumn("pct_change", change)


def edge_growth(series: DataFrame, group: str, order: str, value: str, edge: int = 3) -> DataFrame:
    """Growth from the mean of the first to the mean of the last periods of each group."""
    line = Window.partitionBy(group)
    placed_rows = series.withColumn("_up", F.row_number().over(line.orderBy(order))).withColumn(
        "_down", F.row_number().over(line.orderBy(F.desc(order)))
    )
    means = placed_rows.groupBy(group).agg(
        F.avg(F.when(F.col("_up") <= edge, F.col(value))).alias("first_mean"),
        F.avg(F.when(F.col("_down") <= edge, F.col(value))).alias("last_mean"),
    )
    growth = percent_of(F.col("last_mean") - F.col("first_mean"), F.col("first_mean"), 2)
    return means.select(
        group, rounded(F.col("first_mean"), 4).alias("first_mean"),
        rounded(F.col("last_mean"), 4).alias("last_mean"), growth.alias("growth_pct"),
    )


def yearly_growth(facts: DataFrame, by: str, first: int, last: int) -> DataFrame:
    """Counts of two years per category and the change between them."""
    counts = (
        facts.where(F.col("in_trend_window") & F.col("year").isin(first, last))
        .groupBy(by)
        .agg(
            F.count_if(F.col("year") == first).alias("n_first"),
            F.count_if(F.col("year") == last).alias("n_last"),
        )
    )
    change = F.col("n_last") - F.col("n_first")
    return counts.withColumn("growth_pct", percent_of(change, F.col("n_first"), 2))


def national_baseline(facts: DataFrame, by: str) -> DataFrame:
    """Outcome rates per group and as a multiple of the national rate; all divide by resolved."""
    parts = {
        "relief": "got_monetary_relief",
        "any_relief": "got_any_relief",
        "untimely": "is_untimely",
        "explanation": "closed_explanation_only",
    }
    groups = settle(
        facts.where("in_trend_window AND is_resolved")
        .groupBy(by)
        .agg(F.count("*").alias("resolved"), *[F.count_if(c).alias(n) for n, c in parts.items()])
    )
    nation = settle(groups.agg(F.sum("resolved").alias("resolved"), *[F.sum(n).alias(n) for n in parts]))

    def share(name: str) -> Column:
        return F.try_divide(100.0 * F.col(name), F.col("resolved").cast("double"))

    def national(name: str) -> Column:
        return nation.select(share(name).alias("r")).scalar()

    columns = [F.col(by), F.col("resolved")]
    for name in parts:
        columns.append(rounded(share(name), 3).alias(f"{name}_rate"))
        columns.append(rounded(national(name), 3).alias(f"national_{name}_rate"))
        columns.append(ratio(share(name), national(name), 3).alias(f"{name}_x_national"))
    return groups.select(*columns)
