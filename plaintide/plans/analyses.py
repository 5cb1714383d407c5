"""The six reports over clean complaint facts.

Every ``*_rate`` is a percentage; its denominator is named in the docstring,
because the reports differ on it by design. Facts carry the columns of
``schemas.CLEAN_COMPLAINTS``; only those a report uses are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions.dates import month_start
from plaintide.functions.numbers import percent_of, ratio, rounded
from plaintide.operators.aggregates import counted, lag_mean, lag_parts, summed
from plaintide.operators.ranking import (
    global_row_number,
    ntile,
    with_positions,
)
from plaintide.operators.sketches import distinct_rollup, distinct_sketch
from plaintide.session import settle


def company_volume(facts: DataFrame) -> DataFrame:
    """Trend-window volume, outcomes and breadth per company."""
    cells = (
        facts.where("in_trend_window")
        .withColumn("home_state", F.when(F.col("state_type") == "state", F.col("state")))
        .groupBy("company", "product", "home_state")
        .agg(
            F.count("*").alias("complaints"),
            *counted(
                resolved="is_resolved", monetary_relief="got_monetary_relief", untimely="is_untimely"
            ),
            F.min("date_received").alias("first_complaint"),
            F.max("date_received").alias("last_complaint"),
        )
    )
    return cells.groupBy("company").agg(
        *summed("complaints", "resolved", "monetary_relief", "untimely"),
        F.countDistinct("product").alias("products_touched"),
        F.countDistinct("home_state").alias("states_touched"),
        F.min("first_complaint").alias("first_complaint"),
        F.max("last_complaint").alias("last_complaint"),
    )


def breadth_cells(facts: DataFrame) -> DataFrame:
    """Per (company, product): volume, and sketches of products and home states, written once."""
    home = F.when(F.col("state_type") == "state", F.col("state"))
    cells = facts.where("in_trend_window").groupBy("company", "product").agg(
        F.count("*").alias("complaints"),
        distinct_sketch(F.col("product")).alias("products_touched"),
        distinct_sketch(home).alias("states_touched"),
    )
    return settle(cells, "breadth-cells")


def approximate_breadth(cells: DataFrame) -> DataFrame:
    """Products and home states by company, by product and over the nation, from the same sketches."""
    levels = {"company": ["company"], "product": ["product"], "nation": []}
    return distinct_rollup(cells, levels, ["products_touched", "states_touched"])


def company_reach(facts: DataFrame) -> DataFrame:
    """Number of companies by product, by state and over the nation, from sketches of (product, state) cells."""
    cells = facts.where("in_trend_window").groupBy("product", "state").agg(distinct_sketch(F.col("company")).alias("companies"))
    return distinct_rollup(settle(cells, "reach-cells"), {"product": ["product"], "state": ["state"], "nation": []}, ["companies"])


def _volume_line(facts: DataFrame) -> DataFrame:
    volume = settle(company_volume(facts))
    line, at = global_row_number(volume, -F.col("complaints"), "company")
    return line.withColumns(
        {
            "volume_rank": at.rank(),
            "volume_dense_rank": at.dense_rank(),
            "volume_quartile": ntile(4, F.col("row_number"), F.col("rows_total")),
            "pct_of_all_complaints": percent_of(F.col("complaints"), -F.col("sum_total"), 4),
            "cumulative_pct": percent_of(-F.col("running_sum"), -F.col("sum_total"), 2),
        }
    )


def company_ranking(facts: DataFrame, top: int = 100) -> DataFrame:
    """Q1: companies by volume with concentration; both rates divide by resolved."""
    return (
        _volume_line(facts)
        .where(F.col("volume_rank") <= top)
        .select(
            "volume_rank",
            "volume_dense_rank",
            "company",
            "complaints",
            "pct_of_all_complaints",
            "cumulative_pct",
            "resolved",
            percent_of(F.col("monetary_relief"), F.col("resolved")).alias("monetary_relief_rate"),
            percent_of(F.col("untimely"), F.col("resolved")).alias("untimely_rate"),
            "products_touched",
            "states_touched",
            "first_complaint",
            "last_complaint",
        )
        .orderBy("volume_rank", "company")
    )


def volume_quartiles(facts: DataFrame) -> DataFrame:
    """Volume quartile of every company, largest first."""
    return _volume_line(facts).select("company", "complaints", "volume_quartile")


def monthly_by_product(facts: DataFrame) -> DataFrame:
    return (
        facts.where("in_trend_window")
        .groupBy("product", "product_short", "year_month")
        .agg(
            F.min("date_received").alias("month_start"),
            F.count("*").alias("complaints"),
            *counted(
                resolved="is_resolved", monetary_relief="got_monetary_relief", untimely="is_untimely"
            ),
        )
    )


def dense_months(monthly: DataFrame) -> DataFrame:
    """Every calendar month of each product's span; months without rows count zero."""
    span = monthly.groupBy("product", "product_short").agg(
        F.min(month_start(F.col("year_month"))).alias("_from"),
        F.max(month_start(F.col("year_month"))).alias("_to"),
    )
    spine = span.select(
        "product",
        "product_short",
        F.explode(F.expr("sequence(_from, _to, interval 1 month)")).alias("_day"),
    ).withColumn("year_month", F.date_format("_day", "yyyy-MM"))
    joined = spine.join(monthly, ["product", "product_short", "year_month"], "left")
    return joined.withColumn("month_start", F.coalesce("month_start", "_day")).fillna(0).drop("_day")


def monthly_trend(facts: DataFrame, dense: bool = False) -> DataFrame:
    """Q2: product by month against neighbours; ``untimely_rate`` divides by all complaints.

    Lags count rows of the series. ``dense`` fills absent months first, so that
    twelve rows back is the same month last year.
    """
    monthly = monthly_by_product(facts)
    monthly = dense_months(monthly) if dense else monthly
    line = Window.partitionBy("product").orderBy("year_month")
    n = F.col("complaints")
    series = monthly.withColumns(
        {
            "prev_month": F.lag(n, 1).over(line),
            "same_month_last_year": F.lag(n, 12).over(line),
            "next_month": F.lead(n, 1).over(line),
            "moving_avg_3m": rounded(F.avg(n).over(line.rowsBetween(-2, 0)), 1),
            "_first": F.first(n).over(line),
        }
    )
    return series.select(
        "product",
        "product_short",
        "year_month",
        "month_start",
        "complaints",
        "prev_month",
        (n - F.col("prev_month")).alias("mom_change"),
        percent_of(n - F.col("prev_month"), F.col("prev_month")).alias("mom_pct_change"),
        "same_month_last_year",
        percent_of(n - F.col("same_month_last_year"), F.col("same_month_last_year")).alias(
            "yoy_pct_change"
        ),
        "moving_avg_3m",
        percent_of(n - F.col("_first"), F.col("_first")).alias("pct_change_since_start"),
        "monetary_relief",
        "untimely",
        percent_of(F.col("untimely"), n).alias("untimely_rate"),
        "next_month",
    ).orderBy("product", "year_month")


def resolution_rates(
    facts: DataFrame, floor: int = 500
) -> DataFrame:
    """Q3: outcome rates of resolved complaints against the peer median."""
    outcomes = (
        facts.where("in_trend_window AND is_resolved")
        .groupBy("company")
        .agg(
            F.count("*").alias("resolved_complaints"),
            *counted(
                monetary_relief="got_monetary_relief",
                any_relief="got_any_relief",
                explanation_only="closed_explanation_only",
                untimely="is_untimely",
                disputes_facts="company_disputes_facts",
            ),
            *lag_parts(),
        )
        .where(F.col("resolved_complaints") >= floor)
    )
    base = F.col("resolved_complaints")
    parts = ["monetary_relief", "any_relief", "explanation_only", "untimely", "disputes_facts"]
    rates = settle(
        outcomes.select(
            "company",
            "resolved_complaints",
            *[percent_of(F.col(p), base, 3).alias(f"{p}_rate") for p in parts],
            lag_mean(3).alias("avg_days_to_company"),
        )
    )
    # Rates have three decimals, so the percentile map has at most 100,001 entries.
    peers = rates.agg(
        F.percentile("monetary_relief_rate", F.lit(0.5)).alias("relief"),
        F.percentile("untimely_rate", F.lit(0.5)).alias("untimely"),
    )
    relief_median = peers.select("relief").scalar()
    untimely_median = peers.select("untimely").scalar()
    placed, at = with_positions(
        rates,
        "company",
        {"relief": F.col("monetary_relief_rate"), "late": -F.col("untimely_rate")},
    )
    return placed.select(
        *rates.columns,
        at["relief"].rank().alias("worst_relief_rank"),
        at["late"].rank().alias("worst_timeliness_rank"),
        rounded(at["relief"].percent_rank(), 4).alias("relief_percentile_worst_first"),
        rounded(at["late"].percent_rank(), 4).alias("untimely_percentile_worst_first"),
        rounded(relief_median, 3).alias("peer_median_relief_rate"),
        rounded(F.col("monetary_relief_rate") - relief_median, 3).alias("relief_rate_vs_median"),
        rounded(F.col("untimely_rate") - untimely_median, 3).alias("untimely_rate_vs_median"),
    ).orderBy(F.desc("untimely_rate"), "monetary_relief_rate", "company")


def size_adjusted(cells: DataFrame, enriched: DataFrame, floor: int = 500) -> DataFrame:
    """Q4: complaints per $1B of assets against raw volume, matched companies only.

    ``cells`` are those of ``enrichment.outcome_cells``, from which ``enriched`` comes too, so the facts are read once.
    """
    peers = enriched.where(
        F.col("matched") & (F.col("total_assets_b") > 0) & (F.col("total_complaints") >= floor)
    ).select("company", "fdic_name", "n_charters", "match_method", "total_complaints", "total_assets_b")
    outcomes = (
        cells.where("in_trend_window")
        .groupBy("company")
        .agg(
            F.sum("resolved_complaints").alias("resolved"),
            F.sum("relief_n").alias("monetary_relief"),
            F.sum("late_n").alias("untimely"),
        )
    )
    combined = settle(
        peers.join(outcomes, "company").select(
            *peers.columns,
            ratio(F.col("total_complaints"), F.col("total_assets_b"), 3).alias("complaints_per_1b_assets"),
            "resolved",
            percent_of(F.col("monetary_relief"), F.col("resolved"), 3).alias("monetary_relief_rate"),
            percent_of(F.col("untimely"), F.col("resolved"), 3).alias("untimely_rate"),
        )
    )
    mean = combined.agg(F.avg("complaints_per_1b_assets").alias("m")).scalar()
    placed, at = with_positions(
        combined,
        "company",
        {"volume": -F.col("total_complaints"), "size": -F.col("complaints_per_1b_assets")},
    )
    gap = at["volume"].rank() - at["size"].rank()
    verdict = (
        F.when(gap >= 5, "UNDERSTATED by volume")
        .when(gap <= -5, "overstated by volume")
        .otherwise("consistent")
    )
    return placed.select(
        at["size"].rank().alias("size_adjusted_rank"),
        at["volume"].rank().alias("volume_rank"),
        gap.alias("rank_gap"),
        verdict.alias("volume_vs_size_verdict"),
        "company",
        "fdic_name",
        "n_charters",
        "total_complaints",
        "total_assets_b",
        "complaints_per_1b_assets",
        ratio(F.col("complaints_per_1b_assets"), mean, 2).alias("x_peer_average"),
        rounded(mean, 3).alias("peer_avg_rate"),
        "resolved",
        "monetary_relief_rate",
        "untimely_rate",
        "match_method",
    ).orderBy("size_adjusted_rank", "company")


def issue_counts(facts: DataFrame, by: list[str], floor: int) -> DataFrame:
    """Trend-window counts per product and issue, groups under the floor left out."""
    return (
        facts.where("in_trend_window")
        .groupBy(*by, "issue")
        .agg(
            F.count("*").alias("complaints"),
            *counted(
                resolved="is_resolved",
                monetary_relief="got_monetary_relief",
                untimely="is_untimely",
                servicemember="is_servicemember",
                older_american="is_older_american",
            ),
        )
        .where(F.col("complaints") >= floor)
    )


def top_issues(facts: DataFrame, floor: int = 50, top: int = 10) -> DataFrame:
    """Q5: largest issues of each product; ``product_total`` counts the listed issues only."""
    n, resolved = F.col("complaints"), F.col("resolved")
    product = Window.partitionBy("product")
    scored = issue_counts(facts, ["product", "product_short"], floor).withColumns(
        {
            "product_total": F.sum(n).over(product),
            "rank_by_volume": F.row_number().over(product.orderBy(F.desc("complaints"), "issue")),
            "rank_by_relief_count": F.row_number().over(
                product.orderBy(F.desc("monetary_relief"), "issue")
            ),
        }
    )
    return (
        scored.where(F.col("rank_by_volume") <= top)
        .select(
            "product",
            "product_short",
            F.col("rank_by_volume").cast("long").alias("rank_by_volume"),
            "issue",
            "complaints",
            percent_of(n, F.col("product_total")).alias("pct_of_product"),
            "product_total",
            "resolved",
            "monetary_relief",
            percent_of(F.col("monetary_relief"), resolved).alias("relief_rate"),
            percent_of(F.col("untimely"), resolved).alias("untimely_rate"),
            percent_of(F.col("servicemember"), n).alias("pct_servicemember"),
            percent_of(F.col("older_american"), n).alias("pct_older_american"),
            F.col("rank_by_relief_count").cast("long").alias("rank_by_relief_count"),
            (F.col("rank_by_volume") - F.col("rank_by_relief_count"))
            .cast("long")
            .alias("volume_vs_relief_rank_gap"),
        )
        .orderBy("product", "rank_by_volume")
    )


def top_issue_per_product(facts: DataFrame, top: int) -> DataFrame:
    """The ``top`` issues of each product and nothing else (rank pruned before the shuffle)."""
    line = Window.partitionBy("product").orderBy(F.desc("complaints"), "issue")
    counts = facts.where("in_trend_window").groupBy("product", "issue").agg(F.count("*").alias("complaints"))
    return counts.withColumn("place", F.row_number().over(line).cast("long")).where(F.col("place") <= top)


def state_totals(facts: DataFrame) -> DataFrame:
    """Per state: volume, outcomes, companies, lag, and its top issue and product.

    One scan feeds three groupings of each state (by company, issue, product).
    """
    scope = facts.where("in_trend_window AND state_type = 'state'")
    keys = ["state", "company", "issue", "product_short"]
    cells = scope.groupingSets(
        [[F.col("state"), F.col(k)] for k in keys[1:]], *[F.col(k) for k in keys]
    ).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("n"),
        *counted(
            resolved="is_resolved", monetary_relief="got_monetary_relief", untimely="is_untimely"
        ),
        *lag_parts(),
    )
    # A grouping id has one bit per key, set where the key is rolled up.
    by_company, by_issue, by_product = (F.col("_set") == bits for bits in (0b0011, 0b0101, 0b0110))

    def once(name: str):
        return F.sum(F.when(by_company, F.col(name))).alias(name)

    def lead(which, attribute: str):
        order = F.when(which, F.struct(-F.col("n"), F.col(attribute)))
        return F.min_by(F.struct(F.col(attribute).alias("name"), "n"), order)

    return cells.groupBy("state").agg(
        F.sum(F.when(by_company, F.col("n"))).alias("complaints"),
        *[once(c) for c in ("resolved", "monetary_relief", "untimely", "lag_sum", "lag_n")],
        F.count_if(by_company & F.col("company").isNotNull()).alias("companies"),
        lead(by_issue, "issue").alias("_issue"),
        lead(by_product, "product_short").alias("_product"),
    )


def state_profile(facts: DataFrame) -> DataFrame:
    """Q6: state profile with dominant issue and product; rates divide by resolved.

    The windows span all states, a few dozen rows whatever the size of the facts.
    """
    n, resolved, nation = F.col("complaints"), F.col("resolved"), Window.partitionBy()
    relief = F.col("monetary_relief")
    relief_share = F.try_divide(100.0 * relief, resolved.cast("double"))
    nation_share = F.try_divide(
        100.0 * F.sum(relief).over(nation), F.sum(resolved).over(nation).cast("double")
    )
    return (
        state_totals(facts)
        .select(
            F.rank().over(Window.orderBy(F.desc("complaints"))).cast("long").alias("volume_rank"),
            "state",
            "complaints",
            percent_of(n, F.sum(n).over(nation), 3).alias("pct_of_national"),
            F.col("companies").alias("companies_complained_about"),
            F.col("_issue.name").alias("top_issue"),
            F.col("_issue.n").alias("top_issue_complaints"),
            percent_of(F.col("_issue.n"), n).alias("top_issue_pct"),
            F.col("_product.name").alias("top_product"),
            percent_of(F.col("_product.n"), n).alias("top_product_pct"),
            percent_of(relief, resolved).alias("monetary_relief_rate"),
            percent_of(F.col("untimely"), resolved).alias("untimely_rate"),
            lag_mean(2).alias("avg_days_to_company"),
            rounded(relief_share - nation_share, 2).alias("relief_rate_vs_national"),
        )
        .orderBy("volume_rank", "state")
    )


def monthly_overall(facts: DataFrame) -> DataFrame:
    """Whole-market monthly series; rates divide by resolved."""
    monthly = (
        facts.where("in_trend_window")
        .groupBy("year_month")
        .agg(
            F.count("*").alias("complaints"),
            *counted(
                monetary_relief="got_monetary_relief", untimely="is_untimely", resolved="is_resolved"
            ),
        )
    )
    return monthly.withColumns(
        {
            "month_dt": month_start(F.col("year_month")),
            "relief_rate": percent_of(F.col("monetary_relief"), F.col("resolved"), 4),
            "untimely_rate": percent_of(F.col("untimely"), F.col("resolved"), 4),
        }
    )
