"""Company-level tables: enrichment, features, outcomes and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.functions.numbers import percent_of, ratio, rounded
from plaintide.operators.aggregates import (
    counted,
    group_percentiles,
    lag_mean,
    lag_parts,
    summed,
)
from plaintide.operators.sketches import merged_quantile_sketch, quantile_sketch, read_quantiles
from plaintide.plans.entities import resolve
from plaintide.session import settle


def company_counts(facts: DataFrame) -> DataFrame:
    """Companies with their number of complaints, the left side of the match."""
    return (
        facts.where(F.col("company").isNotNull())
        .groupBy("company")
        .agg(F.count("*").alias("n_complaints"))
    )


def outcome_cells(facts: DataFrame, *by: str) -> DataFrame:
    """Counts per (company, inside the window) and further columns, written once.

    Outcomes are counted once among resolved complaints (``monetary_relief_n``, ``untimely_n``) and once
    among all (``relief_n``, ``late_n``).
    """
    resolved = F.col("is_resolved")
    cells = (
        facts.where(F.col("company").isNotNull())
        .groupBy("company", "in_trend_window", *by)
        .agg(
            F.count("*").alias("total_complaints"),
            F.sum("days_to_company").alias("all_lag_sum"),
            F.count("days_to_company").alias("all_lag_n"),
            F.count_if(resolved).alias("resolved_complaints"),
            F.count_if(resolved & F.col("got_monetary_relief")).alias("monetary_relief_n"),
            F.count_if(resolved & F.col("is_untimely")).alias("untimely_n"),
            *counted(relief_n="got_monetary_relief", late_n="is_untimely"),
        )
    )
    return settle(cells, "outcome-cells")


def company_totals(facts: DataFrame) -> DataFrame:
    """Counts and rates per company over the full period.

    The mean lag includes long-lag rows here; rates divide by resolved.
    """
    return totals_of(outcome_cells(facts))


def _finished_totals(totals: DataFrame) -> DataFrame:
    # A company without resolved complaints has unknown, not zero, outcomes.
    any_resolved = F.col("_resolved") > 0
    return totals.select(
        "company",
        "total_complaints",
        "complaints_in_trend_window",
        ratio(F.col("_lag"), F.col("_lags"), 3).alias("avg_days_to_company"),
        F.when(any_resolved, F.col("_resolved")).alias("resolved_complaints"),
        F.when(any_resolved, F.col("_relief")).alias("monetary_relief_n"),
        F.when(any_resolved, F.col("_untimely")).alias("untimely_n"),
        percent_of(F.col("_relief"), F.col("_resolved"), 3).alias("monetary_relief_rate"),
        percent_of(F.col("_untimely"), F.col("_resolved"), 3).alias("untimely_rate"),
    )


def totals_of(cells: DataFrame) -> DataFrame:
    """The totals, from the cells of ``company_cells`` or ``outcome_cells``."""
    inside = F.when(F.col("in_trend_window"), F.col("total_complaints"))
    totals = cells.groupBy("company").agg(
        F.sum("total_complaints").alias("total_complaints"),
        F.coalesce(F.sum(inside), F.lit(0)).alias("complaints_in_trend_window"),
        F.sum("all_lag_sum").alias("_lag"),
        F.sum("all_lag_n").alias("_lags"),
        F.sum("resolved_complaints").alias("_resolved"),
        F.sum("monetary_relief_n").alias("_relief"),
        F.sum("untimely_n").alias("_untimely"),
    )
    return _finished_totals(totals)


def company_enriched(totals: DataFrame, matches: DataFrame) -> DataFrame:
    """Company totals with the institution group each company was matched to."""
    matched = F.coalesce("matched", F.lit(False))
    return (
        totals.join(matches.drop("n_complaints", "match_note"), "company", "left")
        .withColumn("matched", matched)
        .select(
            *totals.columns,
            "matched",
            "fdic_name",
            "group_key",
            "total_assets_b",
            "n_charters",
            "match_score",
            "match_method",
            F.when(matched, ratio(F.col("total_complaints"), F.col("total_assets_b"), 3)).alias(
                "complaints_per_1b_assets"
            ),
        )
    )


def enrich(facts: DataFrame, institutions: DataFrame, fuzzy: bool = True, near_misses: bool = True) -> DataFrame:
    """Totals, match and enriched table with one scan of the facts."""
    return enrich_totals(company_totals(facts), institutions, fuzzy, near_misses)


def enrich_totals(totals: DataFrame, institutions: DataFrame, fuzzy: bool = True, near_misses: bool = True) -> DataFrame:
    """Match and enriched table of company totals; for ``near_misses`` see ``entities.resolve``."""
    totals = settle(totals, "totals")
    companies = totals.select("company", F.col("total_complaints").alias("n_complaints"))
    return company_enriched(totals, resolve(companies, institutions, fuzzy=fuzzy, near_misses=near_misses))


_OUTCOMES = {
    "monetary_relief_n": "got_monetary_relief",
    "any_relief_n": "got_any_relief",
    "explanation_only_n": "closed_explanation_only",
    "untimely_n": "is_untimely",
    "disputes_facts_n": "company_disputes_facts",
}
FEATURES = [
    "company", "total_complaints", "products_touched", "states_touched", "first_complaint",
    "last_complaint", "servicemember_complaints", "older_american_complaints", "with_narrative",
    "avg_days_to_company", "median_days_to_company", "p90_days_to_company",
]


def _resolved_outcomes():
    resolved = F.col("is_resolved")
    return [F.count_if(resolved).alias("resolved_complaints")] + [
        F.count_if(resolved & F.col(flag)).alias(name) for name, flag in _OUTCOMES.items()
    ]


def company_cells(facts: DataFrame, sketches: bool = False) -> DataFrame:
    """Counts per (company, product, home state, inside the window), written once.

    Totals, features and outcomes of companies are sums of these cells, so that the facts
    are read once for all of them. ``sketches`` adds a quantile sketch of the lags to each
    cell, from which approximate percentiles come without a second scan.
    """
    lags = [quantile_sketch("days_to_company").alias("lag_sketch")] if sketches else []
    cells = (
        facts.where(F.col("company").isNotNull())
        .withColumn("home_state", F.when(F.col("state_type") == "state", F.col("state")))
        .groupBy("company", "product", "home_state", "in_trend_window")
        .agg(
            F.count("*").alias("total_complaints"),
            *counted(
                servicemember_complaints="is_servicemember",
                older_american_complaints="is_older_american",
                with_narrative="has_narrative",
            ),
            *_resolved_outcomes(),
            *lag_parts(),
            F.sum("days_to_company").alias("all_lag_sum"),
            F.count("days_to_company").alias("all_lag_n"),
            F.min("date_received").alias("first_complaint"),
            F.max("date_received").alias("last_complaint"),
            *lags,
        )
    )
    return settle(cells, "company-cells")


def company_base(
    facts: DataFrame, cells: DataFrame | None = None, percentiles: bool = True, approximate: bool = False
) -> DataFrame:
    """Features and resolved outcomes of each company in the trend window.

    Counts and breadth come from the cells, the lag percentiles from (company, lag) counts
    of three narrow columns; without ``percentiles`` these stay null and the facts are
    not read again. ``approximate`` takes them from the sketches of the cells instead.
    """
    cells = company_cells(facts, sketches=approximate) if cells is None else cells
    outcome_names = ["resolved_complaints", *_OUTCOMES]
    counts = [
        "total_complaints", "servicemember_complaints", "older_american_complaints", "with_narrative",
        *outcome_names, "lag_sum", "lag_n",
    ]
    breadth = (
        cells.where("in_trend_window")
        .groupBy("company")
        .agg(
            *summed(*counts),
            F.countDistinct("product").alias("products_touched"),
            F.countDistinct("home_state").alias("states_touched"),
            F.min("first_complaint").alias("first_complaint"),
            F.max("last_complaint").alias("last_complaint"),
        )
        .withColumn("avg_days_to_company", lag_mean(3))
    )
    points = {"median_days_to_company": 0.5, "p90_days_to_company": 0.9}
    if percentiles and approximate:
        merged = cells.where("in_trend_window").groupBy("company").agg(merged_quantile_sketch("lag_sketch").alias("lags"))
        found = [c.alias(name) for name, c in read_quantiles("lags", points).items()]
        breadth = breadth.join(merged.select("company", *found), "company", "left")
    elif percentiles:
        scope = facts.where("in_trend_window AND company IS NOT NULL")
        breadth = breadth.join(group_percentiles(scope, ["company"], "days_to_company", points), "company", "left")
    else:
        breadth = breadth.withColumns({name: F.lit(None).cast("double") for name in points})
    return breadth.select(*FEATURES, *outcome_names)


def company_features(facts: DataFrame, approximate: bool = False) -> DataFrame:
    return company_base(facts, approximate=approximate).select(FEATURES)


def company_outcomes(facts: DataFrame) -> DataFrame:
    """Outcome counts of resolved complaints in the trend window."""
    return (
        facts.where("in_trend_window AND is_resolved AND company IS NOT NULL")
        .groupBy("company")
        .agg(F.count("*").alias("resolved_complaints"), *counted(**_OUTCOMES))
    )


def company_rates(base: DataFrame, enriched: DataFrame) -> DataFrame:
    """Features, outcomes, match columns and nine rates per company.

    Outcome rates divide by resolved, the two population shares by all complaints.
    """
    attributes = enriched.select(
        "company", "matched", "fdic_name", "total_assets_b", "n_charters", "match_method"
    )
    resolved, total = F.col("resolved_complaints"), F.col("total_complaints")
    matched = F.coalesce("matched", F.lit(False))

    def of_resolved(name: str):
        return percent_of(F.col(name), resolved, 3)

    outcome_names = ["resolved_complaints", *_OUTCOMES]
    return (
        base.join(attributes, "company", "left")
        .withColumns(
            {
                "monetary_relief_rate": of_resolved("monetary_relief_n"),
                "any_relief_rate": of_resolved("any_relief_n"),
                "pct_no_relief": rounded(100.0 - of_resolved("any_relief_n"), 3),
                "explanation_only_rate": of_resolved("explanation_only_n"),
                "untimely_rate": of_resolved("untimely_n"),
                "disputes_facts_rate": of_resolved("disputes_facts_n"),
                "pct_servicemember": percent_of(F.col("servicemember_complaints"), total, 3),
                "pct_older_american": percent_of(F.col("older_american_complaints"), total, 3),
                "complaints_per_1b_assets": F.when(
                    matched, ratio(total, F.col("total_assets_b"), 3)
                ),
                "matched": matched,
            }
        )
        .withColumns({c: F.when(resolved > 0, F.col(c)) for c in outcome_names})
    )
