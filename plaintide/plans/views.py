"""The four named views, their filters and the relations behind the dashboard sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions.numbers import percent_of, rounded
from plaintide.operators.aggregates import lag_mean
from plaintide.operators.ranking import with_positions
from plaintide.plans.analyses import issue_counts, monthly_by_product, state_totals
from plaintide.session import settle

# Plain-language reasons shown for a missing size adjustment.
STATUS_BY_METHOD = {
    "known_non_bank": "Non-bank: no FDIC charter",
    "ncua_credit_union": "Credit union: NCUA-insured, not in FDIC data",
    "inactive_charter": "Charter no longer active (merged/acquired)",
}
STATUS_MATCHED = "FDIC-insured depository"
STATUS_OTHER = "No confident FDIC match"

_SUMMARY = [
    "company", "total_complaints", "resolved_complaints", "products_touched", "states_touched",
    "first_complaint", "last_complaint", "monetary_relief_rate", "any_relief_rate", "pct_no_relief",
    "explanation_only_rate", "untimely_rate", "disputes_facts_rate", "avg_days_to_company",
    "median_days_to_company", "p90_days_to_company", "pct_servicemember", "pct_older_american",
]


def company_summary(profile: DataFrame, floor: int = 500) -> DataFrame:
    """V1: scored companies. Both headline ranks and their gap use the matched cohort only."""
    rows = settle(profile.where(F.col("total_complaints") >= floor))
    cohort = F.col("matched") & F.col("complaints_per_1b_assets").isNotNull()
    status = F.when(F.col("matched"), STATUS_MATCHED)
    for method, text in STATUS_BY_METHOD.items():
        status = status.when(F.col("match_method") == method, text)
    ranked, at = with_positions(
        rows,
        "company",
        {
            "overall": -F.col("total_complaints"),
            "volume": F.when(cohort, -F.col("total_complaints")),
            "size": F.when(cohort, -F.col("complaints_per_1b_assets")),
        },
    )
    return ranked.select(
        *_SUMMARY,
        F.col("matched").alias("is_fdic_matched"),
        "fdic_name",
        "total_assets_b",
        "n_charters",
        "complaints_per_1b_assets",
        "conduct_risk_score",
        "exposure_risk_score",
        "risk_tier",
        status.otherwise(STATUS_OTHER).alias("fdic_status"),
        at["overall"].rank().alias("overall_volume_rank"),
        at["volume"].rank().alias("volume_rank"),
        at["size"].rank().alias("size_adjusted_rank"),
        (at["volume"].rank() - at["size"].rank()).alias("rank_gap"),
    )


_DETAIL = [
    "complaint_id", "date_received", "year", "month", "year_month", "product", "product_short",
    "sub_product", "issue", "sub_issue", "company", "state", "state_type", "zip3", "submitted_via",
    "company_response", "company_public_response", "timely", "tags", "is_servicemember",
    "is_older_american", "has_narrative", "days_to_company", "is_resolved", "got_monetary_relief",
    "got_any_relief", "is_untimely", "closed_explanation_only",
]


def complaints_enriched(facts: DataFrame, enriched: DataFrame, profile: DataFrame) -> DataFrame:
    """V2: trend-window facts with company attributes.

    The two company tables join each other first, so the facts meet one side
    only. Whether that side is broadcast is the planner's choice by its size.
    """
    attributes = enriched.select(
        "company", F.col("matched").alias("is_fdic_matched"), "fdic_name", "total_assets_b"
    ).join(
        profile.select("company", "conduct_risk_score", "exposure_risk_score", "risk_tier"),
        "company",
        "left",
    )
    return facts.where("in_trend_window").select(_DETAIL).join(attributes, "company", "left").select(
        *_DETAIL, *attributes.columns[1:]
    )


def monthly_view(facts: DataFrame) -> DataFrame:
    """V3: product by month; both rates divide by resolved."""
    n, line = F.col("complaints"), Window.partitionBy("product").orderBy("year_month")
    previous = F.lag(n).over(line)
    return monthly_by_product(facts).withColumns(
        {
            "monetary_relief_rate": percent_of(F.col("monetary_relief"), F.col("resolved")),
            "untimely_rate": percent_of(F.col("untimely"), F.col("resolved")),
            "prev_month": previous,
            "mom_pct_change": percent_of(n - previous, previous),
            "moving_avg_3m": rounded(F.avg(n).over(line.rowsBetween(-2, 0)), 1),
        }
    )


def state_view(facts: DataFrame) -> DataFrame:
    """V4: one row per state; the window spans a few dozen states."""
    n = F.col("complaints")
    return state_totals(facts).select(
        "state",
        "complaints",
        "companies",
        percent_of(n, F.sum(n).over(Window.partitionBy()), 3).alias("pct_of_national"),
        percent_of(F.col("monetary_relief"), F.col("resolved")).alias("monetary_relief_rate"),
        percent_of(F.col("untimely"), F.col("resolved")).alias("untimely_rate"),
        lag_mean(2).alias("avg_days_to_company"),
        F.col("_issue.name").alias("top_issue"),
        F.col("_product.name").alias("top_product"),
    )


def issue_export(facts: DataFrame, floor: int = 50) -> DataFrame:
    """X1: issues per short product label over the floor."""
    return issue_counts(facts, ["product_short"], floor).select(
        "product_short",
        "issue",
        "complaints",
        "monetary_relief",
        percent_of(F.col("monetary_relief"), F.col("resolved")).alias("relief_rate"),
    )


def cross_filter(
    view: DataFrame,
    products: list[str] | None = None,
    states: list[str] | None = None,
    months: tuple[str, str] | None = None,
    tiers: list[str] | None = None,
    matched: bool | None = None,
    company: str | None = None,
) -> DataFrame:
    """Dashboard filters on any view that carries the columns involved."""
    for column, values in (("product_short", products), ("state", states), ("risk_tier", tiers)):
        if values is not None:
            view = view.where(F.col(column).isin(values))
    if months is not None:
        view = view.where(F.col("year_month").between(*months))
    if matched is not None:
        view = view.where(F.col("is_fdic_matched") == matched)
    if company is not None:
        view = view.where(F.col("company") == company)
    return view


def top_size_adjusted(summary: DataFrame, top: int = 15) -> DataFrame:
    """Matched companies with the highest rate per $1B."""
    rate = F.col("complaints_per_1b_assets")
    return (
        summary.where(F.col("is_fdic_matched") & rate.isNotNull())
        .orderBy(F.desc("complaints_per_1b_assets"), "company")
        .limit(top)
        .select("company", "complaints_per_1b_assets", "rank_gap", "total_complaints", "fdic_status")
    )


def resolution_quadrant(summary: DataFrame) -> DataFrame:
    """Companies against the median relief and untimely rates; low relief and late is worst."""
    summary = settle(summary.select("company", "total_complaints", "monetary_relief_rate", "untimely_rate"))
    relief, late = F.col("monetary_relief_rate"), F.col("untimely_rate")
    medians = summary.agg(
        F.percentile(relief, F.lit(0.5)).alias("relief"), F.percentile(late, F.lit(0.5)).alias("late")
    )
    relief_line, late_line = medians.select("relief").scalar(), medians.select("late").scalar()
    corner = (
        F.when(relief.isNull() | late.isNull(), F.lit(None).cast("string"))
        .when((relief < relief_line) & (late > late_line), "low relief, late")
        .when(relief < relief_line, "low relief, on time")
        .when(late > late_line, "high relief, late")
        .otherwise("high relief, on time")
    )
    return summary.select(
        "*",
        rounded(relief_line, 3).alias("median_relief_rate"),
        rounded(late_line, 3).alias("median_untimely_rate"),
        corner.alias("quadrant"),
    )
