"""Percentile risk scores and tiers over the company rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.functions.numbers import banded, percent_of, rounded
from plaintide.operators.ranking import Position, with_positions
from plaintide.session import settle

# Component weights and tier bounds.
CONDUCT_WEIGHTS = {
    "pct_no_relief": 0.40,
    "untimely_rate": 0.35,
    "disputes_facts_rate": 0.15,
    "avg_days_to_company": 0.10,
}
EXPOSURE_WEIGHTS = {"conduct_risk_score": 0.60, "complaints_per_1b_assets": 0.40}
TIERS = [(25.0, "Low"), (50.0, "Moderate"), (75.0, "Elevated"), (90.0, "High")]
TOP_TIER = "Severe"


def percentile_score(position: Position, higher_is_worse: bool = True) -> Column:
    """0-100 percentile with ties averaged; null where the measure is null."""
    share = position.percentile()
    return rounded(100.0 * (share if higher_is_worse else 1.0 - share), 2)


def risk_tier(score: Column) -> Column:
    """Right-closed bands of the conduct score; null stays null."""
    return banded(score, TIERS, TOP_TIER, closed=True)


def risk_profile(rates: DataFrame, floor: int = 500) -> DataFrame:
    """Rates plus percentiles, both scores and the tier.

    Companies under the floor are kept without scores. The exposure score ranks
    conduct again inside the matched cohort, so that both parts share peers.
    """
    rates = settle(rates)
    scored = F.col("total_complaints") >= floor
    placed, at = with_positions(
        rates, "company", {m: F.when(scored, F.col(m)) for m in CONDUCT_WEIGHTS}
    )
    placed = placed.withColumns({f"pctile_{m}": percentile_score(at[m]) for m in CONDUCT_WEIGHTS})
    conduct = sum(
        (F.col(f"pctile_{m}") * w for m, w in CONDUCT_WEIGHTS.items()), start=F.lit(0.0)
    )
    placed = placed.withColumn("conduct_risk_score", rounded(conduct, 2)).select(
        *rates.columns, *[f"pctile_{m}" for m in CONDUCT_WEIGHTS], "conduct_risk_score"
    )
    cohort = scored & F.col("matched") & F.col("complaints_per_1b_assets").isNotNull()
    ranked, at = with_positions(
        placed, "company", {m: F.when(cohort, F.col(m)) for m in EXPOSURE_WEIGHTS}
    )
    exposure = sum(
        (percentile_score(at[m]) * w for m, w in EXPOSURE_WEIGHTS.items()), start=F.lit(0.0)
    )
    return ranked.select(
        *placed.columns,
        percentile_score(at["complaints_per_1b_assets"]).alias("pctile_complaints_per_1b_assets"),
        rounded(exposure, 2).alias("exposure_risk_score"),
        risk_tier(F.col("conduct_risk_score")).alias("risk_tier"),
    )


def tier_distribution(profile: DataFrame) -> DataFrame:
    """Companies and complaints per tier with the share of scored companies."""
    scored = profile.where(F.col("risk_tier").isNotNull())
    tiers = scored.groupBy("risk_tier").agg(
        F.count("*").alias("companies"), F.sum("total_complaints").alias("complaints")
    )
    everyone = scored.agg(F.count("*").alias("n")).scalar()
    return tiers.withColumn("pct_of_companies", percent_of(F.col("companies"), everyone, 1))


def component_spread(rates: DataFrame, floor: int = 500) -> DataFrame:
    """Median and 90th percentile of each score component over the scored cohort."""
    scored = rates.where(F.col("total_complaints") >= floor)
    one = scored.agg(
        *[
            F.percentile(m, F.array(F.lit(0.5), F.lit(0.9))).alias(m)
            for m in CONDUCT_WEIGHTS
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("component"),
                F.lit(w).alias("weight"),
                rounded(F.get(F.col(m), F.lit(0)), 3).alias("median"),
                rounded(F.get(F.col(m), F.lit(1)), 3).alias("p90"),
            )
            for m, w in CONDUCT_WEIGHTS.items()
        ]
    )
    return one.select(F.inline(rows))
