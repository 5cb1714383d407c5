"""Sentinel fills, outcome flags and data-quality flags of a complaint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.numbers import flag

# Sentinels and response labels.
SENTINELS = {
    "sub_issue": "Not specified",
    "sub_product": "Not specified",
    "issue": "Not specified",
    "company_public_response": "No public response provided",
    "company_response": "Unknown",
    "tags": "No tag",
    "timely": "Unknown",
}
TRIMMED_COLUMNS = ["product", "submitted_via", *SENTINELS]
UNRESOLVED = ["In progress", "Unknown"]
MONETARY = "Closed with monetary relief"
NON_MONETARY = "Closed with non-monetary relief"
EXPLAINED = "Closed with explanation"
DISPUTED = "Company disputes the facts presented in the complaint"
LONG_LAG_DAYS = 365


def filled(name: str) -> Column:
    """Trimmed text with the column's sentinel in place of null."""
    text = F.trim(F.col(name))
    return F.coalesce(text, F.lit(SENTINELS[name])) if name in SENTINELS else text


def tag_flags(tags: Column) -> dict[str, Column]:
    return {
        "is_servicemember": flag(F.contains(tags, F.lit("Servicemember"))),
        "is_older_american": flag(F.contains(tags, F.lit("Older American"))),
    }


def outcome_flags(response: Column, public_response: Column, timely: Column) -> dict[str, Column]:
    """Six booleans; a null input never counts as an outcome."""
    return {
        "is_resolved": flag(~response.isin(UNRESOLVED)),
        "got_monetary_relief": flag(response == MONETARY),
        "got_any_relief": flag(response.isin(MONETARY, NON_MONETARY)),
        "closed_explanation_only": flag(response == EXPLAINED),
        "is_untimely": flag(timely == "No"),
        "company_disputes_facts": flag(public_response == DISPUTED),
    }


def long_lag(days: Column) -> Column:
    """Routing lag over a year; an unknown lag is not long."""
    return flag(days > LONG_LAG_DAYS)
