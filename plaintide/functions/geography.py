"""State and postcode columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.numbers import flag

# Postal codes.
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
TERRITORIES = [
    "PR", "VI", "GU", "AS", "MP", "UM", "PW", "FM", "MH",
]
MILITARY_POST = [
    "AA", "AE", "AP",
]
SPELLED_OUT = {"UNITED STATES MINOR OUTLYING ISLANDS": "UM"}
UNKNOWN_STATE = "Unknown"


def state_code(raw: Column) -> Column:
    """Trimmed upper-case code, full names mapped to codes; null stays null."""
    code = F.upper(F.trim(raw))
    for name, short in SPELLED_OUT.items():
        code = F.when(code == name, short).otherwise(code)
    return code


def state_type(code: Column) -> Column:
    """state / territory / military / unknown."""
    return (
        F.when(code.isin(US_STATES), "state")
        .when(code.isin(TERRITORIES), "territory")
        .when(code.isin(MILITARY_POST), "military")
        .otherwise("unknown")
    )


def postcode(raw: Column) -> Column:
    """Trimmed upper-case postcode, empty text when missing."""
    return F.upper(F.trim(F.coalesce(raw, F.lit(""))))


def postcode_masked(code: Column) -> Column:
    """True when digits were replaced by X for privacy."""
    return flag(F.contains(code, F.lit("X")))


def postcode_prefix(code: Column) -> Column:
    """First three characters as text (leading zeros matter) if all digits."""
    prefix = F.substring(code, 1, 3)
    return F.when(F.regexp_like(prefix, F.lit("^[0-9]{3}$")), prefix)
