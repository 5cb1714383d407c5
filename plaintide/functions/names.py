"""Company-name keys, match normalisation and token sets, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.numbers import constant_map, flag, quoted

# Legal forms removed only at the end of a name. Words such as
# GROUP or BANCORP tell institutions apart and are not in the list.
LEGAL_FORMS = [
    "INCORPORATED", "INC", "CORPORATION", "CORP", "COMPANY", "CO", "LLC", "L L C", "LLP", "LP",
    "L P", "LTD", "LIMITED", "PLC", "NATIONAL ASSOCIATION", "N A", "NA", "FSB", "SSB",
]

# Abbreviations of institution registers and their long forms.
ABBREVIATIONS = {
    "BCORP": "BANCORP", "BC": "BANCORP", "BSHRS": "BANCSHARES", "BSHS": "BANCSHARES",
    "FINL": "FINANCIAL", "FNCL": "FINANCIAL", "NATL": "NATIONAL", "NTNL": "NATIONAL",
    "SVGS": "SAVINGS", "SVG": "SAVINGS", "MTG": "MORTGAGE", "GRP": "GROUP",
    "INTL": "INTERNATIONAL", "BK": "BANK", "BKS": "BANKS", "BKG": "BANKING", "TR": "TRUST",
    "ASSN": "ASSOCIATION", "CORP": "CORPORATION", "CO": "COMPANY", "INC": "INCORPORATED",
    "SVC": "SERVICE", "SVCS": "SERVICES", "MUT": "MUTUAL", "FED": "FEDERAL",
    "CU": "CREDIT UNION", "HLDG": "HOLDING", "HLDGS": "HOLDINGS", "AMER": "AMERICAN",
}

# Legal-form tokens without identity, dropped before matching.
DROPPED_TOKENS = [
    "INCORPORATED", "CORPORATION", "COMPANY", "LLC", "LP", "LLP", "PLC", "LTD", "LIMITED", "AND",
    "SA", "AG", "NV",
]

# Words most institution names share; never evidence of identity.
GENERIC_TOKENS = [
    "BANK", "BANKS", "BANKING", "BANC", "BANCORP", "BANCSHARES", "FINANCIAL", "FINANCE", "GROUP",
    "HOLDING", "HOLDINGS", "NATIONAL", "ASSOCIATION", "SERVICE", "SERVICES", "USA", "US",
    "AMERICA", "AMERICAN", "FEDERAL", "SAVINGS", "TRUST", "CREDIT", "UNION", "STATE", "STATES",
    "FIRST", "COMMUNITY", "COMMERCIAL", "COMMERCE", "MUTUAL", "COUNTY", "CITY", "NEW", "OLD",
    "THE", "OF", "AND", "CORPORATION", "COMPANY", "INTERNATIONAL",
]

# Marks of a credit union in a name.
CREDIT_UNION_MARKERS = ["CREDIT UNION", " FCU"]
MIN_TOKEN_LENGTH = 3


def _letters_only(text: Column) -> Column:
    """Everything but A-Z, 0-9 to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))


def collapsed(name: Column) -> Column:
    """Ends trimmed and runs of white space made one blank."""
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def company_key(name: Column) -> Column:
    """Conservative identity key: case, punctuation, leading THE, trailing legal forms.

    One regex removes stacked forms (``Corp., Inc.``) because no form is the
    token-suffix of another. A null name has a null key.
    """
    bare = F.regexp_replace(_letters_only(F.upper(name)), "^THE ", "")
    return F.regexp_replace(bare, "( (" + "|".join(LEGAL_FORMS) + "))+$", "")


def match_name(name: Column) -> Column:
    """Form in which both sides of the institution match are compared."""
    text = F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" AND "))
    text = F.regexp_replace(text, r"\bN\.\s*A\.", " NATIONAL ASSOCIATION ")
    text = F.regexp_replace(_letters_only(text), r"\bN A\b", " NATIONAL ASSOCIATION ")
    text = F.regexp_replace(F.regexp_replace(collapsed(text), "^THE ", ""), " THE$", "")
    table = constant_map(ABBREVIATIONS)
    words = F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.array_join(F.filter(words, lambda t: ~t.isin(DROPPED_TOKENS)), " ")


def significant_tokens(normal: Column) -> Column:
    """Sorted distinct tokens that can identify an institution."""
    long_enough = F.filter(F.split(normal, " "), lambda t: F.length(t) >= MIN_TOKEN_LENGTH)
    return F.array_sort(F.array_except(long_enough, F.expr(f"array({quoted(GENERIC_TOKENS)})")))


def shared_count(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two token sets; zero when both are empty."""
    return F.coalesce(
        F.try_divide(
            shared_count(left, right).cast("double"), F.size(F.array_union(left, right)).cast("double")
        ),
        F.lit(0.0),
    )


def is_credit_union(name: Column) -> Column:
    upper = F.upper(name)
    hit = F.lit(False)
    for marker in CREDIT_UNION_MARKERS:
        hit = hit | F.contains(upper, F.lit(marker))
    return flag(hit)
