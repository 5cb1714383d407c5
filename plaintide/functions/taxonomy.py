"""Repair of product labels that were renamed during the collection window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.numbers import constant_map

# Labels of the public complaint taxonomy.
LEGACY_CARD_LABEL = "Credit card or prepaid card"
LEGACY_CARD_DEFAULT = "Credit card"
LEGACY_CARD_SPLIT = {
    "General-purpose credit card or charge card": "Credit card",
    "Store credit card": "Credit card",
    "General-purpose prepaid card": "Prepaid card",
    "Government benefit card": "Prepaid card",
    "Gift card": "Prepaid card",
    "Payroll card": "Prepaid card",
    "Student prepaid card": "Prepaid card",
}
RENAMED_LABELS = {
    "Payday loan, title loan, or personal loan": "Payday loan, title loan, personal loan, or advance loan",
}
SHORT_LABELS = {
    "Checking or savings account": "Checking/savings",
    "Credit card": "Credit card",
    "Prepaid card": "Prepaid card",
    "Mortgage": "Mortgage",
    "Vehicle loan or lease": "Auto loan/lease",
    "Student loan": "Student loan",
    "Payday loan, title loan, personal loan, or advance loan": "Payday/personal loan",
    "Debt or credit management": "Debt/credit management",
}
# The labels (two of them legacy) a bulk file is narrowed to.
PRODUCT_SCOPE = [
    "Checking or savings account",
    "Credit card",
    "Credit card or prepaid card",
    "Prepaid card",
    "Mortgage",
    "Vehicle loan or lease",
    "Student loan",
    "Payday loan, title loan, personal loan, or advance loan",
    "Payday loan, title loan, or personal loan",
    "Debt or credit management",
]


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """Value of a constant table, null for a missing or null key."""
    return F.try_element_at(constant_map(table), key)


def split_target(product: Column, sub_product: Column) -> Column:
    """Modern label a legacy card row maps to by sub-product; null otherwise."""
    return F.when(product == LEGACY_CARD_LABEL, looked_up(sub_product, LEGACY_CARD_SPLIT))


def modern_product(product: Column, sub_product: Column) -> Column:
    """Current label: legacy cards split by sub-product, pure renames applied."""
    card = F.coalesce(split_target(product, sub_product), F.lit(LEGACY_CARD_DEFAULT))
    return F.when(product == LEGACY_CARD_LABEL, card).otherwise(
        F.coalesce(looked_up(product, RENAMED_LABELS), product)
    )


def has_legacy_label(product: Column) -> Column:
    """True for rows whose product label the repair touches."""
    return F.coalesce(product.isin(LEGACY_CARD_LABEL, *RENAMED_LABELS), F.lit(False))


def short_product(product: Column) -> Column:
    """Chart label; a product without one keeps its own name."""
    return F.coalesce(looked_up(product, SHORT_LABELS), product)
