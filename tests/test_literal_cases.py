"""Hand-made rows for every scalar rule."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plaintide.functions import dates, geography, names, numbers, outcomes, taxonomy
from plaintide.operators.chi_tail import _gamma_tail
from plaintide.operators.similarity import common_subsequence, token_set_score
from plaintide.plans import scoring, statistics


def one(spark, value, build, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ("INDEPENDENT BANK CORP.", "INDEPENDENT BANK GROUP, INC."),
        ("AMERICAN BANCSHARES MORTGAGE, LLC", "AMERICAN FINANCIAL MORTGAGE COMPANY"),
        ("First Credit Corporation", "First Financial Credit, Inc"),
    ],
)
def test_distinct_companies_keep_distinct_keys(spark, left, right):
    assert one(spark, left, names.company_key) != one(spark, right, names.company_key)


@pytest.mark.parametrize(
    ("left", "right", "key"),
    [
        ("Foo Bank Corp., Inc.", "foo bank", "FOO BANK"),
        ("AmeriFirst Financial Corporation", "AMERIFIRST FINANCIAL, INC.", "AMERIFIRST FINANCIAL"),
        ("Time Investment Corporation", "The Time Investment Company, Inc.", "TIME INVESTMENT"),
        ("A B L.L.C.", "A-B L L C", "A B"),
        ("X National Association N.A.", "x", "X"),
    ],
)
def test_same_company_same_key(spark, left, right, key):
    assert one(spark, left, names.company_key) == one(spark, right, names.company_key) == key


def test_key_peels_like_a_loop(spark):
    """One regex removes what peeling a form at a time removes."""
    import random
    import re

    rng = random.Random(7)
    words = [*names.LEGAL_FORMS, "BANK", "GROUP", "A", "N", "L", "C", "THE"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(3000)]
    form = re.compile(r"\s+(" + "|".join(names.LEGAL_FORMS) + r")$")

    def peeled(text):
        text = re.sub(r"^THE\s+", "", text)
        while form.search(text):
            text = form.sub("", text).strip()
        return text

    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", names.company_key(F.col("x")).alias("y")).collect()}
    assert all(got[t] == peeled(t) for t in texts)


def test_null_company_has_null_key(spark):
    assert one(spark, None, names.company_key) is None


@pytest.mark.parametrize(
    ("name", "norm"),
    [
        ("PNC Bank N.A.", "PNC BANK NATIONAL ASSOCIATION"),
        ("PNC Bank, National Association", "PNC BANK NATIONAL ASSOCIATION"),
        ("The Foo & Bar Svgs Bk, Inc.", "FOO BAR SAVINGS BANK"),
        ("First FINL BCORP The", "FIRST FINANCIAL BANCORP"),
        ("Acme CU", "ACME CREDIT UNION"),
        (None, ""),
    ],
)
def test_match_name(spark, name, norm):
    assert one(spark, name, names.match_name) == norm


def test_significant_tokens(spark):
    assert one(spark, "FIFTH THIRD BANK NATIONAL ASSOCIATION US 12 FIFTH", names.significant_tokens) == ["FIFTH", "THIRD"]


@pytest.mark.parametrize(
    ("sub", "product"),
    [
        ("Store credit card", "Credit card"),
        ("General-purpose credit card or charge card", "Credit card"),
        ("Gift card", "Prepaid card"),
        ("Payroll card", "Prepaid card"),
        ("something else", "Credit card"),
        (None, "Credit card"),
    ],
)
def test_legacy_card_split(spark, sub, product):
    build = lambda x: taxonomy.modern_product(F.lit(taxonomy.LEGACY_CARD_LABEL), x)
    assert one(spark, sub, build) == product


def test_rename_short_label_and_passthrough(spark):
    old, new = next(iter(taxonomy.RENAMED_LABELS.items()))
    build = lambda x: taxonomy.modern_product(x, F.lit(None).cast("string"))
    assert one(spark, old, build) == new
    assert one(spark, "Mortgage", build) == "Mortgage"
    assert one(spark, new, taxonomy.short_product) == "Payday/personal loan"
    assert one(spark, "Unheard of", taxonomy.short_product) == "Unheard of"
    assert one(spark, None, taxonomy.has_legacy_label) is False


@pytest.mark.parametrize(
    ("raw", "prefix", "masked"),
    [("604XX", "604", True), ("00701", "007", False), ("xx", None, True), (None, None, False), (" 1a2 ", None, False)],
)
def test_postcodes(spark, raw, prefix, masked):
    assert one(spark, raw, lambda x: geography.postcode_prefix(geography.postcode(x))) == prefix
    assert one(spark, raw, lambda x: geography.postcode_masked(geography.postcode(x))) is masked


@pytest.mark.parametrize(
    ("raw", "code", "kind"),
    [
        (" ca", "CA", "state"),
        ("United States Minor Outlying Islands", "UM", "territory"),
        ("AE", "AE", "military"),
        ("QQ", "QQ", "unknown"),
        (None, None, "unknown"),
    ],
)
def test_states(spark, raw, code, kind):
    assert one(spark, raw, geography.state_code) == code
    assert one(spark, raw, lambda x: geography.state_type(geography.state_code(x))) == kind


def test_flags_are_never_null(spark):
    null = F.lit(None).cast("string")
    flags = outcomes.outcome_flags(null, null, null) | outcomes.tag_flags(null)
    row = spark.range(1).select(*[c.alias(n) for n, c in flags.items()]).first()
    assert set(row.asDict().values()) == {False}
    assert one(spark, None, outcomes.long_lag, "x double") is False
    assert one(spark, None, lambda x: dates.after_window(x, "2025-12-31"), "x date") is False


def test_timestamps_and_lag(spark):
    df = spark.createDataFrame(
        [("2024-01-01T12:00:00-05:00", "2024-01-03T05:00:00Z"), ("n/a", "2024-01-01")], "a string, b string"
    )
    lag = dates.days_between(dates.utc_timestamp(F.col("a")), dates.utc_timestamp(F.col("b")))
    rows = df.select(lag.alias("d"), dates.year_month(dates.utc_timestamp(F.col("a"))).alias("ym")).collect()
    assert [tuple(r) for r in rows] == [(1.5, "2024-01"), (None, None)]


@pytest.mark.parametrize(("score", "tier"), [(0, "Low"), (25, "Low"), (25.01, "Moderate"), (75, "Elevated"),
                                             (90, "High"), (90.01, "Severe"), (100, "Severe"), (None, None)])
def test_tiers_are_right_closed(spark, score, tier):
    assert one(spark, None if score is None else float(score), scoring.risk_tier, "x double") == tier


def test_rounding_and_zero_denominators(spark):
    assert one(spark, 1.005, lambda x: numbers.rounded(x, 2), "x double") == 1.01
    assert one(spark, 0, lambda x: numbers.percent_of(F.lit(3), x), "x int") is None
    assert str(one(spark, "abc", numbers.number_or_zero)) == "0.00"


def test_common_subsequence_against_table():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("ABC ", k=rng.randint(0, 12)))
        b = "".join(rng.choices("ABC ", k=rng.randint(0, 12)))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert common_subsequence(a, b) == row[-1]


def test_token_set_score():
    assert token_set_score("COMERICA", "COMERICA BANK") == 100.0
    assert token_set_score("A B C", "C B A A") == 100.0
    assert token_set_score("", "A") == 0.0
    assert token_set_score("ABCD", "WXYZ") == 0.0
    # "A" and "B" one-sided around a common "X": 2 edits in 3 + 3 letters.
    assert token_set_score("X A", "X B") == pytest.approx(100 - 100 * 2 / 6)
    assert token_set_score("OCWEN FINANCIAL", "OWEN FINANCIAL") > 92


@pytest.mark.parametrize(
    ("x", "k", "p"),
    [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (2.0, 2, 0.36787944117144233)],
)
def test_chi_square_tail(x, k, p):
    assert _gamma_tail(k / 2, x / 2) == pytest.approx(p, rel=1e-3)


@pytest.mark.parametrize(("x", "k"), [(200.0, 100), (3.0, 8), (90.0, 60), (700.0, 112)])
def test_chi_square_tail_even_degrees(x, k):
    """With even degrees of freedom the tail is a finite Poisson sum."""
    import math

    exact = math.fsum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) for i in range(k // 2))
    assert _gamma_tail(k / 2, x / 2) == pytest.approx(exact, rel=1e-9)


def test_ties_round_away_from_zero_at_any_size(spark):
    row = spark.sql("SELECT -0.125D AS a, -0.375D AS b, 1.005D AS c, 1000000000.005D AS d, 0.124999D AS e, CAST(NULL AS double) AS f")
    got = row.select(*[numbers.rounded(F.col(c), 2).alias(c) for c in row.columns]).first()
    assert tuple(got) == (-0.13, -0.38, 1.01, 1000000000.01, 0.12, None)
    share = spark.range(1).select(numbers.percent_of(F.lit(-1), F.lit(800)).alias("a"), numbers.percent_of(F.lit(-3), F.lit(800)).alias("b"))
    assert tuple(share.first()) == (-0.13, -0.38)


def test_chi_square_keeps_its_digits_at_a_hundred_billion_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        n = rng.randint(4 * 10**8, 6 * 10**8)
        rows.append((i, yes := n // 7 + rng.randint(-9000, 9000), n - yes))
    total, hits = sum(a + b for _, a, b in rows), sum(a for _, a, _ in rows)
    exact = Fraction(0)
    for _, a, b in rows:
        for o, c in ((a, hits), (b, total - hits)):
            e = Fraction((a + b) * c, total)
            exact += (o - e) ** 2 / e
    table = spark.createDataFrame(rows, "g int, yes bigint, no bigint")
    got = statistics.chi_square(table, ["yes", "no"]).first()
    assert got["n"] == total and abs(got["statistic"] - float(exact)) < 1e-6
