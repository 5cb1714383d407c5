"""Approximate aggregates: errors within what is stated, one scan, merging as good as counting at once."""

import pytest
from pyspark.sql import functions as F

from plaintide.bindings import queries
from plaintide.bindings import tables as t
from plaintide.operators import aggregates, sketches
from plaintide.plans import analyses, enrichment

LARGE = "/root/testdata/sf0.1"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rank_errors(exact_rows, approximate, name, share):
    """How far from the share the rank of each answer is."""
    out = []
    for company, values in exact_rows.items():
        answer = approximate[company][name]
        below, upto = sum(v < answer for v in values), sum(v <= answer for v in values)
        out.append(max(0.0, below / len(values) - share, share - upto / len(values)))
    return out


def test_quantile_sketches_keep_their_rank_error(spark):
    facts = spark.range(60_000).selectExpr("id % 3 AS company", "pow(abs(hash(id)) % 100000, 1.5) AS lag")
    exact = {}
    for r in facts.collect():
        exact.setdefault(r.company, []).append(r.lag)
    points = {"p50": 0.5, "p90": 0.9, "p01": 0.01}
    got = {r.company: r for r in aggregates.group_percentiles(facts, ["company"], "lag", points, 9, approximate=True).collect()}
    for name, share in points.items():
        assert max(rank_errors(exact, got, name, share)) <= sketches.QUANTILE_ERROR
    cells = facts.withColumn("cell", F.expr("abs(hash(lag)) % 50")).groupBy("company", "cell").agg(sketches.quantile_sketch("lag").alias("s"))
    merged = cells.groupBy("company").agg(sketches.merged_quantile_sketch("s").alias("s"))
    got = {r.company: r for r in merged.select("company", *[c.alias(n) for n, c in sketches.read_quantiles("s", points, 9).items()]).collect()}
    for name, share in points.items():
        assert max(rank_errors(exact, got, name, share)) <= sketches.QUANTILE_ERROR


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 2.0, "x")], "k string, v double, s string")
    got = rows.groupBy("k").agg(sketches.quantile_sketch("v").alias("q"), sketches.distinct_sketch("s").alias("d"))
    read = got.groupBy("k", "q").agg(sketches.merged_distinct("d").alias("n")).select("k", "n", sketches.read_quantiles("q", {"m": 0.5})["m"].alias("m"))
    assert {r.k: (r.n, r.m) for r in read.collect()} == {"a": (0, None), "b": (1, 2.0)}


def test_features_read_the_facts_once(spark, sf_dir):
    facts = t.facts(spark, sf_dir, *queries._BASE_COLUMNS)
    cells = enrichment.company_cells(facts, sketches=True)
    approximate = enrichment.company_base(facts, cells, approximate=True)
    assert "lineitem" not in plan(approximate)  # the cells are written; nothing reads the facts again
    exact = {r.company: r for r in enrichment.company_base(facts, cells).collect()}
    lags = {}
    for r in facts.where("in_trend_window AND days_to_company IS NOT NULL").select("company", "days_to_company").collect():
        lags.setdefault(r.company, []).append(r.days_to_company)
    got = {r.company: r for r in approximate.collect()}
    assert got.keys() == exact.keys()
    for name, share in (("median_days_to_company", 0.5), ("p90_days_to_company", 0.9)):
        # One value more or less, as exact percentiles are interpolated.
        assert max(rank_errors(lags, got, name, share)) <= sketches.QUANTILE_ERROR + 1 / min(map(len, lags.values()))
    for company, row in got.items():
        for column in ("total_complaints", "products_touched", "states_touched", "avg_days_to_company"):
            assert row[column] == exact[company][column]


@pytest.mark.parametrize("size", [40, 5_000, 200_000])
def test_distinct_sketches_keep_their_error(spark, size):
    rows = spark.range(3 * size).selectExpr(f"concat('v', id % {size}) AS v", "id % 7 AS cell")
    cells = rows.groupBy("cell").agg(sketches.distinct_sketch("v").alias("v"))
    n = cells.agg(sketches.merged_distinct("v").alias("n")).first().n
    assert abs(n - size) <= (0 if size < 100 else 3 * sketches.DISTINCT_ERROR * size)


def test_reach_at_the_largest_scale(spark):
    facts = t.facts(spark, LARGE, "company", "product", "state", "in_trend_window")
    got = analyses.company_reach(facts)
    assert "Expand" not in plan(got)
    scope = facts.where("in_trend_window")
    exact = {("product", r.product, None): r.n for r in scope.groupBy("product").agg(F.countDistinct("company").alias("n")).collect()}
    exact |= {("state", None, r.state): r.n for r in scope.groupBy("state").agg(F.countDistinct("company").alias("n")).collect()}
    exact["nation", None, None] = scope.select("company").distinct().count()
    found = {(r.level, r.product, r.state): r.companies for r in got.collect()}
    assert found.keys() == exact.keys()
    assert all(abs(found[k] - n) <= max(1, 3 * sketches.DISTINCT_ERROR * n) for k, n in exact.items())
