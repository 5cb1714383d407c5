"""Rank operators: both paths, ties, nulls, signs and partition counts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plaintide.operators import ranking
from plaintide.plans import scoring
from plaintide.session import settle


@pytest.fixture(scope="module")
def values():
    rng = random.Random(11)
    base = [rng.choice([0.0, -0.0, 1.5, -2.25, 1e-9, 3e8, -3e8, 7.0, None]) for _ in range(150)]
    base += [round(rng.uniform(-50, 50), 3) for _ in range(150)]
    base += [64.0 + i / 1000 for i in range(100)] + [42.0] * 200
    return pd.DataFrame({"id": range(len(base)), "v": base})


def test_positions_match_pandas(spark, values):
    df = settle(spark.createDataFrame(values.astype(object).where(values.notna(), None), "id int, v double"))
    placed, at = ranking.with_positions(df, "id", {"up": F.col("v"), "down": -F.col("v")})
    got = (
        placed.select(
            "id", at["up"].rank().alias("rank"), at["up"].dense_rank().alias("dense"),
            at["up"].average_rank().alias("avg"), at["up"].percentile().alias("pct"),
            at["down"].rank().alias("down"), at["up"].percent_rank().alias("pr"),
        )
        .toPandas()
        .sort_values("id")
        .reset_index(drop=True)
    )
    v = values["v"].astype(float)
    for column, expected in {
        "rank": v.rank(method="min"), "dense": v.rank(method="dense"), "avg": v.rank(),
        "pct": v.rank(pct=True), "down": v.rank(method="min", ascending=False),
        "pr": (v.rank(method="min") - 1) / (v.notna().sum() - 1),
    }.items():
        pd.testing.assert_series_equal(got[column].astype(float), expected, check_names=False)


def test_documented_percentile_case(spark):
    rows = [(i, v) for i, v in enumerate([5.0, 1.0, 5.0, None, 2.0, 2.0, 2.0, 9.0])]
    df = settle(spark.createDataFrame(rows, "id int, v double"))
    placed, at = ranking.with_positions(df, "id", {"v": F.col("v")})
    got = [r["p"] for r in placed.select("id", at["v"].percentile().alias("p")).orderBy("id").collect()]
    assert [None if p is None else round(p, 4) for p in got] == [
        0.7857, 0.1429, 0.7857, None, 0.4286, 0.4286, 0.4286, 1.0,
    ]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_row_number_running_total_and_ntile(spark, parts):
    rng = random.Random(5)
    rows = [(f"c{i:04d}", rng.choice([1, 1, 1, 5, 9, 100])) for i in range(503)]
    df = settle(spark.createDataFrame(rows, "name string, n bigint").repartition(parts))
    line, at = ranking.global_row_number(df, -F.col("n"), "name")
    line = line.withColumns({"q": ranking.ntile(4, F.col("row_number"), F.col("rows_total")), "rank": at.rank()})
    got = line.orderBy("row_number").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["name"], r["n"]) for r in got] == expected
    running = 0
    for i, r in enumerate(got):
        running += r["n"]
        assert (r["row_number"], -r["running_sum"], r["rows_total"]) == (i + 1, running, 503)
        assert r["rank"] == 1 + sum(n > r["n"] for _, n in expected)
    assert [sum(r["q"] == k for r in got) for k in (1, 2, 3, 4)] == [126, 126, 126, 125]
    assert got[-1]["running_sum"] == got[0]["sum_total"]


def test_ranks_are_planned_in_one_piece(spark):
    """No sampling, no written ranges: the plan of a rank runs as a whole and orders by stretches only."""
    df = settle(spark.range(100).selectExpr("id", "cast(id % 7 as double) v"))
    placed, at = ranking.with_positions(df, "id", {"v": F.col("v")})
    text = placed.select(at["v"].rank())._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "ranges-" not in text


def test_stretches_follow_the_order(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 308) for _ in range(4000)]
    values += [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1.7e308, -1.7e308] + [1 + i * 1e-12 for i in range(50)]
    df = settle(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double"))
    got = df.select("v", ranking._stretch(F.col("v")).alias("s")).orderBy("v").collect()
    assert all(a.s <= b.s for a, b in zip(got, got[1:]))
    placed, at = ranking.with_positions(df, "id", {"v": F.col("v")})
    ranks = {r.id: r.r for r in placed.select("id", at["v"].rank().alias("r")).collect()}
    expected = pd.Series(values).rank(method="min", na_option="bottom")
    assert all(ranks[i] == expected[i] for i in range(len(values)))


def test_ntile_with_fewer_rows_than_tiles(spark):
    tile = ranking.ntile(4, F.col("id") + 1, F.lit(3))
    assert [r[0] for r in spark.range(3).select(tile).collect()] == [1, 2, 3]


def test_below_floor_companies_keep_null_scores(spark):
    columns = ["pct_no_relief", "untimely_rate", "disputes_facts_rate", "avg_days_to_company"]
    rows = [(f"c{i}", 1000 if i else 1, True, float(i), *[float(i)] * 4) for i in range(4)]
    df = spark.createDataFrame(
        rows, "company string, total_complaints bigint, matched boolean, complaints_per_1b_assets double, "
        + ", ".join(f"{c} double" for c in columns)
    )
    got = {r["company"]: r for r in scoring.risk_profile(df).collect()}
    assert got["c0"]["conduct_risk_score"] is None and got["c0"]["risk_tier"] is None
    assert got["c3"]["conduct_risk_score"] == 100.0 and got["c3"]["risk_tier"] == "Severe"
    assert got["c1"]["exposure_risk_score"] == 33.33
