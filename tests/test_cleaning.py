"""Invariants of the cleaning stage and of the reports."""

import time

import pytest
from pyspark.sql import functions as F

from plaintide.bindings import tables as t
from plaintide.plans import analyses, cleaning, statistics, views


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return t.raw_complaints(spark, sf_dir).cache()


def test_dedupe_is_idempotent_and_order_free(spark, raw):
    prepared = cleaning.prepare(raw, t.TREND_END)
    doubled = prepared.unionByName(prepared.withColumn("complaint_id", F.concat("complaint_id", F.lit("z"))))
    once = cleaning.drop_double_submissions(doubled)
    kept = sorted(r[0] for r in once.select("complaint_id").collect())
    shuffled = cleaning.drop_double_submissions(doubled.repartition(5, F.rand(1)))
    assert sorted(r[0] for r in shuffled.select("complaint_id").collect()) == kept
    assert cleaning.drop_double_submissions(once).count() == once.count() == len(kept)
    assert not any(i.endswith("z") for i in kept)


def test_most_complete_row_survives(spark):
    rows = [("b", None, "k"), ("a", None, "k"), ("c", "x", "k"), ("d", None, None), ("e", None, None)]
    df = spark.createDataFrame(rows, "complaint_id string, extra string, key string")
    kept = cleaning.drop_double_submissions(df, ["key"])
    assert sorted(r["complaint_id"] for r in kept.collect()) == ["c", "d"]


def test_canonical_name_is_frequent_then_first(spark):
    rows = [("Ab Corp",)] * 2 + [("AB Inc",)] * 2 + [("ab",)] + [("Z",), (None,)]
    df = spark.createDataFrame(rows, "company string")
    got = {r["company_key"]: r for r in cleaning.canonical_names(df).collect()}
    assert got["AB"]["company_clean"] == "AB Inc" and got["AB"]["spellings"] == 3
    out = cleaning.canonicalise_companies(df)
    assert out.where("company IS NULL").count() == 1 and out.count() == 7


def test_name_rules_run_on_distinct_texts(spark, raw):
    plan = cleaning.canonicalise_companies(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "regexp_replace" not in plan  # they ran below the settled spellings


def test_projection_guard(spark):
    with pytest.raises(ValueError, match="columns not built"):
        cleaning.project(spark.range(1))


def test_shares_add_up(spark, sf_dir):
    from plaintide.bindings.queries import QUERIES

    rows = QUERIES["q01_company_ranking"](spark, sf_dir).collect()
    assert sum(r["complaints"] for r in rows) == QUERIES["trend_window"](spark, sf_dir).count()
    assert rows[-1]["cumulative_pct"] == 100.0
    states = QUERIES["v_state_summary"](spark, sf_dir).agg(F.sum("pct_of_national")).first()[0]
    assert abs(states - 100.0) < 0.1


def test_dense_months_have_no_gaps(spark):
    rows = [("p", "p", "2024-01", 5, 1), ("p", "p", "2024-04", 7, 2)]
    df = spark.createDataFrame(rows, "product string, product_short string, year_month string, complaints bigint, untimely bigint")
    df = df.withColumn("month_start", F.to_date(F.concat("year_month", F.lit("-03"))))
    got = analyses.dense_months(df).orderBy("year_month").collect()
    assert [(r["year_month"], r["complaints"]) for r in got] == [("2024-01", 5), ("2024-02", 0), ("2024-03", 0), ("2024-04", 7)]


def test_volume_rank_gap_uses_the_matched_cohort(spark):
    """A large unmatched company does not widen the gap of matched ones."""
    plain = {c: F.lit(None).cast("double") for c in views._SUMMARY[1:]}
    rows = [("big non-bank", 9000, False, None), ("a", 5000, True, 1.0), ("b", 600, True, 9.0)]
    df = spark.createDataFrame(rows, "company string, total_complaints bigint, matched boolean, complaints_per_1b_assets double")
    for c, v in plain.items():
        if c not in df.columns:
            df = df.withColumn(c, v)
    for c in ("fdic_name", "match_method", "risk_tier"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    for c in ("total_assets_b", "n_charters", "conduct_risk_score", "exposure_risk_score"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    got = {r["company"]: r for r in views.company_summary(df).collect()}
    assert (got["b"]["volume_rank"], got["b"]["size_adjusted_rank"], got["b"]["rank_gap"]) == (2, 1, 1)
    assert got["big non-bank"]["volume_rank"] is None and got["big non-bank"]["overall_volume_rank"] == 1


def test_chi_square_identity(spark):
    rows = [("a", 10, 20), ("b", 30, 5), ("c", 0, 7)]
    table = spark.createDataFrame(rows, "g string, x bigint, y bigint")
    n = sum(r[1] + r[2] for r in rows)
    cols = (sum(r[1] for r in rows), sum(r[2] for r in rows))
    expected = sum(
        (o - (r[1] + r[2]) * c / n) ** 2 / ((r[1] + r[2]) * c / n) for r in rows for o, c in zip(r[1:], cols)
    )
    row = statistics.chi_square(table, ["x", "y"]).first()
    assert row["statistic"] == pytest.approx(expected, abs=1e-6) and row["dof"] == 2 and row["n"] == n
    cells = statistics.residuals(table, "g", ["x", "y"]).collect()
    assert sum(c["residual"] ** 2 for c in cells) == pytest.approx(expected)


def test_log_is_counted_while_the_rows_are_written(spark, sf_dir, tmp_path):
    """The same counters and rows as in two passes; what follows the write does not read the extract."""
    extract = t.raw_complaints(spark, sf_dir)
    facts, log = cleaning.land_clean(extract, str(tmp_path / "clean"), t.TREND_END)
    assert {tuple(r) for r in log.collect()} == {tuple(r) for r in cleaning.clean_metrics(extract, t.TREND_END).collect()}
    assert "lineitem" not in facts._jdf.queryExecution().executedPlan().toString()
    plain = cleaning.clean(extract, t.TREND_END)
    assert facts.columns == plain.columns
    assert facts.exceptAll(plain).count() == 0 and facts.count() == plain.count()


def test_steps_are_generated_apart_and_nothing_moves(spark):
    """Fused, the steps are methods that the JVM never compiles; ending the fused code changes no partition."""
    raw = t.raw_complaints(spark, "/root/testdata/sf0.001").repartition(3)
    prepared = cleaning.prepare(raw)
    plan = prepared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"Repartition {cleaning._ANY_PARTITIONS}, false") >= 6
    assert prepared.count() == raw.count()
    rows = cleaning._apart(raw)
    assert rows.rdd.getNumPartitions() == raw.rdd.getNumPartitions()


UNCACHED = "/root/testdata/sf0.01"  # the fixture above keeps the smaller extract in memory


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}


def _shuffles_left(spark, before):
    for _ in range(100):  # they are removed in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def test_cleaning_leaves_no_shuffle_files(spark):
    """Names, prepared rows and repeated keys are files by then; what was moved for them is gone."""
    before = _shuffle_files(spark)
    facts = cleaning.clean(t.raw_complaints(spark, UNCACHED), t.TREND_END)
    assert not _shuffles_left(spark, before)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "complaint_id" in plan


def test_cleaning_log_leaves_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    facts, log = cleaning.land_clean(t.raw_complaints(spark, UNCACHED), str(tmp_path / "clean"), t.TREND_END)
    assert not _shuffles_left(spark, before)
    assert "lineitem" not in log._jdf.queryExecution().executedPlan().toString()


def test_a_part_of_the_rows_is_chosen_in_the_scan(spark, tmp_path):
    """Each part filters the table with the ids before it moves any row; the parts make up the whole, rows without id too."""
    raw = t.raw_complaints(spark, UNCACHED)
    prepared = cleaning.prepare(raw, t.TREND_END)
    text = prepared.where(F.pmod(F.xxhash64("complaint_id"), F.lit(3)) == 1)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    chosen = next(i for i, line in enumerate(text) if "Filter" in line and "xxhash64" in line)
    assert "Relation" in text[chosen + 1] and "l_orderkey" in text[chosen + 1]
    some = prepared.limit(50).unionByName(prepared.limit(3).withColumn("complaint_id", F.lit(None).cast("string"))).localCheckpoint()
    assert cleaning._landed(some, str(tmp_path / "some")).exceptAll(some).count() == 0
    assert spark.read.parquet(str(tmp_path / "some")).count() == 53


def test_lines_are_moved_for_no_customer(spark):
    """Customers join orders before these join the lines."""
    lines = t.raw_complaints(spark, UNCACHED)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line and "c_custkey" in line and "o_custkey" in line)
    below = [line for i, line in enumerate(lines) if i > join and all(d > depth[join] for d in depth[join + 1 : i + 1])]
    assert any("c_custkey" in line for line in below) and not any("l_orderkey" in line for line in below)
