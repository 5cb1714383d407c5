"""Shape of the physical plans that scale depends on."""

from pyspark.sql import functions as F

from plaintide.bindings import tables as t
from plaintide.bindings.queries import QUERIES
from plaintide.plans import analyses, cleaning


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_pruned_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["topn_per_group"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_dedupe_is_pruned_before_the_shuffle(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem").withColumn("complaint_id", F.col("l_partkey"))
    text = plan(cleaning.drop_double_submissions(lines, ["l_orderkey", "l_linenumber"]))
    assert text.count("WindowGroupLimit") == 2


def test_window_filter_and_columns_reach_the_scan(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product", "issue", "in_trend_window")
    text = plan(analyses.top_issue_per_product(facts, 10))
    assert "LessThan(o_orderdate,2001-08-01T00:00)" in text
    assert "l_extendedprice" not in text and "s_name" not in text and "c_mktsegment" not in text


def test_reports_hold_no_python_and_no_all_pairs_join(spark, sf_dir):
    for name in ("q02_monthly_trend", "q05_top_issues", "q06_state_profile", "clean_facts", "company_features",
                 "business_dedupe", "clean_metrics", "chi_square_company"):
        text = plan(QUERIES[name](spark, sf_dir))
        for word in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
            assert word not in text, (name, word)


def test_state_report_reads_facts_once(spark, sf_dir):
    assert plan(QUERIES["q06_state_profile"](spark, sf_dir)).count("lineitem.parquet") == 1


def test_company_reports_read_the_facts_once_or_twice(spark, sf_dir):
    """Totals, features and outcomes are settled cells; what is read again is stated in the query."""
    text = plan(QUERIES["v_complaints_enriched"](spark, sf_dir))
    assert text.count("lineitem.parquet") == 1
    for line in text.splitlines():
        assert "Exchange hashpartitioning(company" not in line


def test_library_holds_no_hints_and_no_collects():
    """No forced broadcast, no local checkpoint, nothing pulled to the driver."""
    import pathlib

    import plaintide

    for path in pathlib.Path(plaintide.__file__).parent.rglob("*.py"):
        if "llm" in path.parts:  # what its operators bring to the driver is bounded and stated there
            continue
        text = path.read_text()
        for word in ("broadcast(", "localCheckpoint", ".collect()", "toPandas", "crossJoin", "toLocalIterator"):
            assert word not in text, (path, word)
