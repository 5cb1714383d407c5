"""Named queries over the test tables: one per operator and per report."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.bindings import tables as t
from plaintide.functions import dates, names, outcomes
from plaintide.functions.numbers import rounded
from plaintide.operators import aggregates, ranking
from plaintide.plans import (
    analyses,
    checks,
    cleaning,
    enrichment,
    entities,
    scoring,
    statistics,
    views,
)
from plaintide.schemas import all_strings
from plaintide.session import settle, shared_folder
from plaintide.sources import bulk, history, pages
from plaintide.sources import tables as files
from plaintide.sources.tables import typed, write_csv
from plaintide.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPIKE = ("1998-03", "1998-04")
EXCLUDED_MONTH = "1998-04"
# Fixed value: complaints from which a product-issue pair is reported.
ISSUE_FLOOR = 50
OUTCOMES = [statistics.RELIEF, statistics.NO_RELIEF]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.institutions(spark, sf_dir).where("ACTIVE = 1")


def _cells(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    facts = t.facts(
        spark, sf_dir, "company", "in_trend_window", "days_to_company", "is_resolved",
        "got_monetary_relief", "is_untimely", *by,
    )
    return enrichment.outcome_cells(facts, *by)


def _enriched(spark: SparkSession, sf_dir: str, near_misses: bool = False, cells: DataFrame | None = None) -> DataFrame:
    totals = enrichment.totals_of(_cells(spark, sf_dir) if cells is None else cells)
    return enrichment.enrich_totals(totals, t.named_institutions(spark, sf_dir), near_misses=near_misses)


_BASE_COLUMNS = [
    "company", "product", "state", "state_type", "date_received", "days_to_company",
    "dq_long_routing_lag", "is_servicemember", "is_older_american", "has_narrative", "is_resolved",
    "got_monetary_relief", "got_any_relief", "closed_explanation_only", "is_untimely",
    "company_disputes_facts", "in_trend_window",
]


def _rates(
    spark: SparkSession, sf_dir: str, percentiles: bool = True, near_misses: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Company rates and the enriched table, both from the same cells."""
    facts = t.facts(spark, sf_dir, *_BASE_COLUMNS)
    cells = enrichment.company_cells(facts)
    totals, institutions = enrichment.totals_of(cells), t.named_institutions(spark, sf_dir)
    enriched = settle(enrichment.enrich_totals(totals, institutions, near_misses=near_misses), "enriched")
    return enrichment.company_rates(enrichment.company_base(facts, cells, percentiles), enriched), enriched


def _profile(spark: SparkSession, sf_dir: str, near_misses: bool = False) -> DataFrame:
    return scoring.risk_profile(_rates(spark, sf_dir, near_misses=near_misses)[0], floor=t.VOLUME_FLOOR)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.company_summary(_profile(spark, sf_dir), floor=t.VOLUME_FLOOR)


# --- sources and extract operators -----------------------------------------------------------


@query
def scan_strings(spark, sf_dir):
    """Documents written as CSV with quoted line breaks and read back as text."""
    path = shared_folder(spark, "scan")
    documents = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    write_csv(documents, path)
    return bulk.scan_strings(spark, path, all_strings(documents.columns))


@query
def bulk_scope_filter(spark, sf_dir):
    """Bulk export with its own headers, landed as files, narrowed to a date range and two products."""
    export = (
        t.table(spark, sf_dir, "lineitem")
        .join(t.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("Complaint ID"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date received"),
            F.col("p_type").alias("Product"),
            F.col("p_brand").alias("Issue"),
            F.col("l_linestatus").alias("Timely response?"),
            F.col("o_orderpriority").alias("Submitted via"),
            F.col("p_name").alias("Consumer complaint narrative"),
        )
    )
    path = shared_folder(spark, "bulk")
    write_csv(export, path)
    kept = bulk.bulk_extract(bulk.scan_bulk(spark, path), "1996-01-01", "1997-12-31", ["ECONOMY", "PROMO"])
    return kept.select(
        "complaint_id", "date_received", "product", "issue", "timely", "submitted_via", "state",
        "complaint_what_happened",
    )


@query
def json_pages(spark, sf_dir):
    """Events landed as nested search pages of 500 hits, read back and exploded."""
    path = shared_folder(spark, "pages")
    source = F.struct(
        F.col("event_id").cast("string").alias("complaint_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date_received"),
        F.col("event_type").alias("product"),
        F.col("props").alias("complaint_what_happened"),
    )
    hit = F.struct(source.alias("_source"), F.array(F.col("event_id").cast("string")).alias("sort"))
    (
        t.table(spark, sf_dir, "events")
        .groupBy(F.expr("event_id DIV 500").alias("page"))
        .agg(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))
        .drop("page")
        .write.json(path)
    )
    return pages.read_search_pages(spark, path).select(
        "complaint_id", "date_received", "product", "company", "complaint_what_happened"
    )


@query
def institution_scan(spark, sf_dir):
    """Institution feed pages, active charters only."""
    path = shared_folder(spark, "institutions")
    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in ("NAME", "CERT", "CITY", "STALP", "ACTIVE", "NAMEHCR")])
    (
        t.institutions(spark, sf_dir)
        .groupBy(F.expr("CAST(CERT AS BIGINT) DIV 50").alias("page"))
        .agg(F.collect_list(F.struct(fields.alias("data"))).alias("data"))
        .drop("page")
        .write.json(path)
    )
    rows = pages.read_institution_pages(spark, path)
    return rows.select(*[F.col(c).alias(c.lower()) for c in ("NAME", "CERT", "CITY", "STALP", "NAMEHCR")])


@query
def ingest_dedupe(spark, sf_dir):
    """The first line of every order that no earlier run (orders before 1998) has stored."""
    orders = t.table(spark, sf_dir, "orders")
    stored = orders.where("o_orderdate < '1998-01-01'").select(F.col("o_orderkey").alias("complaint_id"))
    new = t.table(spark, sf_dir, "lineitem").select(
        F.expr("CASE WHEN l_quantity > 1 THEN l_orderkey END").alias("complaint_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )
    return pages.first_seen(new, "complaint_id", ["l_linenumber"], stored)


@query
def ingest_incremental(spark, sf_dir):
    """Orders landed as pages in two overlapping drops, ingested by two runs of the stream."""
    landing, root = shared_folder(spark, "landing"), shared_folder(spark, "ingest")
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("complaint_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_received"),
        F.col("o_orderpriority").alias("submitted_via"),
    )
    orders = t.table(spark, sf_dir, "orders").withColumn("hit", F.struct(record.alias("_source")))
    drops = [F.col("o_orderkey") % 5 < 3, F.col("o_orderkey") % 5 > 1]
    for drop in drops:
        (
            orders.where(drop)
            .groupBy(F.expr("o_orderkey DIV 1000").alias("page"))
            .agg(F.struct(F.collect_list("hit").alias("hits")).alias("hits"))
            .drop("page")
            .write.mode("append")
            .json(landing)
        )
        stored = ingest.ingest_available(spark, landing, root, {"products": "all"})
    return stored.select("complaint_id", "date_received", "submitted_via")


@query
def narrative_split(spark, sf_dir):
    """Whole non-blank document texts in their side table."""
    documents = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("complaint_id"), F.col("text").alias("complaint_what_happened")
    )
    side = pages.narratives(documents)
    return side.select("complaint_id", F.md5("complaint_what_happened").alias("text_md5"),
                       F.length("complaint_what_happened").cast("long").alias("chars"))


@query
def limit_extract(spark, sf_dir):
    """The latest 500 orders."""
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    latest = pages.limited(orders, 500, F.desc("o_orderdate"), F.asc("o_orderkey"))
    return latest.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query
def column_population(spark, sf_dir):
    return pages.manifest(t.raw_complaints(spark, sf_dir))


@query
def typed_load(spark, sf_dir):
    """Text rows cast to a declared schema with required columns."""
    text = t.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS complaint_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS date_received",
        "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status",
        "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS amount",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END AS urgent",
    )
    schema = T.StructType(
        [
            T.StructField("complaint_id", T.LongType(), False),
            T.StructField("date_received", T.DateType(), False),
            T.StructField("status", T.StringType()),
            T.StructField("amount", T.DecimalType(14, 2)),
            T.StructField("urgent", T.BooleanType(), False),
        ]
    )
    return typed(text, schema)


# --- filters ------------------------------------------------------------------------------------


@query
def trend_window(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "complaint_id", "date_received", "in_trend_window")
    return facts.where("in_trend_window").select("complaint_id", "date_received")


@query
def volume_floor(spark, sf_dir):
    counts = enrichment.company_counts(t.facts(spark, sf_dir, "company"))
    return counts.where(F.col("n_complaints") >= t.VOLUME_FLOOR)


@query
def issue_floor(spark, sf_dir):
    facts = t.facts(
        spark, sf_dir, "product_short", "issue", "is_resolved", "got_monetary_relief", "is_untimely",
        "is_servicemember", "is_older_american", "in_trend_window",
    )
    return views.issue_export(facts, ISSUE_FLOOR)


@query
def topn_per_group(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product", "issue", "in_trend_window")
    return analyses.top_issue_per_product(facts, 10)


@query
def top_k_size_adjusted(spark, sf_dir):
    return views.top_size_adjusted(_summary(spark, sf_dir))


@query
def cross_filter(spark, sf_dir):
    """Matched companies of the upper tiers, as the dashboard filter narrows them."""
    kept = views.cross_filter(_summary(spark, sf_dir), tiers=["High", "Severe"], matched=True)
    return kept.select("company", "risk_tier", "total_complaints", "complaints_per_1b_assets")


# --- scalar functions ------------------------------------------------------------------------


@query
def date_parts(spark, sf_dir):
    raw = t.raw_complaints(spark, sf_dir).select("complaint_id", "date_received", "date_sent_to_company")
    typed_dates = cleaning.type_dates(raw)
    return typed_dates.select(
        "complaint_id",
        "date_received",
        "date_sent_to_company",
        "year",
        "month",
        "year_month",
        dates.month_start(F.col("year_month")).alias("month_start"),
        F.dayofmonth("date_received").alias("day"),
    )


@query
def routing_lag(spark, sf_dir):
    raw = t.raw_complaints(spark, sf_dir).select("complaint_id", "date_received", "date_sent_to_company")
    return cleaning.type_dates(raw).select("complaint_id", "days_to_company")


@query
def taxonomy_repair(spark, sf_dir):
    raw = t.raw_complaints(spark, sf_dir).select("complaint_id", "product", "sub_product")
    return cleaning.repair_taxonomy(raw)


@query
def normalise_key(spark, sf_dir):
    texts = t.raw_complaints(spark, sf_dir).select("company").distinct()
    return cleaning.key_companies(texts).select("company_raw", "company_key").distinct()


@query
def match_normalise(spark, sf_dir):
    companies = t.named_companies(spark, sf_dir)
    return companies.select("company", names.match_name(F.col("company")).alias("norm"))


@query
def sig_tokens(spark, sf_dir):
    normal = names.match_name(F.col("company"))
    tokens = names.significant_tokens(normal)
    return t.named_companies(spark, sf_dir).select("company", F.array_join(tokens, " ").alias("tokens"))


@query
def token_jaccard(spark, sf_dir):
    """Token sets of each document pair of neighbours (n, n + 1), whole texts."""
    documents = t.table(spark, sf_dir, "documents")
    words = F.array_sort(F.array_distinct(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= 3)))
    sets = documents.select("doc_id", words.alias("words"))
    left = sets.select("doc_id", F.col("words").alias("a"))
    right = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("b"))
    a, b = F.col("a"), F.col("b")
    return left.join(right, "doc_id").select(
        "doc_id",
        names.shared_count(a, b).cast("long").alias("shared"),
        rounded(names.jaccard(a, b), 6).alias("jaccard"),
        (a == b).alias("same_set"),
    )


@query
def declared_class(spark, sf_dir):
    verdict = entities.declared_class(F.col("company"), names.match_name(F.col("company")))
    return t.named_companies(spark, sf_dir).select("company", verdict.getField("method").alias("method"))


@query
def geo_classify(spark, sf_dir):
    geo = cleaning.classify_geography(t.raw_complaints(spark, sf_dir).select("complaint_id", "state", "zip_code"))
    return geo.select("complaint_id", "state", "state_type", "dq_state_missing")


@query
def zip_prefix(spark, sf_dir):
    geo = cleaning.classify_geography(t.raw_complaints(spark, sf_dir).select("complaint_id", "state", "zip_code"))
    return geo.select("complaint_id", "zip_code", "zip3", "dq_zip_masked")


@query
def sentinel_fill(spark, sf_dir):
    raw = t.raw_complaints(spark, sf_dir)
    return raw.select("complaint_id", *[outcomes.filled(c).alias(c) for c in outcomes.TRIMMED_COLUMNS])


@query
def outcome_flags(spark, sf_dir):
    flagged = cleaning.fill_and_flag(_typed_raw(spark, sf_dir), t.TREND_END)
    return flagged.select(
        "complaint_id", "is_servicemember", "is_older_american", "is_resolved", "got_monetary_relief",
        "got_any_relief", "closed_explanation_only", "is_untimely", "company_disputes_facts",
    )


def _typed_raw(spark, sf_dir):
    return cleaning.repair_taxonomy(cleaning.type_dates(t.raw_complaints(spark, sf_dir)))


@query
def dq_flags(spark, sf_dir):
    flagged = cleaning.fill_and_flag(
        cleaning.classify_geography(_typed_raw(spark, sf_dir)), t.TREND_END
    )
    return flagged.select("complaint_id", *[c for c in flagged.columns if c.startswith("dq_")], "in_trend_window")


# --- aggregates ---------------------------------------------------------------------------------


@query
def filtered_counts(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product", "issue", "is_resolved", "got_monetary_relief", "is_untimely")
    return facts.groupBy("product", "issue").agg(
        F.count("*").alias("n"),
        *aggregates.counted("is_resolved", "got_monetary_relief", "is_untimely"),
    )


@query
def filtered_distinct(spark, sf_dir):
    facts = t.facts(
        spark, sf_dir, "company", "product", "state", "state_type", "date_received", "is_resolved",
        "got_monetary_relief", "is_untimely", "in_trend_window",
    )
    return analyses.company_volume(facts).select("company", "products_touched", "states_touched")


@query
def filtered_distinct_sketched(spark, sf_dir):
    """The same from sketches, and upward; counts of so few values are exact."""
    facts = t.facts(spark, sf_dir, "company", "product", "state", "state_type", "in_trend_window")
    return analyses.approximate_breadth(analyses.breadth_cells(facts))


@query
def company_reach(spark, sf_dir):
    """Approximate number of companies by product, state and nation."""
    return analyses.company_reach(t.facts(spark, sf_dir, "company", "product", "state", "in_trend_window"))


@query
def company_features_sketched(spark, sf_dir):
    """Company features with approximate lag percentiles, in one scan of the facts."""
    return enrichment.company_features(t.facts(spark, sf_dir, *_BASE_COLUMNS), approximate=True)


@query
def filtered_avg(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "company", "days_to_company", "dq_long_routing_lag")
    return facts.groupBy("company").agg(*aggregates.lag_parts()).select(
        "company", aggregates.lag_mean(3).alias("avg_days_to_company")
    )


@query
def group_percentiles(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "company", "days_to_company")
    return aggregates.group_percentiles(facts, ["company"], "days_to_company", {"p50": 0.5, "p90": 0.9})


@query
def crosstab_outcome(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product_short", "is_resolved", "got_monetary_relief")
    table = statistics.crosstab(statistics.with_outcome(facts), "product_short", "outcome", OUTCOMES)
    return table.toDF("product_short", "monetary_relief", "no_monetary_relief")


@query
def yearly_growth(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product", "year", "in_trend_window")
    return statistics.yearly_growth(facts, "product", 1996, 2000)


@query
def edge_growth(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product_short", "year_month", "in_trend_window").where("in_trend_window")
    monthly = facts.groupBy("product_short", "year_month").agg(F.count("*").alias("complaints"))
    return statistics.edge_growth(monthly, "product_short", "year_month", "complaints")


@query
def national_baseline(spark, sf_dir):
    facts = t.facts(
        spark, sf_dir, "product", "is_resolved", "got_monetary_relief", "got_any_relief", "is_untimely",
        "closed_explanation_only", "in_trend_window",
    )
    return statistics.national_baseline(facts, "product")


@query
def clean_metrics(spark, sf_dir):
    return cleaning.clean_metrics(t.raw_complaints(spark, sf_dir), t.TREND_END)


@query
def null_profile(spark, sf_dir):
    """Nulls per clean column before the dedupe."""
    return checks.null_profile(cleaning.prepare(t.raw_complaints(spark, sf_dir), t.TREND_END))


@query
def before_after(spark, sf_dir):
    raw = t.raw_complaints(spark, sf_dir)
    return checks.before_after(raw, cleaning.clean(raw, t.TREND_END)).select(
        "stage", "column_count", "row_count", "total_nulls", "distinct_companies", "distinct_products"
    )


@query
def canonical_name(spark, sf_dir):
    return cleaning.canonical_names(t.raw_complaints(spark, sf_dir).select("company"))


@query
def name_map(spark, sf_dir):
    return cleaning.name_map(t.raw_complaints(spark, sf_dir).select("company"))


# --- dedupe -------------------------------------------------------------------------------------


@query
def business_dedupe(spark, sf_dir):
    """Lines by (order, line number): the most complete, then by the stated order."""
    lines = t.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "nullif(l_tax, 0) AS l_tax", "nullif(l_discount, 0) AS l_discount",
    )
    kept = cleaning.drop_double_submissions(
        lines,
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
    return kept.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query
def date_only_repeats(spark, sf_dir):
    events = t.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return cleaning.repeats(events, ["user_id", "event_type", "day"])


@query
def clean_facts(spark, sf_dir):
    """The whole cleaning stage on the raw extract."""
    clean = cleaning.clean(t.raw_complaints(spark, sf_dir), t.TREND_END)
    return clean.withColumn("date_received_ts", F.date_format("date_received_ts", "yyyy-MM-dd HH:mm:ss"))


# --- windows and ranks ----------------------------------------------------------------------


_VOLUME_COLUMNS = [
    "company", "product", "state", "state_type", "date_received", "is_resolved",
    "got_monetary_relief", "is_untimely", "in_trend_window",
]


@query
def volume_quartile(spark, sf_dir):
    return analyses.volume_quartiles(t.facts(spark, sf_dir, *_VOLUME_COLUMNS))


@query
def centred_average(spark, sf_dir):
    return statistics.centred_average(_monthly(spark, sf_dir), "year_month", "complaints").select(
        "year_month", "complaints", "centred_avg"
    )


@query
def pct_rank(spark, sf_dir):
    """Average-tie percentile of every company's number of complaints."""
    counts = settle(enrichment.company_counts(t.facts(spark, sf_dir, "company")))
    placed, at = ranking.with_positions(counts, "company", {"n": F.col("n_complaints")})
    return placed.select(
        "company",
        "n_complaints",
        scoring.percentile_score(at["n"]).alias("pctile"),
        scoring.percentile_score(at["n"], higher_is_worse=False).alias("pctile_reversed"),
    )


@query
def spearman_matrix(spark, sf_dir):
    enriched = _enriched(spark, sf_dir).where(F.col("matched") & (F.col("total_complaints") >= t.VOLUME_FLOOR))
    return statistics.spearman_matrix(enriched)


@query
def rank_contrast(spark, sf_dir):
    enriched = _enriched(spark, sf_dir).where(F.col("matched") & (F.col("total_complaints") >= t.VOLUME_FLOOR))
    return statistics.rank_contrast(enriched)


@query
def top_k_global(spark, sf_dir):
    counts = enrichment.company_counts(t.facts(spark, sf_dir, "company"))
    return counts.orderBy(F.desc("n_complaints"), "company").limit(15)


@query
def peak_period(spark, sf_dir):
    return statistics.window_change(_monthly(spark, sf_dir), "year_month", "complaints").select(
        "peak_period", "peak_value"
    )


@query
def window_change(spark, sf_dir):
    return statistics.window_change(_monthly(spark, sf_dir), "year_month", "complaints").select(
        "first_value", "last_value", "pct_change"
    )


# --- statistics -----------------------------------------------------------------------------


def _product_table(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product_short", "is_resolved", "got_monetary_relief", "in_trend_window")
    return statistics.crosstab(statistics.with_outcome(facts, True), "product_short", "outcome", OUTCOMES)


def _company_table(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "company", "is_resolved", "got_monetary_relief", "in_trend_window")
    table = statistics.crosstab(statistics.with_outcome(facts, True), "company", "outcome", OUTCOMES)
    return statistics.large_rows(table, OUTCOMES, t.RESOLVED_FLOOR)


@query
def chi_square_product(spark, sf_dir):
    return statistics.chi_square(_product_table(spark, sf_dir), OUTCOMES)


@query
def chi_square_company(spark, sf_dir):
    return statistics.chi_square(_company_table(spark, sf_dir), OUTCOMES)


@query
def chi_square_p_value(spark, sf_dir):
    tested = statistics.with_p_value(statistics.chi_square(_company_table(spark, sf_dir), OUTCOMES))
    return tested.withColumn("p_value", rounded(F.col("p_value"), 9))


@query
def large_groups(spark, sf_dir):
    """Facts of companies over the resolved floor, by semi-join."""
    facts = t.facts(spark, sf_dir, "complaint_id", "company", "is_resolved").where("is_resolved")
    return statistics.large_groups(facts, "company", t.RESOLVED_FLOOR).select("complaint_id", "company")


@query
def chi_residuals(spark, sf_dir):
    cells = statistics.residuals(_company_table(spark, sf_dir), "company", OUTCOMES)
    cells = cells.withColumn("residual", rounded(F.col("residual"), 6))
    return statistics.extreme_residuals(cells, "company").withColumn("expected", rounded(F.col("expected"), 6))


@query
def rate_spread(spark, sf_dir):
    return statistics.rate_spread(_company_table(spark, sf_dir), "company")


@query
def spike_attribution(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "company", "year_month", "in_trend_window").where("in_trend_window")
    return statistics.spike_attribution(facts, "company", F.col("year_month"), *SPIKE)


@query
def spike_daily(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    return statistics.daily_peak(events, F.col("ts").cast("date"))


@query
def spike_categories(spark, sf_dir):
    facts = t.facts(spark, sf_dir, "product_short", "issue", "year_month", "in_trend_window")
    month = facts.where("in_trend_window").where(F.col("year_month") == EXCLUDED_MONTH)
    return statistics.dominant_categories(month, ["product_short", "issue"])


def _sensitivity(spark, sf_dir):
    cells = _cells(spark, sf_dir, "year_month")
    return statistics.sensitivity(cells, _enriched(spark, sf_dir, cells=cells), EXCLUDED_MONTH, t.VOLUME_FLOOR)


@query
def sensitivity(spark, sf_dir):
    return _sensitivity(spark, sf_dir)


@query
def sensitivity_summary(spark, sf_dir):
    return statistics.sensitivity_summary(_sensitivity(spark, sf_dir), 1.5)


@query
def score_redundancy(spark, sf_dir):
    scored = _rates(spark, sf_dir)[0].where(F.col("total_complaints") >= t.VOLUME_FLOOR)
    return statistics.score_redundancy(scored, "pct_no_relief", "explanation_only_rate")


# --- entity resolution ----------------------------------------------------------------------


@query
def holding_rollup(spark, sf_dir):
    return entities.holding_groups(_institutions(spark, sf_dir))


@query
def match_candidates(spark, sf_dir):
    institutions = t.named_institutions(spark, sf_dir)
    return entities.match_candidates(institutions, entities.holding_groups(institutions))


def _matches(spark, sf_dir):
    return entities.resolve(t.named_companies(spark, sf_dir), t.named_institutions(spark, sf_dir))


@query
def entity_match(spark, sf_dir):
    return _matches(spark, sf_dir).drop("match_note")


@query
def match_breakdown(spark, sf_dir):
    return entities.match_breakdown(settle(_matches(spark, sf_dir)))


@query
def match_rate(spark, sf_dir):
    return entities.match_rate(_matches(spark, sf_dir))


@query
def unmatched_top(spark, sf_dir):
    return entities.unmatched_by_volume(_matches(spark, sf_dir)).limit(20).drop("match_note", "match_score")


@query
def review_band(spark, sf_dir):
    return entities.unmatched_by_volume(_matches(spark, sf_dir), ["below_threshold"]).drop("match_note")


@query
def near_misses(spark, sf_dir):
    """Every institution name a company without an exact match resembles, whatever their words."""
    return entities.near_misses(t.named_companies(spark, sf_dir), t.named_institutions(spark, sf_dir))


@query
def company_enriched(spark, sf_dir):
    return _enriched(spark, sf_dir, near_misses=True)


@query
def plausibility_sweep(spark, sf_dir):
    return entities.implausible(_enriched(spark, sf_dir))


# --- features and scores ----------------------------------------------------------------------


@query
def company_features(spark, sf_dir):
    return enrichment.company_features(t.facts(spark, sf_dir, *_BASE_COLUMNS))


@query
def company_outcomes(spark, sf_dir):
    facts = t.facts(
        spark, sf_dir, "company", "is_resolved", "got_monetary_relief", "got_any_relief",
        "closed_explanation_only", "is_untimely", "company_disputes_facts", "in_trend_window",
    )
    return enrichment.company_outcomes(facts)


@query
def company_rates(spark, sf_dir):
    return _rates(spark, sf_dir)[0].select(
        "company", "matched", "monetary_relief_rate", "any_relief_rate", "pct_no_relief",
        "explanation_only_rate", "untimely_rate", "disputes_facts_rate", "pct_servicemember",
        "pct_older_american", "complaints_per_1b_assets",
    )


@query
def conduct_score(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        "company", "total_complaints", *[f"pctile_{m}" for m in scoring.CONDUCT_WEIGHTS], "conduct_risk_score"
    )


@query
def exposure_score(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        "company", "conduct_risk_score", "pctile_complaints_per_1b_assets", "exposure_risk_score"
    )


@query
def risk_tier(spark, sf_dir):
    return _profile(spark, sf_dir).select("company", "conduct_risk_score", "risk_tier")


@query
def risk_profile(spark, sf_dir):
    """The forty-column company profile."""
    return _profile(spark, sf_dir, near_misses=True)


@query
def tier_distribution(spark, sf_dir):
    return scoring.tier_distribution(settle(_profile(spark, sf_dir)))


@query
def component_spread(spark, sf_dir):
    return scoring.component_spread(_rates(spark, sf_dir)[0], t.VOLUME_FLOOR)


# --- reports and views ------------------------------------------------------------------------


@query
def q01_company_ranking(spark, sf_dir):
    return analyses.company_ranking(t.facts(spark, sf_dir, *_VOLUME_COLUMNS))


_MONTHLY_COLUMNS = [
    "product", "product_short", "year_month", "date_received", "is_resolved", "got_monetary_relief",
    "is_untimely", "in_trend_window",
]


@query
def q02_monthly_trend(spark, sf_dir):
    return analyses.monthly_trend(t.facts(spark, sf_dir, *_MONTHLY_COLUMNS))


@query
def q02_dense_trend(spark, sf_dir):
    """The trend of every product, state and brand, many with gaps, over a gap-free calendar."""
    facts = t.facts(spark, sf_dir, *_MONTHLY_COLUMNS, "issue", "state")
    fine = facts.withColumn("product", F.concat_ws(" / ", "product", "state", "issue"))
    return analyses.monthly_trend(fine.withColumn("product_short", F.col("product")), dense=True)


@query
def q03_resolution(spark, sf_dir):
    facts = t.facts(
        spark, sf_dir, "company", "is_resolved", "got_monetary_relief", "got_any_relief",
        "closed_explanation_only", "is_untimely", "company_disputes_facts", "days_to_company",
        "dq_long_routing_lag", "in_trend_window",
    )
    return analyses.resolution_rates(facts, floor=t.RESOLVED_FLOOR)


@query
def q04_size_adjusted(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return analyses.size_adjusted(cells, _enriched(spark, sf_dir, cells=cells), floor=t.VOLUME_FLOOR)


@query
def q05_top_issues(spark, sf_dir):
    facts = t.facts(
        spark, sf_dir, "product", "product_short", "issue", "is_resolved", "got_monetary_relief",
        "is_untimely", "is_servicemember", "is_older_american", "in_trend_window",
    )
    return analyses.top_issues(facts, floor=ISSUE_FLOOR)


_STATE_COLUMNS = [
    "state", "state_type", "company", "issue", "product_short", "is_resolved", "got_monetary_relief",
    "is_untimely", "days_to_company", "dq_long_routing_lag", "in_trend_window",
]


@query
def q06_state_profile(spark, sf_dir):
    return analyses.state_profile(t.facts(spark, sf_dir, *_STATE_COLUMNS))


@query
def v_company_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def v_complaints_enriched(spark, sf_dir):
    rates, enriched = _rates(spark, sf_dir, percentiles=False)
    profile = settle(scoring.risk_profile(rates, t.VOLUME_FLOOR), "profile")
    return views.complaints_enriched(t.facts(spark, sf_dir), enriched, profile)


@query
def v_monthly_trend(spark, sf_dir):
    return views.monthly_view(t.facts(spark, sf_dir, *_MONTHLY_COLUMNS))


@query
def v_state_summary(spark, sf_dir):
    return views.state_view(t.facts(spark, sf_dir, *_STATE_COLUMNS))


def _monthly(spark, sf_dir):
    return analyses.monthly_overall(
        t.facts(spark, sf_dir, "year_month", "is_resolved", "got_monetary_relief", "is_untimely", "in_trend_window")
    )


@query
def monthly_overall(spark, sf_dir):
    return _monthly(spark, sf_dir)


@query
def resolution_quadrant(spark, sf_dir):
    return views.resolution_quadrant(_summary(spark, sf_dir))


@query
def integrity_checks(spark, sf_dir):
    """Facts against the register of active companies, which lacks some: that check fails."""
    facts = t.facts(spark, sf_dir, "complaint_id", "company", "date_received", "zip3", "got_monetary_relief")
    active = t.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    companies = t.company_names(spark, sf_dir).join(active, "s_suppkey").select(F.col("company_name").alias("company"))
    expected = t.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n")).scalar()
    return checks.integrity_checks(facts, companies, expected, "1995-01-01", t.TREND_END)


@query
def cross_filter_facts(spark, sf_dir):
    """Facts narrowed by product, state and months at once."""
    facts = t.facts(spark, sf_dir, "complaint_id", "product_short", "state", "year_month", "company")
    states = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]
    return views.cross_filter(facts, products=["ECONOMY", "PROMO"], states=states, months=("1996-02", "1997-05"))


@query
def cross_filter_company(spark, sf_dir):
    """Facts of one company."""
    facts = t.facts(spark, sf_dir, "complaint_id", "year_month", "company")
    return views.cross_filter(facts, company="CITIBANK, N.A.")


# --- sinks and runner ------------------------------------------------------------------------


@query
def sample_extract(spark, sf_dir):
    """The first thousand orders by key, written as a file and read back."""
    path = shared_folder(spark, "sample")
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("complaint_id"), "o_orderpriority", "o_orderstatus")
    files.sample_extract(orders, path)
    return bulk.scan_strings(spark, path, all_strings(orders.columns))


@query
def ingest_history(spark, sf_dir):
    """Events in three overlapping runs against a bucketed history of ids: every id once."""
    name = f"history_{uuid.uuid4().hex}"
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(0).alias("place"))
    events = events.select(F.when(F.col("event_id") % 97 != 5, F.col("event_id")).alias("event_id"), "event_type", "place")
    shares = [F.col("event_id") % 3 != 0, F.col("event_id") % 3 != 1, F.lit(True)]
    runs = [history.ingest(events.where(share | F.col("event_id").isNull()), "event_id", ["place"], name, 8) for share in shares]
    rows = [run.select(F.lit(n + 1).alias("run"), "event_id", "event_type") for n, run in enumerate(runs)]
    return functools.reduce(DataFrame.unionByName, rows)


@query
def clean_log(spark, sf_dir):
    """Counters of the cleaning stage, observed while the clean rows are written."""
    return cleaning.land_clean(t.raw_complaints(spark, sf_dir), shared_folder(spark, "clean"), t.TREND_END)[1]


@query
def replace_table(spark, sf_dir):
    """A table that is written twice holds what was written last."""
    name = f"replaced_{uuid.uuid4().hex}"
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    files.replace_table(orders, name)
    files.replace_table(orders.where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n")), name)
    return spark.table(name)


@query
def named_views(spark, sf_dir):
    """Reports registered as views and combined in SQL."""
    files.register_views({"trend": _monthly(spark, sf_dir), "states": views.state_view(t.facts(spark, sf_dir, *_STATE_COLUMNS))})
    return spark.sql("SELECT (SELECT count(*) FROM trend) AS months, (SELECT count(*) FROM states) AS states")


@query
def query_runner(spark, sf_dir):
    """Named queries exported two at a time; a failing one is reported and stops nothing."""
    target = shared_folder(spark, "runner")

    def failing(_spark, _source):
        raise ValueError("no such report")

    chosen = {name: QUERIES[name] for name in ("national_baseline", "monthly_overall")} | {"failing": failing}
    failures = files.run_named(spark, chosen, sf_dir, target, side_by_side=2)
    rows = [
        spark.read.option("header", True).csv(f"{target}/{name}").agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), "row_count", F.lit(None).cast("string").alias("failure")
        )
        for name in chosen
        if name not in failures
    ]
    failed = spark.createDataFrame([(n, 0, f) for n, f in failures.items()], "name string, row_count bigint, failure string")
    return functools.reduce(DataFrame.unionByName, rows, failed)
