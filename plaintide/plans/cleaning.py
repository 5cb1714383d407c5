"""All-string extract to clean facts: typing, repair, canonical names, flags, dedupe.

Each step is ``DataFrame -> DataFrame`` with native expressions; the order is
part of the meaning, since fills happen before completeness is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions import dates, geography, names, outcomes, taxonomy
from plaintide.functions.numbers import flag, rounded
from plaintide.schemas import CLEAN_COLUMNS, RAW_COLUMNS
from plaintide.session import settle, shared_folder, shuffles_dropped

TREND_END = "2025-12-31"
BUSINESS_KEY = [
    "date_received_ts", "company_key", "product", "sub_product", "issue", "sub_issue", "state",
    "zip_code", "submitted_via",
]
DATE_ONLY_KEY = ["date_received", *BUSINESS_KEY[1:]]


# The prepared rows are written in so many parts: what is moved for one is gone before the next.
LANDING_PARTS = 3
# More partitions than any table has.
_ANY_PARTITIONS = 1 << 20


def _apart(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, with the code of the steps before and after generated apart.

    Fused, the steps make methods above 8,000 bytes, which the JVM never compiles. Lowering the number of
    partitions to more than there are moves nothing and ends the fused code.
    """
    return df.coalesce(_ANY_PARTITIONS)


def type_dates(df: DataFrame) -> DataFrame:
    received = dates.utc_timestamp(F.col("date_received"))
    sent = dates.utc_timestamp(F.col("date_sent_to_company"))
    typed = df.withColumns({"date_received_ts": received, "date_sent_ts": sent})
    ts = F.col("date_received_ts")
    return typed.withColumns(
        {
            "date_received": ts.cast("date"),
            "date_sent_to_company": F.col("date_sent_ts").cast("date"),
            "year": F.year(ts),
            "month": F.month(ts),
            "year_month": dates.year_month(ts),
            "days_to_company": dates.days_between(ts, F.col("date_sent_ts")),
        }
    )


def repair_taxonomy(df: DataFrame) -> DataFrame:
    product = taxonomy.modern_product(F.col("product"), F.col("sub_product"))
    return (
        df.withColumn("product_raw", F.col("product"))
        .withColumn("dq_legacy_product_label", taxonomy.has_legacy_label(F.col("product")))
        .withColumn("product", product)
        .withColumn("product_short", taxonomy.short_product(F.col("product")))
    )


def key_companies(df: DataFrame) -> DataFrame:
    raw = names.collapsed(F.col("company"))
    return df.withColumn("company_raw", raw).withColumn("company_key", names.company_key(raw))


def _spellings(df: DataFrame) -> DataFrame:
    """Distinct company texts with counts and keys; facts are counted in the map tasks.

    Name rules run on distinct texts only, so their cost does not grow with the facts.
    """
    texts = df.where(F.col("company").isNotNull()).groupBy("company")
    return key_companies(texts.agg(F.count("*").alias("n")))


def _canonical(spellings: DataFrame) -> DataFrame:
    """Adds the canonical name of the key: its most frequent spelling, ties by name.

    Both windows are as wide as one company has spellings.
    """
    same_spelling = Window.partitionBy("company_key", "company_raw")
    best_first = Window.partitionBy("company_key").orderBy(F.desc("_of_spelling"), "company_raw")
    return spellings.withColumn("_of_spelling", F.sum("n").over(same_spelling)).withColumn(
        "company_clean", F.first("company_raw").over(best_first)
    )


def name_map(df: DataFrame) -> DataFrame:
    """Every raw spelling with its canonical name and whether the key collapses several."""
    spelled = _canonical(_spellings(df)).groupBy("company_raw", "company_clean", "company_key")
    counted = spelled.agg(F.sum("n").alias("n_complaints"))
    others = F.count("*").over(Window.partitionBy("company_key"))
    return counted.withColumn("required_collapse", others > 1)


def canonical_names(df: DataFrame) -> DataFrame:
    """One canonical name per key."""
    return (
        name_map(df)
        .groupBy("company_key", "company_clean")
        .agg(F.count("*").alias("spellings"), F.sum("n_complaints").alias("n_complaints"))
    )


def canonicalise_companies(df: DataFrame) -> DataFrame:
    """Replace ``company`` by the canonical name of its key and keep text and key.

    The name side has one row per distinct text and is written first, so that the planner
    knows its size: small, it is broadcast and the facts stay where they are; otherwise the
    join shuffles and adaptive execution splits the partition of a frequent text.
    """
    known = _canonical(_spellings(df)).select("company", "company_raw", "company_key", "company_clean")
    with shuffles_dropped(df.sparkSession):
        known = settle(known, "spellings")  # the planner broadcasts by its measured size
    joined = df.join(known, "company", "left")
    return joined.withColumn("company", F.col("company_clean")).drop("company_clean")


def classify_geography(df: DataFrame) -> DataFrame:
    code = geography.state_code(F.col("state"))
    zip_code = geography.postcode(F.col("zip_code"))
    return (
        df.withColumn("dq_state_missing", code.isNull())
        .withColumn("state", F.coalesce(code, F.lit(geography.UNKNOWN_STATE)))
        .withColumn("state_type", geography.state_type(F.col("state")))
        .withColumn("zip_code", zip_code)
        .withColumn("dq_zip_masked", geography.postcode_masked(F.col("zip_code")))
        .withColumn("zip3", geography.postcode_prefix(F.col("zip_code")))
    )


def fill_and_flag(df: DataFrame, trend_end: str = TREND_END) -> DataFrame:
    filled = df.withColumns({c: outcomes.filled(c) for c in outcomes.TRIMMED_COLUMNS})
    flags = {
        **outcomes.tag_flags(F.col("tags")),
        **outcomes.outcome_flags(
            F.col("company_response"), F.col("company_public_response"), F.col("timely")
        ),
        "dq_sub_issue_missing": flag(F.col("sub_issue") == outcomes.SENTINELS["sub_issue"]),
        "dq_response_in_progress": flag(F.col("company_response") == "In progress"),
        "dq_long_routing_lag": outcomes.long_lag(F.col("days_to_company")),
        "dq_partial_period": dates.after_window(F.col("date_received"), trend_end),
        "has_narrative": flag(F.col("has_narrative").try_cast("boolean")),
    }
    return _apart(filled).withColumns(flags).withColumn("in_trend_window", ~F.col("dq_partial_period"))


def prepare(raw: DataFrame, trend_end: str = TREND_END) -> DataFrame:
    """Everything but the dedupe, with all clean columns."""
    steps = _apart(canonicalise_companies(_apart(raw)))
    for step in (type_dates, repair_taxonomy, classify_geography):
        steps = _apart(step(steps))
    return _apart(project(fill_and_flag(steps, trend_end)))


def project(df: DataFrame) -> DataFrame:
    """The fixed output columns; a missing one is an error."""
    missing = [c for c in CLEAN_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"columns not built: {missing}")
    return df.select(*CLEAN_COLUMNS)


def completeness(columns: list[str]):
    """Number of non-null values in a row."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), start=F.lit(0))


def drop_double_submissions(
    df: DataFrame, key: list[str] | None = None, tie_break: list[str] | None = None
) -> DataFrame:
    """One row per business key: the most complete, then the lowest id.

    Few rows repeat a key, so a first scan of the key columns alone finds the hashes of keys that
    occur more than once; only those are written. Rows with such a hash are shuffled and
    decided, on all columns of the key; the others stay where they are. The rank filter is applied
    in the map tasks already, so a key shared by a large part of the rows sends one row per
    task. Null key values are equal to each other. ``df`` must give the same rows each time.
    """
    key = key or BUSINESS_KEY
    best = Window.partitionBy("_hash", *key).orderBy(
        completeness(df.columns).desc(), *[F.asc_nulls_last(c) for c in tie_break or ["complaint_id"]]
    )
    hashed = df.withColumn("_hash", F.xxhash64(*key))
    repeated = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash")
    with shuffles_dropped(df.sparkSession):
        repeated = settle(repeated, "repeated-keys")
    alone = hashed.join(repeated, "_hash", "left_anti")
    contested = hashed.join(repeated, "_hash", "left_semi").withColumn("_rn", F.row_number().over(best))
    return alone.unionByName(contested.where("_rn = 1").drop("_rn")).drop("_hash")


def repeats(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key, counted and not removed: one row."""
    groups = df.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"),
    )


def clean(raw: DataFrame, trend_end: str = TREND_END) -> DataFrame:
    """The whole cleaning stage."""
    prepared = prepare(raw.select(*RAW_COLUMNS), trend_end)
    return drop_double_submissions(_landed(prepared, shared_folder(raw.sparkSession, "prepared")))


def _landed(prepared: DataFrame, path: str) -> DataFrame:
    """The prepared rows written below ``path`` and read back; the extract is read by no further job.

    The extract may be joined from tables, and what its joins move is larger than the rows themselves. A part is chosen by a
    hash of the id, which the scan of the table with the ids filters by, so a third of that is on disk at a time.
    """
    spark = prepared.sparkSession
    part = F.pmod(F.xxhash64("complaint_id"), F.lit(LANDING_PARTS))
    for k in range(LANDING_PARTS):
        writer = prepared.where(part == k).write.mode("append" if k else "overwrite").option("compression", "zstd")
        with shuffles_dropped(spark):
            writer.parquet(path)
    return spark.read.schema(prepared.schema).parquet(path)


def metric_columns() -> dict[str, Column]:
    """Counters of the cleaning stage over typed, repaired and flagged rows, one aggregate each."""
    lag = F.col("days_to_company")
    legacy_card = F.col("product_raw") == taxonomy.LEGACY_CARD_LABEL
    target = taxonomy.split_target(F.col("product_raw"), F.col("sub_product"))
    # Lags have three decimals: the percentile map of a task has at most a thousand entries a day of range.
    lags = F.percentile(lag, F.array(F.lit(0.5), F.lit(0.95)))
    return {
        "rows": F.count("*"),
        "unparsed_date_received": F.count_if(F.col("date_received_ts").isNull()),
        "sent_before_received": F.count_if(lag < 0),
        "lag_over_365_days": F.count_if("dq_long_routing_lag"),
        "median_lag": rounded(F.get(lags, F.lit(0)), 2),
        "p95_lag": rounded(F.get(lags, F.lit(1)), 2),
        "legacy_card_rows": F.count_if(legacy_card),
        "legacy_card_to_credit": F.count_if(target == "Credit card"),
        "legacy_card_to_prepaid": F.count_if(target == "Prepaid card"),
        "legacy_card_unmapped": F.count_if(legacy_card & target.isNull()),
        "renamed_product_rows": F.count_if(F.col("product_raw").isin(*taxonomy.RENAMED_LABELS)),
        "state_spelled_out": F.count_if(F.col("state") == "UM"),
        "state_missing": F.count_if("dq_state_missing"),
        "zip_masked": F.count_if("dq_zip_masked"),
        "zip3_recovered": F.count_if(F.col("zip3").isNotNull()),
        "no_tag": F.count_if(F.col("tags") == outcomes.SENTINELS["tags"]),
        "sub_issue_missing": F.count_if("dq_sub_issue_missing"),
        "in_progress": F.count_if("dq_response_in_progress"),
        "resolved": F.count_if("is_resolved"),
        "partial_period": F.count_if("dq_partial_period"),
    }


def _as_rows(one: DataFrame, names: list[str]) -> DataFrame:
    """The columns of a one-row relation as (metric, value)."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def clean_metrics(raw: DataFrame, trend_end: str = TREND_END) -> DataFrame:
    """Counters of the cleaning stage before the dedupe, as (metric, value), in one scan."""
    typed = fill_and_flag(classify_geography(repair_taxonomy(type_dates(raw))), trend_end)
    metrics = metric_columns()
    return _as_rows(typed.agg(*[m.cast("double").alias(name) for name, m in metrics.items()]), list(metrics))


def land_clean(raw: DataFrame, path: str, trend_end: str = TREND_END) -> tuple[DataFrame, DataFrame]:
    """Write the prepared facts below ``path`` and return them without double submissions, and the counters of all of them.

    The counters are those of the written rows, which hold each row once whatever task was repeated. Double submissions are
    found and decided on the written columns too, and the raw extract is read by no further job.
    """
    metrics = metric_columns()
    landed = _landed(prepare(raw.select(*RAW_COLUMNS), trend_end), path)
    counted = landed.agg(*[m.cast("double").alias(name) for name, m in metrics.items()])
    return drop_double_submissions(landed), _as_rows(counted, list(metrics))
