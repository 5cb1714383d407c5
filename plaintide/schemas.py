"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = [
    "complaint_id", "date_received", "date_sent_to_company", "product", "sub_product", "issue",
    "sub_issue", "company", "state", "zip_code", "tags", "submitted_via",
    "company_public_response", "company_response", "timely", "has_narrative",
]
NARRATIVE_FIELD = "complaint_what_happened"


def all_strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_COMPLAINTS = all_strings(RAW_COLUMNS)

_NEVER_NULL = False
CLEAN_COMPLAINTS = T.StructType(
    [
        T.StructField("complaint_id", T.StringType(), _NEVER_NULL),
        T.StructField("date_received", T.DateType()),
        T.StructField("date_received_ts", T.TimestampType()),
        T.StructField("date_sent_to_company", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year_month", T.StringType()),
        T.StructField("days_to_company", T.DoubleType()),
        T.StructField("product", T.StringType()),
        T.StructField("product_short", T.StringType()),
        T.StructField("product_raw", T.StringType()),
        T.StructField("sub_product", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("sub_issue", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("company_raw", T.StringType()),
        T.StructField("company_key", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("state_type", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("zip3", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("is_servicemember", T.BooleanType()),
        T.StructField("is_older_american", T.BooleanType()),
        T.StructField("submitted_via", T.StringType()),
        T.StructField("company_response", T.StringType()),
        T.StructField("company_public_response", T.StringType()),
        T.StructField("timely", T.StringType()),
        T.StructField("has_narrative", T.BooleanType()),
        T.StructField("is_resolved", T.BooleanType()),
        T.StructField("got_monetary_relief", T.BooleanType()),
        T.StructField("got_any_relief", T.BooleanType()),
        T.StructField("closed_explanation_only", T.BooleanType()),
        T.StructField("is_untimely", T.BooleanType()),
        T.StructField("company_disputes_facts", T.BooleanType()),
        T.StructField("dq_state_missing", T.BooleanType()),
        T.StructField("dq_zip_masked", T.BooleanType()),
        T.StructField("dq_sub_issue_missing", T.BooleanType()),
        T.StructField("dq_response_in_progress", T.BooleanType()),
        T.StructField("dq_long_routing_lag", T.BooleanType()),
        T.StructField("dq_partial_period", T.BooleanType()),
        T.StructField("dq_legacy_product_label", T.BooleanType()),
        T.StructField("in_trend_window", T.BooleanType()),
    ]
)
CLEAN_COLUMNS = CLEAN_COMPLAINTS.names

# Institution feed: fields of one record as delivered.
INSTITUTION_FIELDS = [
    "NAME", "CERT", "ASSET", "CITY", "STALP", "ACTIVE", "BKCLASS", "RSSDHCR", "NAMEHCR", "OFFDOM",
    "ESTYMD",
]
INSTITUTION_PAGE = T.StructType(
    [
        T.StructField(
            "data",
            T.ArrayType(T.StructType([T.StructField("data", all_strings(INSTITUTION_FIELDS))])),
        )
    ]
)
SEARCH_PAGE = T.StructType(
    [
        T.StructField(
            "hits",
            T.StructType(
                [
                    T.StructField(
                        "hits",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "_source", all_strings([*RAW_COLUMNS, NARRATIVE_FIELD])
                                    ),
                                    T.StructField("sort", T.ArrayType(T.StringType())),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)
