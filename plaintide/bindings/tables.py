"""Binding of the test tables to the complaint domain (see FIXTURES.md).

``facts`` yields the typed, clean fact shape; ``raw_complaints`` the all-string
extract shape with legacy labels, spelling variants, masks and gaps. Both join
only the tables the requested columns need, and leave the choice of join to the
planner, which knows the file sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.functions import dates, geography, outcomes, taxonomy

TREND_END = "2001-07-31"
VOLUME_FLOOR = 600
RESOLVED_FLOOR = 400

_JOINS = {
    "orders": ("o_orderkey", "l_orderkey", []),
    "part": ("p_partkey", "l_partkey", []),
    "supplier": ("s_suppkey", "l_suppkey", []),
    "customer": ("c_custkey", "o_custkey", ["orders"]),
    "nation": ("n_nationkey", "c_nationkey", ["orders", "customer"]),
}


# Declared, so that no job reads file footers to infer them.
_SCHEMAS = {
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
        props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    """Lines with the needed sides."""
    df = table(spark, sf_dir, "lineitem")
    for name, (key, foreign, via) in _JOINS.items():
        if name in needed or any(name in _JOINS[other][2] for other in needed & set(_JOINS)):
            side = table(spark, sf_dir, name)
            df = df.join(side, F.col(foreign) == F.col(key))
    if "company" in needed:
        df = df.join(company_names(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    return df


# Values that several fact columns are read from, computed once per row.
_SHARED = {
    "received": ("orders", "CAST(o_orderdate AS DATE)"),
    "response": (
        "orders",
        """CASE WHEN o_orderstatus = 'P' THEN 'In progress'
        WHEN l_returnflag = 'R' THEN 'Closed with monetary relief'
        WHEN l_returnflag = 'A' THEN 'Closed with non-monetary relief'
        ELSE 'Closed with explanation' END""",
    ),
    "public": (
        "",
        f"""CASE WHEN l_tax >= 0.07 THEN '{outcomes.DISPUTED}'
        ELSE '{outcomes.SENTINELS['company_public_response']}' END""",
    ),
    "on_time": ("", "CASE WHEN l_discount >= 0.09 THEN 'No' ELSE 'Yes' END"),
    "marks": (
        "customer",
        """CASE c_mktsegment WHEN 'MACHINERY' THEN 'Servicemember'
        WHEN 'HOUSEHOLD' THEN 'Older American' ELSE 'No tag' END""",
    ),
    "code": (
        "customer",
        """CASE WHEN c_custkey % 5 = 0 THEN concat(lpad(c_custkey % 100000 DIV 100, 3, '0'), 'XX')
        ELSE lpad(c_custkey % 100000, 5, '0') END""",
    ),
}


def _lag() -> Column:
    return dates.days_between(F.col("o_orderdate"), F.col("l_shipdate"))


def _outcome(name: str):
    return lambda: outcomes.outcome_flags(F.col("response"), F.col("public"), F.col("on_time"))[name]


# Needed table and expression of each fact column.
_FACTS = {
    "complaint_id": ("", lambda: F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)")),
    "date_received": ("orders", lambda: F.col("received")),
    "date_received_ts": ("orders", lambda: F.col("o_orderdate").cast("timestamp")),
    "date_sent_to_company": ("", lambda: F.col("l_shipdate").cast("date")),
    "year": ("orders", lambda: F.year("received")),
    "month": ("orders", lambda: F.month("received")),
    "year_month": ("orders", lambda: dates.year_month(F.col("received"))),
    "days_to_company": ("orders", _lag),
    "product": ("part", lambda: F.col("p_type")),
    "product_short": ("part", lambda: taxonomy.short_product(F.col("p_type"))),
    "sub_product": ("customer", lambda: F.col("c_mktsegment")),
    "issue": ("part", lambda: F.col("p_brand")),
    "sub_issue": ("", lambda: F.col("l_linestatus")),
    "company": ("company", lambda: F.col("company_name")),
    "state": ("nation", lambda: F.col("n_name")),
    "state_type": (
        "nation",
        lambda: F.expr("CASE n_regionkey WHEN 3 THEN 'territory' WHEN 4 THEN 'military' ELSE 'state' END"),
    ),
    "zip_code": ("customer", lambda: F.col("code")),
    "zip3": ("customer", lambda: geography.postcode_prefix(F.col("code"))),
    "tags": ("customer", lambda: F.col("marks")),
    "is_servicemember": ("customer", lambda: outcomes.tag_flags(F.col("marks"))["is_servicemember"]),
    "is_older_american": ("customer", lambda: outcomes.tag_flags(F.col("marks"))["is_older_american"]),
    "submitted_via": ("orders", lambda: F.col("o_orderpriority")),
    "company_response": ("orders", lambda: F.col("response")),
    "company_public_response": ("", lambda: F.col("public")),
    "timely": ("", lambda: F.col("on_time")),
    "has_narrative": ("", lambda: F.col("l_quantity") >= 25),
    "is_resolved": ("orders", _outcome("is_resolved")),
    "got_monetary_relief": ("orders", _outcome("got_monetary_relief")),
    "got_any_relief": ("orders", _outcome("got_any_relief")),
    "closed_explanation_only": ("orders", _outcome("closed_explanation_only")),
    "is_untimely": ("orders", _outcome("is_untimely")),
    "company_disputes_facts": ("orders", _outcome("company_disputes_facts")),
    "dq_long_routing_lag": ("orders", lambda: outcomes.long_lag(_lag())),
    "in_trend_window": ("orders", lambda: F.col("received") <= F.lit(TREND_END).cast("date")),
}


def facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Typed complaint facts with the named columns (all of them by default)."""
    chosen = columns or tuple(_FACTS)
    needed = {_FACTS[c][0] for c in chosen} - {""}
    df = _joined(spark, sf_dir, needed)
    present = {"", *needed, *(via for name in needed & set(_JOINS) for via in _JOINS[name][2])}
    shared = {name: F.expr(sql) for name, (source, sql) in _SHARED.items() if source in present}
    return df.withColumns(shared).select(*[_FACTS[c][1]().alias(c) for c in chosen])


_RAW_COLUMNS = {
    "complaint_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "date_received": """CASE WHEN o_orderkey % 500 = 1 THEN 'n/a' ELSE concat(
        CAST(received AS STRING),
        CASE o_orderkey % 3 WHEN 0 THEN 'T12:00:00Z' WHEN 1 THEN 'T12:00:00-05:00'
        ELSE 'T12:30:00+00:00' END) END""",
    "date_sent_to_company": "concat(CAST(sent AS STRING), 'T12:00:00-05:00')",
    "product": """CASE p_type WHEN 'ECONOMY' THEN 'Credit card or prepaid card'
        WHEN 'LARGE' THEN 'Payday loan, title loan, or personal loan' WHEN 'MEDIUM' THEN 'Mortgage'
        WHEN 'PROMO' THEN 'Student loan' WHEN 'SMALL' THEN 'Checking or savings account'
        ELSE 'Vehicle loan or lease' END""",
    "sub_product": """CASE p_size % 9 WHEN 0 THEN 'General-purpose credit card or charge card'
        WHEN 1 THEN 'Store credit card' WHEN 2 THEN 'General-purpose prepaid card'
        WHEN 3 THEN 'Government benefit card' WHEN 4 THEN 'Gift card' WHEN 5 THEN 'Payroll card'
        WHEN 6 THEN 'Student prepaid card' WHEN 7 THEN 'Other card' END""",
    "issue": "CASE WHEN p_brand <> 'Brand#25' THEN concat('  ', p_brand, ' ') END",
    "sub_issue": "CASE WHEN l_linenumber <> 7 THEN l_linestatus END",
    "company": """CASE l_linenumber % 4 WHEN 0 THEN s_name WHEN 1 THEN concat(upper(s_name), ', Inc.')
        WHEN 2 THEN concat('  The ', s_name, '  LLC') ELSE
        concat(replace(s_name, '#', '  '), ' Corp., Inc.') END""",
    "state": """CASE WHEN n_nationkey <> 24 THEN element_at(array('CA', 'tx ', 'NY', 'FL', 'il', ' PA',
        'OH', 'GA', 'NC', 'MI', 'NJ', 'VA', 'WA', 'AZ', 'MA', 'TN', 'IN', 'MO', 'DC', 'PR', 'GU', 'AE',
        'ZZ', 'United States Minor Outlying Islands'), n_nationkey + 1) END""",
    "zip_code": """CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 50 = 7 THEN 'xxxxx'
        WHEN c_custkey % 5 = 0 THEN concat(lpad(c_custkey % 100000 DIV 100, 3, '0'), 'xx')
        ELSE lpad(c_custkey % 100000, 5, '0') END""",
    "tags": """CASE c_mktsegment WHEN 'MACHINERY' THEN 'Servicemember'
        WHEN 'HOUSEHOLD' THEN 'Older American, Servicemember'
        WHEN 'FURNITURE' THEN ' Older American ' END""",
    "submitted_via": "o_orderpriority",
    "company_public_response": f"CASE WHEN disputed THEN '{outcomes.DISPUTED}' END",
    "company_response": """CASE WHEN single THEN NULL WHEN o_orderstatus = 'P' THEN 'In progress'
        WHEN l_returnflag = 'R' THEN 'Closed with monetary relief'
        WHEN l_returnflag = 'A' THEN 'Closed with non-monetary relief'
        ELSE 'Closed with explanation' END""",
    "timely": "CASE WHEN late THEN 'No' WHEN discounted THEN 'Yes' END",
    "has_narrative": "CASE WHEN told THEN 'True' ELSE 'False' END",
}
# What the extract takes of a line and of an order: as narrow as it can be while rows are moved.
_RAW_LINE = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
    "CAST(l_shipdate AS DATE) AS sent", "l_quantity = 1 AS single", "l_quantity >= 25 AS told",
    "l_tax >= 0.07 AS disputed", "l_discount >= 0.09 AS late", "l_discount > 0 AS discounted",
]
_RAW_ORDER = [
    "o_orderkey", "CAST(o_orderdate AS DATE) AS received", "o_orderstatus", "o_orderpriority", "c_custkey",
    "c_mktsegment", "n_nationkey",
]


def raw_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen-column all-string extract.

    Customers are joined to orders, of which there are fewer than lines, so a line is moved for its part and for its
    order alone, and the texts are made after that.
    """
    of_order = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")),
        F.col("c_custkey") == F.col("o_custkey"),
    )
    lines = table(spark, sf_dir, "lineitem").selectExpr(*_RAW_LINE)
    df = (
        lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(of_order.selectExpr(*_RAW_ORDER), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    )
    return df.select(*[F.expr(sql).alias(name) for name, sql in _RAW_COLUMNS.items()])


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One charter per supplier; every seventh has a blank parent."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_name AS NAME",
        "CAST(s_suppkey AS STRING) AS CERT",
        "CASE WHEN s_suppkey % 50 = 49 THEN 'unknown' "
        "ELSE CAST(CAST(s_acctbal * 1000 AS DECIMAL(20,2)) AS STRING) END AS ASSET",
        "n_name AS CITY",
        "concat('S', s_nationkey) AS STALP",
        "CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS ACTIVE",
        "CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE n_name END AS NAMEHCR",
    )


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a two-word trade name, their nation and a padded number."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    nation = table(spark, sf_dir, "nation")
    return (
        supplier.join(part, F.col("p_partkey") == F.col("s_suppkey"))
        .join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
        .withColumn("k", F.expr("concat('K', lpad(s_suppkey, 6, '0'))"))
        .withColumn("w1", F.expr("split_part(p_name, ' ', 1)"))
        .withColumn("w2", F.expr("split_part(p_name, ' ', 2)"))
    )


def named_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active charters with word names, for the match."""
    return _named(spark, sf_dir).where("s_acctbal > 0").selectExpr(
        """CASE WHEN s_suppkey = 8 THEN 'Citibank, National Association' ELSE
           concat(p_name, ' ', n_name, ' ', k, ' Bank, National Association') END AS NAME""",
        "CAST(s_suppkey AS STRING) AS CERT",
        "CAST(CAST(s_acctbal * 1000 AS DECIMAL(20,2)) AS STRING) AS ASSET",
        "concat('S', s_nationkey) AS STALP",
        "CASE WHEN s_suppkey % 7 <> 0 THEN n_name END AS NAMEHCR",
    )


COMPANY_VARIANTS = """CASE s_suppkey % 10
    WHEN 0 THEN concat('The ', p_name, ' ', n_name, ' ', k, ' Bank N.A.')
    WHEN 1 THEN concat(k, ' ', w2, ' ', w1, ' Nation Financial Group, Inc.')
    WHEN 2 THEN concat(p_name, ' ', k, ' Bank')
    WHEN 3 THEN concat(p_name, ' Nation Alpha ', k, ' Bancorp')
    WHEN 4 THEN concat(w1, ' ', k, ' Bank')
    WHEN 5 THEN concat(p_name, ' ', k, ' Federal Credit Union')
    WHEN 6 THEN concat('Equifax ', k)
    WHEN 7 THEN CASE WHEN s_suppkey = 7 THEN 'Discover Bank'
        ELSE concat('Zyx', k, ' Quo', k, ' Partners') END
    WHEN 8 THEN CASE WHEN s_suppkey = 8 THEN 'CITIBANK, N.A.'
        ELSE concat('Nation Trust ', s_suppkey) END
    ELSE concat(w1, ' & ', w2, ' ', n_name, ' ', k, ' Bk Natl Assn') END"""


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which the facts of each supplier are filed."""
    return _named(spark, sf_dir).select("s_suppkey", F.expr(COMPANY_VARIANTS).alias("company_name"))


def named_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies named after the institutions with the variations a match must handle."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_complaints"))
    named = _named(spark, sf_dir).select("s_suppkey", F.expr(COMPANY_VARIANTS).alias("company"))
    return named.join(counts, F.col("s_suppkey") == F.col("l_suppkey")).select("company", "n_complaints")
