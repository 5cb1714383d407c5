"""Files in, files out, and the incremental ingest."""

import datetime
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide import schemas
from plaintide.plans import cleaning
from plaintide.session import shared_folder
from plaintide.sources import bulk, history, pages, tables
from plaintide.streaming import ingest


def test_csv_text_round_trip(spark):
    rows = [("1", 'say "hi"\nthere, friend', "None"), ("007", None, " x ")]
    df = spark.createDataFrame(rows, "id string, text string, note string")
    path = shared_folder(spark, "csv")
    tables.write_csv(df, path)
    back = bulk.scan_strings(spark, path, df.schema)
    assert back.schema == df.schema
    got = {r["id"]: tuple(r) for r in back.collect()}
    assert got["1"] == rows[0] and got["007"][1] is None


def test_bulk_extract_from_file(spark):
    path = shared_folder(spark, "bulk")
    header = ["Complaint ID", "Date received", "Product", "Timely response?", "Consumer complaint narrative", "Sub-product"]
    rows = [
        ("1", "2024-01-31", "Mortgage", "Yes", "a text", "x"),
        ("2", "2026-02-01", "Mortgage", "Yes", None, "x"),
        ("3", "not a date", "Mortgage", "Yes", None, "x"),
        ("4", "2024-01-31", "Something else", "Yes", None, "x"),
    ]
    tables.write_csv(spark.createDataFrame(rows, T.StructType([T.StructField(h, T.StringType()) for h in header])), path)
    got = bulk.bulk_extract(bulk.scan_bulk(spark, path), "2023-01-01", "2026-01-01")
    assert got.columns == [*schemas.RAW_COLUMNS, schemas.NARRATIVE_FIELD]
    only = got.collect()
    assert [r["complaint_id"] for r in only] == ["1"]
    assert (only[0]["timely"], only[0]["sub_product"], only[0]["state"]) == ("Yes", "x", None)


def _page(spark, folder, name, ids):
    hits = [{"_source": {"complaint_id": i, "product": "Mortgage"}, "sort": [1, i]} for i in ids]
    text = json.dumps({"hits": {"total": {"value": len(ids)}, "hits": hits}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(folder)


def test_restart_adds_no_duplicates_and_scope_is_guarded(spark):
    landing, root = shared_folder(spark, "landing"), shared_folder(spark, "ingest")
    scope = {"from": "2023-01-01", "products": ["Mortgage"]}
    _page(spark, landing, "a", ["1", "2", "2", None])
    assert ingest.ingest_available(spark, landing, root, scope).count() == 2
    assert ingest.ingest_available(spark, landing, root, scope).count() == 2
    _page(spark, landing, "b", ["2", "3"])
    stored = ingest.ingest_available(spark, landing, root, scope)
    assert sorted(r["complaint_id"] for r in stored.collect()) == ["1", "2", "3"]
    with pytest.raises(ingest.ScopeChanged):
        ingest.ingest_available(spark, landing, root, {"from": "2022-01-01"})


def test_watermark_drops_repeats_within_the_delay(spark):
    landing, root = shared_folder(spark, "landing"), shared_folder(spark, "ingest")
    days = {"1": "2024-01-05T00:00:00Z", "2": "2024-01-06T00:00:00Z"}
    hits = [{"_source": {"complaint_id": i, "date_received": days[i]}} for i in ("1", "1", "2")]
    page = [(json.dumps({"hits": {"hits": hits}}),)]
    for _ in range(2):
        spark.createDataFrame(page, "value string").coalesce(1).write.mode("append").text(landing)
        stored = ingest.ingest_available(spark, landing, root, {}, watermark=("date_received", "10 days"))
        assert sorted(r["complaint_id"] for r in stored.collect()) == ["1", "2"]


def test_replace_table(spark):
    name = f"replaced_{uuid.uuid4().hex}"
    for rows in (5, 3):
        tables.replace_table(spark.range(rows), name)
        assert spark.table(name).count() == rows
    # A write that fails leaves the name at what it read before; so does one that is under way.
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(broken, name)
    assert spark.table(name).count() == 3
    reader = spark.table(name)
    tables.replace_table(spark.table(name).selectExpr("id", "id * 2 AS twice"), name)
    assert reader.count() == 3 and reader.columns == ["id"]  # begun before the swap
    assert sorted(map(tuple, spark.table(name).collect())) == [(0, 0), (1, 2), (2, 4)]
    assert tables.sweep_versions(spark, name) == 3
    assert spark.table(name).count() == 3 and tables.sweep_versions(spark, name) == 0
    spark.sql(f"DROP VIEW {name}")


def test_reports_side_by_side_with_a_limit(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(60)
        return x

    reports = {
        "hangs": lambda s, d: s.range(2).select(slow("id").alias("id")),
        "good": lambda s, d: s.range(5),
        "bad": lambda s, d: s.range(1).select(F.raise_error(F.lit("no such rows")).cast("long").alias("id")),
        "fine": lambda s, d: s.range(7),
    }
    target = shared_folder(spark, "side")
    started = time.time()
    failures = tables.run_named(spark, reports, "", target, side_by_side=2, limit=12)
    assert time.time() - started < 50
    assert failures.keys() == {"hangs", "bad"} and "12" in failures["hangs"] and "no such rows" in failures["bad"]
    for name, rows in (("good", 5), ("fine", 7)):
        assert spark.read.option("header", True).csv(f"{target}/{name}").count() == rows


def test_history_is_not_shuffled_and_runs_equal_one(spark):
    name = f"ids_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(i % 40 if i % 11 else None, i) for i in range(400)], "id bigint, at int")
    parts = [rows.where(f"at % 3 = {k}") for k in range(3)]
    found = [history.ingest(part, "id", ["at"], name, 8) for part in parts]
    ids = [r.id for run in found for r in run.collect()]
    assert sorted(ids) == list(range(40)) == sorted(r.id for r in pages.first_seen(rows, "id", ["at"]).collect())
    assert history.ingest(rows, "id", ["at"], name, 8).count() == 0
    assert spark.table(name).count() == 40
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pages.first_seen(rows, "id", ["at"], spark.table(name))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    stored = plan[plan.index("\n   +- ") :]  # the right side of the join
    assert "Bucketed: true" in stored and "Exchange" not in stored and "SortMergeJoin" in plan
    spark.sql(f"DROP TABLE {name}")


def test_first_seen_skips_null_and_known_ids(spark):
    new = spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c"), ("2", "d")], "id string, v string")
    old = spark.createDataFrame([("2",)], "id string")
    got = pages.first_seen(new, "id", ["v"], old).collect()
    assert [tuple(r) for r in got] == [("1", "a")]


def test_hits_keep_the_order_they_landed_in(spark, tmp_path):
    """Of records that repeat an id the first in page order stays, whatever else they hold."""
    for name, values in (("a", ["9", "1"]), ("b", ["0"])):
        hits = [{"_source": {"complaint_id": "7", "issue": v}} for v in values]
        (tmp_path / f"{name}.json").write_text(json.dumps({"hits": {"hits": hits}}))
    rows = pages.search_hits(pages.read_pages(spark, str(tmp_path), schemas.SEARCH_PAGE), place="place")
    assert pages.first_seen(rows, "complaint_id", ["place"]).first()["issue"] == "9"


def test_bulk_export_lands_in_pieces(spark, tmp_path):
    source = str(tmp_path / "in")
    text = spark.createDataFrame([(str(i), "two\nlines") for i in range(40)], "Complaint_ID string, Issue string")
    tables.write_csv(text.coalesce(1), source)
    landed = bulk.land_bulk(spark, source, str(tmp_path / "out"), 4)
    assert landed.count() == 40 and landed.where("Issue = 'two\\nlines'").count() == 40


def test_narratives_split_and_rejoin(spark):
    df = spark.createDataFrame([("1", " a\n"), ("2", " \n "), ("3", None)], "complaint_id string, complaint_what_happened string")
    side = pages.narratives(df)
    assert [tuple(r) for r in side.collect()] == [("1", "a")]
    back = pages.rejoin_narratives(pages.without_narrative(df), side)
    assert {r[0]: r[1] for r in back.collect()} == {"1": "a", "2": None, "3": None}


SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("day", T.DateType()), T.StructField("flag", T.BooleanType())]
)


def test_typed_load(spark):
    df = spark.createDataFrame([("1", "2024-01-02", "True"), ("2", "", "")], "id string, day string, flag string")
    got = sorted(tuple(r) for r in tables.typed(df, SCHEMA).collect())
    assert got[0] == (1, datetime.date(2024, 1, 2), True) and got[1] == (2, None, None)


@pytest.mark.parametrize("bad", [("", "2024-01-02", "True"), ("x", "2024-01-02", "True"), ("1", "2024-13-02", "True")])
def test_typed_load_fails_on_bad_rows(spark, bad):
    df = spark.createDataFrame([bad], "id string, day string, flag string")
    with pytest.raises(Exception):  # noqa: B017
        tables.typed(df, SCHEMA).collect()


def test_clean_facts_fit_the_declared_schema(spark, sf_dir):
    from plaintide.bindings import tables as t

    clean = cleaning.clean(t.raw_complaints(spark, sf_dir), t.TREND_END)
    assert [(f.name, f.dataType) for f in clean.schema] == [(f.name, f.dataType) for f in schemas.CLEAN_COMPLAINTS]


def test_sinks_views_and_runner(spark):
    df = spark.range(5).withColumn("g", F.col("id") % 2)
    path = shared_folder(spark, "sink")
    tables.write_parquet(df, path, ["g"])
    assert spark.read.parquet(path).count() == 5
    tables.register_views({"v_numbers": df})
    assert spark.sql("SELECT count(*) FROM v_numbers").first()[0] == 5

    def broken(session, source):
        raise ValueError("no such thing\nmore")

    target = shared_folder(spark, "runner")
    failures = tables.run_named(spark, {"good": lambda s, d: df, "bad": broken}, "", target)
    assert failures == {"bad": "no such thing"}
    assert spark.read.option("header", True).csv(f"{target}/good").count() == 5
    tables.sample_extract(df, f"{target}/sample", rows=2, key="id")
    assert spark.read.option("header", True).csv(f"{target}/sample").count() == 2
