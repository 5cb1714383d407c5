"""Sharding against an exact sort of all keys."""

import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from plaintide.llm import sharding
from plaintide.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, shard string, text_key int, size string"


def hashed(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 42)


def brute_order(rows):
    """(doc_id, text) in the order of the shards."""

    def key(row):
        h = hashed((row[1] or "").encode())
        i = 42 if row[0] is None else hashed(row[0].to_bytes(8, "little", signed=True))
        # Signed order of Spark's hashes.
        return tuple((v + (1 << 63)) % (1 << 64) for v in (h, i))

    return sorted(rows, key=key)


def brute_check(rows, got, count, tolerance=sharding.TOLERANCE):
    """Shards are stretches of the order, slots gapless, and every cut as near to its target as allowed."""
    by_row = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.text_crc32), []).append(r)
    order = brute_order(rows)
    sizes = [len((t or "").encode()) + 8 for _, t in order]
    placed = []
    for (i, t), size in zip(order, sizes):
        found = by_row[(i, zlib.crc32((t or "").encode()))]
        found.sort(key=lambda r: (r.shard, r.slot))
        row = found.pop(0)
        assert row.size == size
        placed.append(row)
    assert not any(by_row.values()) and len(got) == len(rows)
    shards = [r.shard for r in placed]
    assert shards == sorted(shards) and set(shards) <= set(range(count))
    for k in range(count):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(shards.count(k)))
    total, below = sum(sizes), 0
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    for k in range(1, count):
        cut = sum(sizes[: sum(s < k for s in shards)])
        best = min(abs(e - total * k / count) for e in ends)
        assert abs(cut - total * k / count) <= max(best, tolerance * total / count) + 1e-6


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = QUERIES["op13_sharding"](spark, sf_dir).collect()
    brute_check(rows, got, 24)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of all rows are copies of one text, some rows repeat both id and text, ids and texts are missing."""
    rows = [(i, "copy " * 30) for i in range(400)] + [(9000, "same row")] * 150 + [(None, None)] * 40
    rows += [(1000 + i, "word " * (i % 37)) for i in range(500)] + [(5, "x" * 9000), (6, ""), (None, "é" * 70)]
    return rows


def test_crowded_texts_and_rows(spark, crowd):
    docs = spark.createDataFrame([(i, t, "s", 1, "z") for i, t in crowd], SCHEMA).repartition(5)
    for cell_rows in (sharding.CELL_ROWS, 16):
        got = sharding.shards(docs, count=7, cell_rows=cell_rows).collect()
        assert got[0].asDict().keys() == {"doc_id", "size", "text_crc32", "shard", "slot"}
        brute_check(crowd, got, 7)
    total = sum(len((t or "").encode()) + 8 for _, t in crowd)
    for k in range(7):
        assert abs(sum(r.size for r in got if r.shard == k) - total / 7) <= 9008 + total / 700


def test_copies_stay_together_within_the_tolerance(spark):
    rows = [(i, f"text {i % 300}") for i in range(900)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string"), count=4, tolerance=0.02)
    torn = got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert torn == 0


def test_reruns_agree(spark, crowd):
    docs = spark.createDataFrame([(i, t) for i, t in crowd if i != 9000], "doc_id bigint, text string")
    runs = [sorted(map(tuple, sharding.shards(d, 5).collect()), key=str) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]


def test_empty_table_and_more_shards_than_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shards(empty).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    rows = sharding.shards(few).collect()
    assert len({r.shard for r in rows}) == 2 and {r.slot for r in rows} == {0}


def test_written_shards_hold_the_documents(spark, crowd, tmp_path):
    docs = spark.createDataFrame([(i, t, "s", 1, "z") for i, t in crowd], SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "out"), count=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = sharding.shards(docs, count=6).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    got = back.groupBy("shard").agg(F.sum(size).alias("n")).collect()
    assert sum(r.n for r in got) == sum(r.n for r in expected)
    near = {r.shard: r.n for r in expected}
    assert all(abs(near[r.shard] - r.n) <= 700 for r in got)
    assert back.drop("shard").exceptAll(docs.drop("shard")).count() == 0 and back.columns == ["doc_id", "text", "text_key", "size", "shard"]
