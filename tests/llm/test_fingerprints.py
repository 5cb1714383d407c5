"""Document fingerprints against a brute-force version."""

import hashlib
import math

import duckdb
import xxhash
from plaintide.llm import fingerprints as fp
from plaintide.llm.queries import QUERIES
from pyspark.sql import functions as F


def engine_hash(label: str, text: str) -> int:
    """XXH64 of two strings one after the other, seeded by the hash of the first."""
    return xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(label.encode(), 42))


def brute_lanes(text: str) -> list[int]:
    lanes = [0] * (8 + 1 + 128)
    for line in text.split("\n"):
        for k in range(4):
            h = engine_hash(f"line {k}", "\n" + line)
            lanes[2 * k] += h & 0xFFFFFFFF
            lanes[2 * k + 1] += h >> 32
        for at in range(0, len(line), 32):
            lanes[8] += 1
            for k in range(2):
                h = engine_hash(f"piece {k}", line[at : at + 32])
                for i in range(32):
                    lanes[9 + 32 * k + i] += h >> i & 1
                    lanes[9 + 64 + 32 * k + i] += h >> (32 + i) & 1
    return [v % 2**32 for v in lanes]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = [2 * v - a[8] for v in a[9:]], [2 * v - b[8] for v in b[9:]]
    scale = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return max(0.0, min(1.0, sum(v * w for v, w in zip(x, y)) / scale)) if scale else 0.0


def expected(rows):
    """Rows (doc_id, text) in the order of the operator."""
    out = []
    as_text = lambda lanes: "".join(f"{v:08x}" for v in lanes)
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, e, n = brute_lanes(text), brute_lanes(edited), brute_lanes(following)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(e), round(brute_likeness(a, e), 9), round(brute_likeness(a, n), 9)))
    return out


def got(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    assert sorted(got(QUERIES["op1_fingerprints"](spark, sf_dir))) == sorted(expected(rows))


def test_edge_cases(spark):
    rows = [(9, "b\na", 1), (9, "a\nb", 2), (7, None, 3), (5, "", 4), (3, "x" * 300_000 + "\n\n" + "ü𝄞" * 9, 5), (-4, "one", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, cut int")
    ordered = [(9, "a\nb"), (9, "b\na"), (7, ""), (5, ""), (3, rows[4][1]), (-4, "one")]
    assert sorted(got(fp.compare_neighbours(docs))) == sorted(expected(ordered))
    single = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert got(fp.compare_neighbours(single)) == expected([(1, "abc")])
    assert fp.compare_neighbours(docs.limit(0)).count() == 0


def test_null_ids_follow_into_the_largest(spark):
    docs = spark.createDataFrame([(None, "abcd"), (None, "zz"), (2, "12"), (8, "34")], "doc_id bigint, text string")
    rows = {(r.doc_id, r.n_chars): r.edited_sha256 for r in fp.compare_neighbours(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {(None, 4): sha("ab34"), (None, 2): sha("z3"), (8, 2): sha("31"), (2, 2): sha("13")}
    alone = fp.compare_neighbours(docs.where("doc_id IS NULL")).collect()
    assert all(r.near_edited == 1.0 or r.n_chars for r in alone) and len(alone) == 2


def test_insertion_and_deletion_are_incremental(spark):
    docs = spark.createDataFrame([("ab", "l1\nl2\nl3"), ("a", "l1\nl3"), ("b", "l2"), ("ba", "l3\nl2\nl1")], "k string, text string")
    lanes = {r.k: r.lanes for r in fp.fingerprints(docs, "k").collect()}
    assert lanes["ab"] == lanes["ba"]
    row = spark.createDataFrame([(lanes["ab"], lanes["a"], lanes["b"])], "ab array<bigint>, a array<bigint>, b array<bigint>")
    out = row.select(fp.add(F.col("a"), F.col("b")).alias("s"), fp.remove(F.col("ab"), F.col("b")).alias("d")).first()
    assert out.s == lanes["ab"] and out.d == lanes["a"]
