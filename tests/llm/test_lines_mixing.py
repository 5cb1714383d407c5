"""Line dedup and mixing: SQL on the test tables, brute force on edge cases."""

import hashlib
import math
from collections import defaultdict

import compare
import pytest
from plaintide.llm import lines, mixing
from plaintide.llm.queries import ORACLES, QUERIES

TEXT = "doc_id bigint, text string, source string, key string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


def brute_lines(rows, floor=10):
    spaces = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(spaces).translate(lower)
    held = defaultdict(set)
    order = lambda d: (d is None, d or 0)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= floor:
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(held[key(x)]) < 2 or min(held[key(x)], key=order) == d]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_edge_cases(spark):
    shared = "A shared Line of text"
    rows = [
        (5, None), (6, ""), (7, f"{shared}\nx\n\t a shared line OF text \r\n\n"), (3, f"top\n  {shared}\n{shared}"), (None, f"{shared}\nnull only line here"),
        (None, "null only line here"), (8, "short\nshort"), (9, "short\nÄÖÜ umlaut line"), (10, "äöü umlaut line\nÄÖÜ UMLAUT LINE"),
        (11, "\n".join(f"line number {i} of many" for i in range(700))), (12, "\n".join(f"LINE number {i} of many" for i in range(0, 700, 3))),
        (7, "another row of document seven"), (4, "another row of document seven"), (8, "short\nshort"),
    ]
    docs = spark.createDataFrame([(d, t, "s", "k") for d, t in rows], TEXT)
    docs = docs.withColumn("kept_text", docs.key).withColumn("n_lines", docs.key)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(docs).collect()), key=str)
    assert got == brute_lines(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def water(sizes, weights, most):
    """Shares targets by weight, again and again, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_edge_cases(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(400)] + [(i, "v " * 3, None) for i in range(1000, 1003)]
    rows += [(2000, None, "s0"), (2001, " \t", "s9"), (None, "n n n", "s1"), (3, "again here", "s3"), (3, "again here", "s3")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], TEXT)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    target = water(sizes, (5, 2, 1), 3)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= longest[source] + 1e-9
    key = lambda rs: sorted((str(r.doc_id), r.size, r.copies) for r in rs)
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(got)
    emitted = mixing.mixed(docs.withColumn("copy", docs.key).where("doc_id >= 1000 OR doc_id < 3"))
    assert emitted.columns == [*docs.columns, "copy"] and emitted.where("copy = 1").count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_hash_of_the_bitmaps_is_of_whole_texts(spark):
    """A long document behind a shared prefix keeps its own bitmap."""
    docs = spark.createDataFrame([(1, "the same first line", "s", "k"), (2, "the same first line\n" + "x" * 300_000, "s", "k")], TEXT)
    kept = {r.doc_id: r.kept_text for r in lines.dedup_lines(docs).collect()}
    assert hashlib.sha256(kept[2].encode()).hexdigest() == hashlib.sha256(b"x" * 300_000).hexdigest()
