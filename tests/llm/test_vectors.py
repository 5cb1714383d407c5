"""Vector codes: Orchard's search and the whole compression against brute force."""

import numpy as np
import pytest

import compare
from plaintide.llm import vectors
from plaintide.llm.orchard import Codebook
from plaintide.llm.queries import ORACLES, QUERIES


def brute_nearest(entries, queries):
    """All distances in Python's integers; the first of the least."""
    e, q = entries.astype(object), queries.astype(object)
    apart = ((q[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    best = [min(range(len(e)), key=lambda k: (row[k], k)) for row in apart]
    return best, [row[k] for row, k in zip(apart, best)]


@pytest.mark.parametrize("n, width, spread, size", [(256, 16, 400, 400), (256, 3, 4, 5), (17, 1, 6, 9), (1, 4, 3, 3), (200, 2, 1, 2), (40, 5, 10**9, 3)])
def test_search_is_exact(n, width, spread, size):
    """Ties, repeated entries, codebooks of one entry, and numbers beyond what floats hold."""
    rng = np.random.default_rng(n * width)
    centres = rng.integers(-spread, spread + 1, (12, width))
    entries = centres[rng.integers(0, 12, n)] + rng.integers(-size, size + 1, (n, width))
    queries = centres[rng.integers(0, 12, 300)] + rng.integers(-size, size + 1, (300, width))
    book = Codebook(entries, int(max(np.abs(entries).max(), np.abs(queries).max())))
    code, distance = book.nearest(queries)
    assert (code.tolist(), distance.tolist()) == brute_nearest(entries, queries)
    assert book.nearest(queries[:0])[0].shape == (0,)


def test_search_leaves_entries_out():
    """Of well separated groups of entries only the near ones are compared."""
    rng = np.random.default_rng(2)
    entries = np.repeat(np.arange(256)[:, None] // 32 * 10_000, 4, axis=1) + rng.integers(0, 50, (256, 4))
    book = Codebook(entries, 100_000)
    walked = []
    inner = book._walked
    book._walked = lambda left, at, stretch, *rest: walked.append(len(left)) or inner(left, at, stretch, *rest)
    queries = entries + rng.integers(-3, 4, entries.shape)
    code, distance = book.nearest(queries)
    assert (code.tolist(), distance.tolist()) == brute_nearest(entries, queries)
    assert sum(walked) < 6 * len(queries)


def test_query_equals_sql(spark, sf_dir, duck):
    assert compare.differences(QUERIES["op11_vector_codes"](spark, sf_dir), duck, ORACLES["op11_vector_codes"]) == []


def brute_compressed(rows, parts=4, rounds=4):
    """(vec_id, code, error, label) of rows (vec_id, vector, label), and the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    whole = np.floor(np.array([r[1] for r in kept]) * 1024).astype(np.int64)
    pieces = [whole[:, width * p // parts : width * (p + 1) // parts] for p in range(parts)]
    books = [piece[:256].copy() for piece in pieces]
    for step in range(rounds + 1):
        codes = [brute_nearest(b, x) for b, x in zip(books, pieces)]
        if step < rounds:
            for book, piece, (code, _) in zip(books, pieces, codes):
                for k in set(code):
                    own = piece[[c == k for c in code]]
                    book[k] = own.sum(axis=0) // len(own)
    out = []
    for n, (vec_id, _, label) in enumerate(kept):
        out.append((vec_id, "".join(f"{c[0][n]:02x}" for c in codes), sum(int(c[1][n]) for c in codes), label))
    return out, books


def test_edge_cases_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(size=9)], int(i) % 3 or None) for i in range(330)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[8][1], 2), (400, None, 1), (401, [1.0, None] + [0.0] * 7, 1)]
    rows += [(402, [float("nan")] + [0.0] * 8, 1), (403, [float("inf")] * 9, None), (404, [-0.5] * 9, 2), (405, [7e5] * 9, 2)]
    docs = spark.createDataFrame(
        [(*r, "s", 1, 2, "t") for r in rows], "vec_id bigint, embedding array<float>, label int, row string, vector int, error int, n string"
    ).repartition(3)
    got, books = vectors.compressed(docs)
    assert got.columns == ["vec_id", "embedding", "label", "row", "vector", "n", "code", "error", "label_error"]
    found = got.collect()
    expected, brute_books = brute_compressed(rows)
    assert all((a == b).all() for a, b in zip(books, brute_books))
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        assert r.label_error == sum(e for _, _, e, label in expected if label == r.label)


def test_empty_other_lengths_and_large_numbers(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows, books = vectors.compressed(spark.createDataFrame([], schema))
    assert rows.count() == 0 and books == []
    rows, _ = vectors.compressed(spark.createDataFrame([(1, None, 1), (2, [None], 1)], schema))
    assert rows.count() == 0
    data = [(1, [1.0] * 4, 1), (2, [1.0] * 5, 1), (3, [], 1), (4, [2.0] * 4, None)]
    rows, books = vectors.compressed(spark.createDataFrame(data, schema))
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in rows.collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: ("01010101", 0, 0)}
    data = [(i, [3e6 * i, -1.0], i % 2) for i in range(9)]
    rows, books = vectors.compressed(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int"))
    assert {(r.vec_id, r.error) for r in rows.collect()} == {(i, 0) for i in range(9)}
    assert len(vectors.digest(books)) == 64
