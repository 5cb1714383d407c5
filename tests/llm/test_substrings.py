"""Substring dedup against brute force, and the parse it rests on."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from plaintide.llm import substrings
from plaintide.llm.queries import QUERIES
from plaintide.llm.recompress import recompress


def brute(rows, window=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert got(QUERIES["op7_substring_dedup"](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("letters", [2, 3, 30])
def test_random_texts_of_few_words(spark, letters):
    """Few words and short windows: runs, periods and overlapping repeats everywhere."""
    rng = np.random.default_rng(letters)
    blocks = [rng.integers(0, letters, rng.integers(3, 40)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [blocks[rng.integers(12)] if rng.random() < 0.4 else rng.integers(0, letters, rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        rows.append((i, " ".join(f"w{v}" for v in np.concatenate(parts))))
    rows += [(900, "a " * 500), (901, "a " * 30 + "b"), (902, "a b " * 200), (903, "b a " * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window in (7, 16):
        assert got(substrings.dedup_substrings(docs, window, rounds=3)) == brute(rows, window)


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [
        (1, None, 0), (2, "", 0), (3, " \t", 0), (4, " ".join(words), 0), (None, "\n".join(words), 0), (5, " ".join(words[:34]), 0),
        (6, "x " * 60_000 + " ".join(words[10:60]), 0), (7, "same text here", 0), (7, "same text here", 0), (8, " ".join("é " + w for w in words), 0),
        (9, " ".join("é " + w for w in words), 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k1 int")
    result = substrings.dedup_substrings(docs)
    assert got(result) == brute([r[:2] for r in rows])
    assert {r.kept_text for r in result.where("doc_id = 5").collect()} == {" ".join(words[:34])}
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_names_do_not_depend_on_what_surrounds_them():
    rng = np.random.default_rng(1)
    for _ in range(60):
        inner = rng.integers(0, 4, 80).astype(np.uint64)
        seen = []
        for _ in range(2):
            left, right = (rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
            all_ = np.concatenate((left, inner, right))
            name, start, low, high = recompress(all_, np.zeros(len(all_), np.int64), 4)
            a, b = len(left), len(left) + len(inner)
            held = (low >= a) & (high <= b) & (low >= 0) & (high <= len(all_))
            seen.append({(int(s - a), int(n)) for s, n in zip(start[held], name[held])})
        assert seen[0] == seen[1] and seen[0]
