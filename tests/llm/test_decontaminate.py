"""Decontamination against a brute-force search of all diagonals."""

import math
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from plaintide.llm import decontaminate as dc
from plaintide.llm.queries import QUERIES


def tokens(text):
    return [w for w in (re.sub(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]", "", x) for x in re.split(r"[ \t-\r]+", (text or "").lower())) if w]


def brute(docs, items):
    """Pairs whose longest stretch of at least 80 % equal words, on any diagonal, is long enough."""
    found = set()
    for d, text in docs:
        doc = np.array(tokens(text) or [""])
        for i, item in items:
            item = np.array(tokens(item))
            if not len(item):
                continue
            need = min(13, len(item))
            for shift in range(-len(item) + need, len(doc) - need + 1):
                a, b = max(0, shift), min(len(doc), shift + len(item))
                equal = doc[a:b] == item[a - shift : b - shift]
                if equal.sum() >= 0.8 * need and dc.longest_overlap(equal)[1] >= need:
                    found.add((d, i))
                    break
    return found


def test_query_finds_what_all_diagonals_find(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = QUERIES["op6_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) > 0


def test_longest_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 30)) < 0.7
        best = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8), default=0)
        start, length = dc.longest_overlap(equal)
        assert length <= best + 0 and (length >= best - 1 or best == 0)
        assert not length or equal[start : start + length].mean() >= 0.8 - 1e-6


def test_edge_cases(spark):
    passage = "Alpha beta, gamma delta! epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = passage.split()
    replaced = [w if k % 6 != 3 else "other" for k, w in enumerate(words)]
    items = [(1, passage), (2, None), (3, "too short an item"), (4, "exactly seven words are in this item"), (None, "an item without any id has words to match here as well"), (1, passage)]
    docs = [
        (1, "x y z " * 50 + passage.upper() + " end" * 80), (2, " ".join(replaced)), (3, None), (4, ""), (5, "alpha beta gamma delta unlike words follow on from there on and on"),
        (6, "see: Exactly SEVEN words, are in this item."), (None, passage), (7, "filler " * 60_000 + passage), (1, "clean row of the same id"),
        (8, "an item without any id has words to match here as well"), (9, "too short an item"), (10, " ".join(words[:9] + ["new"] * 9 + words[9:])), (7, "filler " * 60_000 + passage),
    ]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(d, b).collect()}
    assert set(got) == brute([r[:2] for r in docs], items) == {(1, 1), (2, 1), (None, 1), (7, 1), (6, 4), (8, None), (9, 3)}
    assert (got[7, 1].n_words, got[7, 1].doc_start, got[7, 1].item_start) == (20, 60_000, 0)
    kept = sorted(((r.doc_id, (r.text or "")[:5]) for r in dc.decontaminate(d, b).collect()), key=str)
    assert kept == sorted([(3, ""), (4, ""), (5, "alpha"), (1, "clean"), (9, "too s"), (10, "Alpha")], key=str)
    assert dc.contaminated(d.limit(0), b).count() == 0 and dc.contaminated(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("length", range(5, 27))
def test_masks_leave_no_gap(length):
    """All patterns of substitutions that leave four of five words and both ends equal."""
    masks = [sum(1 << at for at in mask) for mask in dc.masks_of(length)]
    for n in range(length - math.ceil(0.8 * length - 1e-9) + 1):
        for others in combinations(range(1, length - 1), n):
            equal = (1 << length) - 1 - sum(1 << at for at in others)
            assert any(equal >> at & mask == mask for mask in masks for at in range(length - mask.bit_length() + 1)), (length, others)


def test_short_items_bear_a_substitution(spark):
    """Items of one to twelve words against all diagonals; those below five words drop no document."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)]
    items, docs = [], []
    for length in range(1, 13):
        item = list(rng.choice(words, length, replace=False))
        items.append((length, " ".join(item)))
        for n in range(length // 5 + 2):
            copy = list(item)
            for at in rng.choice(length, n, replace=False) if n < length else ():
                copy[at] = "other"
            filler = [list(rng.choice(["f", "g", "h"], 9)) for _ in range(2)]
            docs.append((len(docs), " ".join([*filler[0], *copy, *filler[1]])))
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert got == brute(docs, items) and len({i for _, i in got}) == 12
    kept = {r.doc_id for r in dc.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, item in got if item >= 5}
