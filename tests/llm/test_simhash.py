"""SimHash against brute force."""

import duckdb
import numpy as np
import xxhash

from plaintide.llm import simhash
from plaintide.llm.queries import QUERIES


def brute_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(prints, np.uint64)
    for k, p in enumerate(array):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ p) <= radius):
            a, b = find(ids[k]), find(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(texts, similarity=0.8, words=5):
    """Components of documents whose sets of shingles have the similarity (Jaccard), all pairs compared."""
    sets = {}
    for i, t in texts.items():
        tokens = (t or "").encode().lower().split()
        sets[i] = {b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small < similarity * large:
                continue
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common >= similarity * (small + large - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_similar_documents(spark):
    """Near copies of a similarity well above the threshold are found, other texts left alone."""
    rng = np.random.default_rng(8)
    rows, j = [], 0
    for group in range(60):
        words = [f"w{v}" for v in rng.integers(0, 5000, 300)]
        for _ in range(1 + group % 3):
            copy = list(words)
            for at in rng.integers(0, 300, 1 + group % 2):
                copy[at] = f"n{j}"
                j += 1
            rows.append((len(rows), " ".join(copy), group))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == similar({i: t for i, t, _ in rows})
    first = {}
    for i, _, group in rows:
        first.setdefault(group, i)
    assert got == {i: first[g] for i, _, g in rows}


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    roots = brute_components(list(prints), list(prints.values()))
    got = QUERIES["op10_simhash"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [
        (i, f"{p:016x}", roots[i]) for i, p in prints.items()
    ]


def _around(rng, centres, n, flips):
    out = []
    for _ in range(n):
        p = int(centres[rng.integers(len(centres))])
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            p ^= 1 << int(b)
        out.append(p)
    return out


def test_links_and_components_of_crowded_buckets(spark):
    """Chunks of 16 rows: crowded buckets are cut into many units and lose nothing."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6, np.uint64)
    prints = sorted(set(_around(rng, centres, 700, 9)))
    rng.shuffle(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    vertices = spark.createDataFrame(list(enumerate(signed)), "id bigint, fp bigint")
    links = simhash.links(vertices, chunk=16)
    roots = {r.id: r.root for r in simhash.components(links).collect()}
    expected = brute_components(range(len(prints)), prints)
    assert {i: roots.get(i, i) for i in expected} == expected


def test_components_of_a_long_path(spark):
    order = list(range(200))
    np.random.default_rng(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(150)], "a bigint, b bigint")
    roots = {r.id: r.root for r in simhash.components(edges).collect()}
    assert roots == {v: min(order[:151]) for v in order[:151]}


def test_edge_cases(spark):
    long = "word " * 40_000 + "end"
    rows = [(1, None, 0), (2, "", 1), (3, " \t", 2), (4, "A b", 3), (5, "a B", 4), (None, "a b", 5), (6, long, 6), (6, long, 6), (None, "other text that is alone here", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    expected = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (6, 6), (None, 4), (None, None)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect())
    assert kept == [0, 1, 4, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_similar_documents_are_those_of_brute_force_jaccard(spark):
    """Near copies from 0.80 on are found, clean pairs at 0.7 and below stay apart, short and repeating texts too."""
    rng = np.random.default_rng(17)
    rows, truth = [], []
    for group in range(240):
        n = int(rng.integers(12, 30) if group % 6 == 0 else rng.integers(150, 400))
        words = [f"w{v}" for v in rng.integers(0, 50_000, n)]
        # The copy ends in other words: of n + x - 4 shingles each, n - 4 are common.
        share = (0.8, 0.83, 0.88, 0.92, 0.7, 0.6)[group // 6 % 6]
        x = (n - 4) * (1 - share) / (2 * share)
        x = int(x) if share >= 0.8 else int(np.ceil(x))
        for side in "ab":
            rows.append((len(rows), " ".join([*words, *[f"{side}{group}x{i}" for i in range(x)]])))
        truth.append(share >= 0.8)
    words = [f"r{v}" for v in range(100)]
    rows += [(480, " ".join(words)), (481, " ".join(words + words[-6:] * 200)), (482, " ".join(["z"] * 500 + words[:20])), (483, " ".join(["z"] * 500 + words[30:50]))]
    truth += [True, False]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert truth == [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 if truth[i // 2] else i for i, _ in rows}
    assert simhash.candidate_radius(0.8) == 20
