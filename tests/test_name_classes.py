"""Names compared by classes: the same results as all pairs, and no more work where numbers multiply the names."""

import random

import pytest
import test_matching as all_pairs
from pyspark.sql import functions as F

from plaintide.functions import names
from plaintide.operators import name_join
from plaintide.operators.similarity import block_edits, class_bound, common_subsequence, token_set_score
from plaintide.plans import entities

WORDS = ["RED", "BLUE", "OLD", "RING", "BOLT", "NATION", "BANK", "NATIONAL", "ASSOCIATION", "TRUST"]


def _names(seed, count):
    rng = random.Random(seed)

    def word():
        kind = rng.random()
        if kind < 0.2:
            return f"K{rng.randint(0, 30):04d}"
        if kind < 0.3:
            return str(rng.randint(0, 120))
        if kind < 0.4:
            return "".join(rng.choices("ABDENO7", k=rng.randint(1, 8)))
        return rng.choice(WORDS)

    return sorted({" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(count)})


@pytest.mark.parametrize("rare", [0, 3])
def test_similar_names_by_classes_equal_all_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(name_join, "RARE", rare)
    left, right = _names(1, 150), _names(2, 150)
    frames = [spark.createDataFrame([(n,) for n in side], "name string") for side in (left, right)]
    got = sorted(tuple(r) for r in name_join.similar_names(*frames, 75.0).collect())
    scores = [(a, b, token_set_score(a, b)) for a in left for b in right]
    assert got == sorted(s for s in scores if s[2] >= 75.0)
    assert len(got) > 1000


@pytest.mark.parametrize("rare", [0, 3])
def test_labels_by_classes_equal_those_of_all_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(name_join, "RARE", rare)
    companies, candidates = _names(3, 150), _names(4, 150)
    feed = spark.createDataFrame([(c, str(i), "1000", "TX", None) for i, c in enumerate(candidates)], all_pairs.FEED)
    every = sorted({*companies, *candidates})
    normal = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in every], "c string").select("c", names.match_name(F.col("c"))).collect()}
    kept = {normal[c] for c in candidates if len(normal[c]) > 2}
    left = spark.createDataFrame([(c, 1) for c in companies], "company string, n_complaints bigint")
    rows = entities.resolve(left, feed).collect()
    expected = all_pairs._labelled({normal[c] for c in companies}, kept)
    got = {r["company"]: (r["match_method"], r["match_score"]) for r in rows}
    assert {c: got[c] for c in companies if normal[c]} == {c: expected[normal[c]] for c in companies if normal[c]}
    lean = {r["company"]: r["group_key"] for r in entities.resolve(left, feed, near_misses=False).where("matched").collect()}
    assert lean == {r["company"]: r["group_key"] for r in rows if r["matched"]}


def test_numbered_names_add_no_class(spark):
    """Four times the names: the same classes are compared, and pairs by rare words grow as the names do."""

    def counts(n):
        left = [f"RED RING K{i:06d} BANK" for i in range(n)]
        right = [f"RED RING NATION {i % 3} K{i:06d} BANK NATIONAL ASSOCIATION" for i in range(n)]
        frames = [spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right)]
        coded = name_join.coded(*frames)
        classes = [name_join.classes_of(side) for side in coded]
        return name_join.rare_pairs(*coded).count(), [c.count() for c in classes], entities._class_pairs(*classes, True).count()

    assert counts(200) == (200, [1, 3], 3)
    assert counts(800) == (800, [1, 3], 3)


def test_bound_of_classes_holds_for_every_pair_of_their_names():
    rng = random.Random(7)
    fixed = ["RED", "RING", "3", "47", "BANK"]

    def word():
        return rng.choice([f"K{rng.randint(0, 99):02d}", str(rng.randint(0, 99)), f"{rng.randint(0, 9)}Z", "ELM", "K7X"])

    def name():
        return sorted({*rng.sample(fixed, rng.randint(0, 3)), *(word() for _ in range(rng.randint(0, 2)))} or {"ELM"})

    def shaped(words):
        rest = ["".join("0" if c.isdigit() else c for c in w) for w in words if w not in fixed]
        return [w for w in words if w in fixed], rest

    tight = 0
    for _ in range(20000):
        left, right = name(), name()
        if (set(left) & set(right)) - set(fixed):
            continue
        rests = [" ".join(w for w in side if w not in (set(left) & set(right))) for side in (left, right)]
        if not all(rests):
            continue
        kept = all_pairs_kept(*rests)
        total = len(" ".join(left)) + len(" ".join(right))
        edited = 100.0 - 100.0 * (len(rests[0]) + len(rests[1]) - 2 * kept) / total
        bound = class_bound(*shaped(left), *shaped(right))
        assert bound >= edited - 1e-9, (left, right)
        tight += bound == edited
    assert tight > 2000
    # Two numbers of one shape differ in a digit, and so do the numbers beside them.
    words = ["BANK", "NATION", "RED", "RING"]
    assert class_bound([*words, "1"], ["K000000"], [*words, "1"], ["K000000"]) == 100.0 - 100.0 * 2 / 60
    assert class_bound([*words, "1"], ["K000000"], [*words, "2"], ["K000000"]) == 100.0 - 100.0 * 4 / 60


def all_pairs_kept(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        before = row
        row = [0]
        for j, b in enumerate(right):
            row.append(before[j] + 1 if a == b else max(before[j + 1], row[-1]))
    return row[-1]


@pytest.mark.parametrize("near_misses", [True, False])
def test_members_of_classes_that_cannot_win_are_not_paired(spark, monkeypatch, near_misses):
    """A company without a charter of its own meets the members of one class, not those of all with the same overlap."""
    monkeypatch.setattr(name_join, "RARE", 3)
    paired, members = [], name_join.members

    def counted(*sides):
        pairs = members(*sides)
        paired.append(pairs.count())
        return pairs

    monkeypatch.setattr(name_join, "members", counted)
    charters = [(f"Red Ring Nation {n} K{i:06d} Bank", f"{n}{i:06d}", "1000", "TX", None) for n in range(1, 7) for i in range(n, 240, 6)]
    companies = [(f"Red & Ring Nation {n} K{900000 + i:06d} Bank", 1) for n in (1, 2) for i in range(n, 60, 6)]
    # No number is right; it is not accepted, whatever the class.
    companies += [(f"K{700000 + i:06d} Ring Red Nation Financial Group", 1) for i in range(20)]
    left = spark.createDataFrame(companies, "company string, n_complaints bigint")
    rows = entities.resolve(left, spark.createDataFrame(charters, all_pairs.FEED), near_misses=near_misses).collect()
    every = {c: c.replace("&", "AND").upper().replace(" AND ", " ") for c, _ in companies}
    expected = all_pairs._labelled(set(every.values()), {c[0].upper() for c in charters})
    matched = {r["company"] for r in rows if r["matched"]}
    assert matched == {c for c, norm in every.items() if expected[norm][0] == "fuzzy_auto"} and len(matched) == 20
    if near_misses:
        assert {r["company"]: r["match_score"] for r in rows} == {c: expected[norm][1] for c, norm in every.items()}
    else:
        assert sum(paired) <= 20 * 40


@pytest.mark.parametrize("letters", [3, 20])
def test_edits_of_blocks_equal_those_of_each_pair(letters):
    """Short names, names of more letters than a machine word has, and letters beyond ASCII."""
    rng = random.Random(letters)
    words = ["".join(rng.choices("ABC19", k=rng.randint(1, letters))) for _ in range(12)] + ["\u00c9T\u00c9"] * (letters == 3)
    common = words[:3]
    for _ in range(60):
        lefts, rights = ([" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(n)] for n in (4, 7))
        got = block_edits(lefts, rights, common)
        for r, right in enumerate(rights):
            for l, left in enumerate(lefts):
                a, b = (" ".join(sorted(set(x.split()) - set(common))) for x in (left, right))
                assert got[r, l] == len(a) + len(b) - 2 * common_subsequence(a, b), (a, b)


@pytest.mark.parametrize("floor", [75.0, 88.0])
def test_names_compared_in_small_blocks_equal_all_pairs(spark, monkeypatch, floor):
    monkeypatch.setattr(name_join, "RARE", 2)
    monkeypatch.setattr(name_join, "BLOCKS", (2, 3))
    left, right = _names(5, 120), _names(6, 120)
    frames = [spark.createDataFrame([(n,) for n in side], "name string") for side in (left, right)]
    got = sorted(tuple(r) for r in name_join.similar_names(*frames, floor).collect())
    assert got == sorted((a, b, token_set_score(a, b)) for a in left for b in right if token_set_score(a, b) >= floor)


def test_near_misses_are_not_moved_once_paired(spark):
    """The review list has as many rows as pairs reach the floor: nothing is joined or shuffled after they are made."""
    charters = [(f"Red Ring Nation {i % 3} K{i:06d} Bank", f"{i}", "1000", "TX", None) for i in range(120)]
    companies = [(c, 1) for i in range(900, 940) for c in (f"Red & Ring Nation 1 K{i:06d} Bank", f"The Red Ring Nation 1 K{i:06d} Bank")]
    left = spark.createDataFrame(companies, "company string, n_complaints bigint")
    rows = entities.near_misses(left, spark.createDataFrame(charters, all_pairs.FEED))
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(lines) if "Generate posexplode" in line)
    assert not any("Join" in line or "Repartition" in line for line in lines[:made])
    got = {(r["company"], r["candidate"]): r["score"] for r in rows.collect()}
    names_of = {c: c.replace(" & ", " ").removeprefix("The ").upper() for c, _ in companies}
    scores = {(c, n[0].upper()): token_set_score(norm, n[0].upper()) for c, norm in names_of.items() for n in charters}
    assert got == {pair: pytest.approx(score, abs=0.051) for pair, score in scores.items() if score >= 75.0} and len(got) > 3000
