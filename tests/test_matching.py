"""Institution match: documented cases, completeness of the blocking, roll-up."""

import random

import pytest
from pyspark.sql import functions as F

from plaintide.functions import names
from plaintide.operators.name_join import similar_names
from plaintide.operators.similarity import token_set_score
from plaintide.plans import entities

FEED = "NAME string, CERT string, ASSET string, STALP string, NAMEHCR string"
CHARTERS = [
    ("Fifth Third Bank, National Association", "1", "200000000", "OH", "FIFTH THIRD BCORP"),
    ("Pathward, National Association", "2", "7000000", "SD", "PATHWARD FINANCIAL INC"),
    ("Owen Savings Bank", "3", "400000", "LA", "OWEN FINANCIAL CORP"),
    ("Farmers and Mechanics Federal Savings", "4", "500000", "IN", None),
    ("Paramount Bank", "5", "600000", "MO", "PARAMOUNT FINANCIAL GROUP"),
    ("Bank of America, National Association", "6", "2500000000", "NC", "BANK OF AMERICA CORP"),
    ("PNC Bank, National Association", "7", "550000000", "DE", "PNC FINANCIAL SERVICES GROUP"),
    ("Citibank, National Association", "8", "1700000000", "SD", "CITIGROUP INC"),
    ("Lone Star State Bank", "9", "100000", "TX", " "),
    ("Prairie State Bank", "10", "bad", "KS", ""),
]
EXPECTED = {
    "FIFTH THIRD FINANCIAL": ("token_set_identical", "FIFTH THIRD BCORP"),
    "Ocwen Mortgage Corporation": (None, None),
    "OCWEN FINANCIAL CORPORATION": ("known_non_bank", None),
    "MECHANICS BANK": (None, None),
    "Paramount GR Holdings": (None, None),
    "BANK OF AMERICA NATIONAL ASSOCIATION": ("exact_normalised", "BANK OF AMERICA CORP"),
    "PNC Bank N.A.": ("exact_normalised", "PNC FINANCIAL SERVICES GROUP"),
    "CITIBANK, N.A.": ("manual_override", "CITIGROUP INC"),
    "Some Federal Credit Union": ("ncua_credit_union", None),
    "Comerica": ("inactive_charter", None),
    "BLOCKFI LENDING": ("no_match", None),
    "BLOCK, INC.": ("known_non_bank", None),
}


@pytest.fixture(scope="module")
def charters(spark):
    return spark.createDataFrame(CHARTERS, FEED)


def test_documented_pairs(spark, charters):
    companies = spark.createDataFrame([(n, 10) for n in EXPECTED], "company string, n_complaints bigint")
    got = {r["company"]: r for r in entities.resolve(companies, charters).collect()}
    assert set(got) == set(EXPECTED)
    for name, (method, group) in EXPECTED.items():
        row = got[name]
        assert row["group_key"] == group, row
        assert row["matched"] is (group is not None)
        if method:
            assert row["match_method"] == method, row


def test_holding_groups(charters):
    got = {r["group_key"]: r for r in entities.holding_groups(charters).collect()}
    assert {"CERT:4", "CERT:9", "CERT:10"} <= set(got)
    assert got["CERT:9"]["group_name"] == "Lone Star State Bank" and not got["CERT:9"]["has_holding_company"]
    assert got["CERT:10"]["total_assets_k"] == 0 and got["CERT:10"]["assets_understated_pct"] is None


def test_assets_are_summed_over_charters(spark):
    feed = spark.createDataFrame(
        [("Small Bank", "1", "100", "TX", "PARENT"), ("Large Bank", "2", "300", "NY", "PARENT ")], FEED
    )
    row = entities.holding_groups(feed).first()
    assert (row["total_assets_k"], row["n_charters"], row["largest_charter"], row["state"]) == (400, 2, "Large Bank", "NY")
    assert row["assets_understated_pct"] == 25.0


def test_first_candidate_wins(spark):
    feed = spark.createDataFrame(
        [("Alpha Bank", "9", "1", "TX", None), ("Alpha Bank", "10", "5", "TX", None), ("Beta", "3", "20", "TX", "ALPHA BANK")],
        FEED,
    )
    got = {r["norm"]: r for r in entities.match_candidates(feed, entities.holding_groups(feed)).collect()}
    assert (got["ALPHA BANK"]["group_key"], got["ALPHA BANK"]["source"]) == ("ALPHA BANK", "holding_company")


def _brute(companies, candidates):
    """Best candidate over all pairs, then the acceptance rules."""
    out = {}
    for name in companies:
        mine = {w for w in name.split() if len(w) >= 3 and w not in names.GENERIC_TOKENS}
        scored = []
        for cand in candidates:
            theirs = {w for w in cand.split() if len(w) >= 3 and w not in names.GENERIC_TOKENS}
            if mine & theirs:
                overlap = len(mine & theirs) / len(mine | theirs)
                scored.append((-(name == cand), -overlap, -token_set_score(name, cand), cand, theirs))
        if not scored:
            continue
        exact, overlap, score, cand, theirs = min(scored, key=lambda s: s[:4])
        same = len(mine) >= 2 and mine == theirs
        fuzzy = -score >= 92 and len(mine & theirs) >= 2 and -overlap >= 0.6
        if exact or same or fuzzy:
            out[name] = cand
    return out


def test_blocking_finds_every_acceptable_pair(spark):
    """Against all pairs, over few words that nearly every name carries."""
    rng = random.Random(19)
    words = ["ALDER", "BIRCH", "CEDAR", "DOGWOOD", "ELM1", "FIRS", "GINKGO"]
    rare = [f"RARE{i}" for i in range(40)]
    generic = ["BANK", "TRUST", "GROUP", "SAVINGS"]

    def name():
        picked = rng.sample(words, rng.randint(1, 4)) + rng.sample(rare, rng.randint(0, 1))
        picked += rng.sample(generic, rng.randint(0, 2))
        rng.shuffle(picked)
        return " ".join(picked)

    companies = sorted({name() for _ in range(80)})
    candidates = sorted({name() for _ in range(120)})
    feed = spark.createDataFrame([(c, str(i), "1000", "TX", None) for i, c in enumerate(candidates)], FEED)
    left = spark.createDataFrame([(c, 1) for c in companies], "company string, n_complaints bigint")
    key = {f"CERT:{i}": c for i, c in enumerate(candidates)}
    got = {r["company"]: key[r["group_key"]] for r in entities.resolve(left, feed).where("matched").collect()}
    assert got == _brute(companies, candidates)
    assert len(got) > 10


def test_labels_do_not_depend_on_other_candidates(spark):
    """A thousand candidates that share one word with a company change no label."""
    feed = [("Prairie Alpha Beta Bank", "1", "1000", "TX", None), ("Delta Gamma Omega Bank", "2", "1000", "TX", None)]
    crowd = [(f"Prairie Crowd{i} Bank", str(i + 10), "1000", "TX", None) for i in range(1000)]
    rows = [("Prairie Alpha Quartet Unit", 1), ("Delta Gamma Omegas", 1), ("Delta Lenders Quartet", 1), ("Unheard Of", 1)]
    left = spark.createDataFrame(rows, "company string, n_complaints bigint")

    def labels(charters):
        matches = entities.resolve(left, spark.createDataFrame(charters, FEED))
        return {r["company"]: (r["match_method"], r["match_score"], r["match_note"]) for r in matches.collect()}

    alone = labels(feed)
    assert labels(feed + crowd) == alone
    assert alone["Delta Gamma Omegas"][0] == "below_threshold"
    assert alone["Delta Lenders Quartet"][0] == "no_match" and alone["Unheard Of"][0] == "no_match"


def _labelled(companies, candidates):
    """Label of each company over all pairs: the highest overlap of those that reach the floor or have equal tokens."""

    def tokens(name):
        return {w for w in name.split() if len(w) >= 3 and w not in names.GENERIC_TOKENS}

    out = {}
    for name in companies:
        mine, pool = tokens(name), []
        for cand in candidates:
            theirs = tokens(cand)
            score = token_set_score(name, cand)
            same = len(mine) >= 2 and mine == theirs
            if score >= 75 or same:
                overlap = len(mine & theirs) / len(mine | theirs) if mine | theirs else 0.0
                pool.append((-overlap, -score, cand, same, len(mine & theirs)))
        if name in candidates:
            out[name] = ("exact_normalised", 100.0)
            continue
        if not pool:
            out[name] = ("no_match", None)
            continue
        overlap, score, cand, same, shared = min(pool)
        label = "below_threshold"
        if same:
            label = "token_set_identical"
        elif -score >= 92 and shared >= 2 and -overlap >= 0.6:
            label = "fuzzy_auto"
        elif -score >= 92:
            label = "rejected_weak_token_overlap" if shared else "rejected_no_shared_token"
        out[name] = (label, round(-score + 1e-9, 1))
    return out


def test_labels_equal_those_of_all_pairs(spark):
    """Misspelt, cut, extended and reordered names, and names of common words alone."""
    rng = random.Random(23)
    syllables = ["MAR", "TON", "VEL", "OCW", "EN", "LAK", "ER", "ID", "GRO", "VE", "PINE", "STO", "NE"]
    generic = ["BANK", "TRUST", "GROUP", "SAVINGS", "FINANCIAL", "OF", "FIRST"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 3)))

    def name():
        return " ".join([word() for _ in range(rng.randint(0, 3))] + rng.sample(generic, rng.randint(0, 3))) or "FIRST BANK"

    def spoilt(text):
        letters = list(text)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(letters))
            if rng.random() < 0.5 and len(letters) > 3:
                del letters[at]
            else:
                letters.insert(at, rng.choice("AEIORST"))
        words = "".join(letters).split()
        rng.shuffle(words)
        return " ".join(words)

    candidates = sorted({name() for _ in range(150)})
    companies = sorted({spoilt(rng.choice(candidates)) for _ in range(90)} | {name() for _ in range(60)} | {"OCWEN MORTGAGE", "ALNOCWEN"})
    candidates += ["OWEN MORTGAG", "CWEN ALNO"]
    feed = spark.createDataFrame([(c, str(i), "1000", "TX", None) for i, c in enumerate(candidates)], FEED)
    normal = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in companies + candidates], "c string").select("c", names.match_name(F.col("c"))).collect()}
    kept = {normal[c] for c in candidates if len(normal[c]) > 2}
    left = spark.createDataFrame([(c, 1) for c in companies], "company string, n_complaints bigint")
    got = {r["company"]: (r["match_method"], r["match_score"]) for r in entities.resolve(left, feed).collect()}
    expected = _labelled({normal[c] for c in companies}, kept)
    assert {c: got[c] for c in companies if normal[c]} == {c: expected[normal[c]] for c in companies if normal[c]}
    assert {"fuzzy_auto", "below_threshold", "no_match", "rejected_no_shared_token", "rejected_weak_token_overlap"} <= {v[0] for v in got.values()}
    lean = {r["company"]: r["group_key"] for r in entities.resolve(left, feed, near_misses=False).where("matched").collect()}
    full = {r["company"]: r["group_key"] for r in entities.resolve(left, feed).where("matched").collect()}
    assert lean == full


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("ABCDE", k=rng.randint(1, 9))) for _ in range(40)]

    def name():
        return " ".join(rng.choices(base, k=rng.randint(1, 4)))

    left, right = ({name() for _ in range(120)} for _ in range(2))
    frames = [spark.createDataFrame([(n,) for n in sorted(side)] * 2 + [(None,), (" ",)], "name string") for side in (left, right)]
    for floor in (70.0, 75.0, 90.0):
        got = {(r[0], r[1]) for r in similar_names(*frames, floor).collect()}
        assert got == {(a, b) for a in left for b in right if token_set_score(a, b) >= floor}
    plan = similar_names(*frames, 75.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        similar_names(*frames, 60.0)


def test_no_all_pairs_plan(spark, sf_dir):
    from plaintide.bindings import tables as t

    companies = t.named_companies(spark, sf_dir).withColumn("norm", names.match_name(F.col("company")))
    companies = companies.withColumn("sig", names.significant_tokens(F.col("norm")))
    feed = t.named_institutions(spark, sf_dir)
    candidates = entities.match_candidates(feed, entities.holding_groups(feed)).withColumn(
        "sig", names.significant_tokens(F.col("norm"))
    )
    plan = entities.candidate_pairs(companies, candidates)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
