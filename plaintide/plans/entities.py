"""Companies to institution groups: roll-up, candidates and the rule-checked match.

The match never compares all companies with all candidates. Pairs with a rare word in common are
joined on it. The others have common words alone in common; what they have in common follows from their
classes (``operators.name_join``), and classes are compared instead. An accepted pair has equal normalised
names, or at least two significant tokens in common with a token overlap (Jaccard) of 0.6 or more.
Classes with that overlap are found by a set-similarity join: tokens are ordered from rare to common, and two
sets with that overlap must share a token within a short prefix of that order.

The review band is complete too: every pair whose character score reaches the review floor is considered,
whatever its tokens. Of the candidates with that score, or with the same significant tokens, the one
with the highest overlap decides, then the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions import names
from plaintide.functions.numbers import number_or_zero, percent_of, rounded
from plaintide.functions.taxonomy import looked_up
from plaintide.operators import name_join
from plaintide.operators.similarity import pair_score
from plaintide.session import settle

AUTO_ACCEPT = 92.0
REVIEW_FLOOR = 75.0
MIN_JACCARD = 0.6
MIN_SHARED = 2
# A token of the candidates is repeated this often, so that the companies that
# carry a frequent one spread over as many tasks.
TOKEN_SALTS = 8
IMPLAUSIBLE_PER_BILLION = 300

# Curated company -> exact charter name.
OVERRIDES = {
    "CITIBANK, N.A.": "Citibank, National Association",
    "GOLDMAN SACHS BANK USA": "Goldman Sachs Bank USA",
    "TD BANK US HOLDING COMPANY": "TD Bank, National Association",
    "SANTANDER HOLDINGS USA, INC.": "Santander Bank, N.A.",
    "BMO HARRIS BANK N.A.": "BMO Bank National Association",
    "BARCLAYS BANK DELAWARE": "Barclays Bank Delaware",
    "AMERICAN EXPRESS COMPANY": "American Express National  Bank",
    "SYNCHRONY FINANCIAL": "Synchrony Bank",
    "FIFTH THIRD FINANCIAL CORPORATION": "Fifth Third Bank, National Association",
}
# Companies whose charter lapsed, with the reason reported.
INACTIVE_CHARTERS = {
    "DISCOVER BANK": "merged into another bank in May 2025; no active charter",
    "BANK OF THE WEST": "acquired in February 2023; the remaining shell is no denominator",
    "COMERICA": "no active charter in the current register",
}
# Normalised name starts of companies without a bank charter.
NON_BANKS = {
    "EQUIFAX": "credit reporting agency",
    "TRANSUNION INTERMEDIATE": "credit reporting agency",
    "EXPERIAN INFORMATION SOLUTIONS": "credit reporting agency",
    "MOHELA": "student loan servicer without charter",
    "NELNET": "student loan servicer without charter",
    "NAVIENT SOLUTIONS": "student loan servicer without charter",
    "MAXIMUS FEDERAL SERVICES": "federal loan servicer without charter",
    "CHIME FINANCIAL": "deposits held at partner banks",
    "BLOCK": "payments company without charter",
    "PAYPAL HOLDINGS": "payments company without charter",
    "SHELLPOINT PARTNERS": "mortgage servicer without charter",
    "MR COOPER": "mortgage servicer without charter",
    "OCWEN FINANCIAL": "mortgage servicer without charter",
    "BREAD FINANCIAL": "card issuer through a partner bank",
    "BMW FINANCIAL SERVICES": "captive auto lender without charter",
}


def _parent() -> Column:
    return F.trim(F.coalesce(F.col("NAMEHCR"), F.lit("")))


def _group_key() -> Column:
    """Parent name, or a key of its own for a charter without a parent."""
    return F.when(_parent() != "", _parent()).otherwise(F.concat(F.lit("CERT:"), F.col("CERT")))


def holding_groups(institutions: DataFrame) -> DataFrame:
    """One row per holding group with assets summed over all its charters.

    Amounts are exact decimals, so the sums do not depend on task order.
    """
    charters = institutions.select(
        _group_key().alias("group_key"),
        F.when(_parent() != "", _parent()).otherwise(F.col("NAME")).alias("_name"),
        (_parent() != "").alias("_has_parent"),
        number_or_zero(F.col("ASSET")).alias("_asset"),
        "NAME",
        "CERT",
        "STALP",
    )
    largest = F.min_by(
        F.struct("_name", "NAME", "CERT", "STALP", "_asset", "_has_parent"),
        F.struct(-F.col("_asset"), F.col("CERT")),
    )
    grouped = charters.groupBy("group_key").agg(
        F.sum("_asset").cast("decimal(20,2)").alias("total_assets_k"),
        F.count("CERT").alias("n_charters"),
        largest.alias("_top"),
    )
    share = F.try_divide(F.col("_top._asset").cast("double"), F.col("total_assets_k").cast("double"))
    return grouped.select(
        "group_key",
        F.col("_top._name").alias("group_name"),
        "total_assets_k",
        "n_charters",
        F.col("_top.NAME").alias("largest_charter"),
        F.col("_top._asset").alias("largest_charter_assets_k"),
        F.col("_top.CERT").alias("primary_cert"),
        F.col("_top.STALP").alias("state"),
        F.col("_top._has_parent").alias("has_holding_company"),
        rounded(F.col("total_assets_k").cast("double") / 1e6, 3).alias("total_assets_b"),
        F.when(F.col("total_assets_k") > 0, rounded(100.0 * (1.0 - share), 2)).alias(
            "assets_understated_pct"
        ),
    )


def match_candidates(institutions: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct normalised group and charter names, each with the group it stands for.

    A name used twice belongs to the holding name first, the larger one first;
    then to the charter with the lowest number.
    """
    by_group = groups.select(
        names.match_name(F.col("group_name")).alias("norm"),
        "group_key",
        F.lit("holding_company").alias("source"),
        F.struct(
            F.lit(0).alias("s"),
            (-F.col("total_assets_k")).alias("a"),
            F.lit(0).cast("long").alias("c"),
            F.col("group_key").alias("g"),
        ).alias("_place"),
    )
    by_charter = institutions.select(
        names.match_name(F.col("NAME")).alias("norm"),
        _group_key().alias("group_key"),
        F.lit("charter").alias("source"),
        F.struct(
            F.lit(1).alias("s"),
            F.lit(0).cast("decimal(20,2)").alias("a"),
            F.col("CERT").try_cast("long").alias("c"),
            _group_key().alias("g"),
        ).alias("_place"),
    )
    return (
        by_group.unionByName(by_charter)
        .where(F.length("norm") > 2)
        .groupBy("norm")
        .agg(F.min_by(F.struct("group_key", "source"), F.col("_place")).alias("_first"))
        .select("norm", "_first.group_key", "_first.source")
    )


def declared_class(company: Column, normal: Column) -> Column:
    """(method, note) of a company the rules exclude from matching, else null."""

    def verdict(method: str, note: Column) -> Column:
        return F.when(
            note.isNotNull(), F.struct(F.lit(method).alias("method"), note.alias("note"))
        )

    start = F.regexp_extract(normal, f"^({'|'.join(NON_BANKS)})( |$)", 1)
    starts = looked_up(start, NON_BANKS)
    union = F.when(names.is_credit_union(company), F.lit("credit union, insured elsewhere"))
    return F.coalesce(
        verdict("known_non_bank", starts),
        verdict("inactive_charter", looked_up(F.upper(company), INACTIVE_CHARTERS)),
        verdict("ncua_credit_union", union),
    )


def _override_groups(institutions: DataFrame) -> DataFrame:
    """Group of each charter that an override names (at most one row per override)."""
    wanted = institutions.where(F.trim("NAME").isin(list(OVERRIDES.values())))
    return wanted.groupBy(F.trim("NAME").alias("_target")).agg(
        F.max_by(_group_key(), F.col("CERT").try_cast("long")).alias("_override_group")
    )


def _by_rarity(df: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
    """The tokens of each row that are join keys: those of its prefix, from rare to common."""
    tokens = df.select(key, F.explode("sig").alias("token")).join(frequency, "token", "left")
    carried = F.coalesce(F.col("df"), F.lit(0).cast("long"))
    ordered = tokens.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(carried.alias("df"), F.col("token")))).alias("_tokens")
    )
    size = F.size("_tokens")
    prefix = size - F.ceil(size * F.lit(MIN_JACCARD)).cast("int") + 1
    placed = ordered.select(key, prefix.alias("_prefix"), F.posexplode("_tokens").alias("_at", "_t"))
    return placed.where((F.col("_at") < F.col("_prefix")) & (F.col("_t.df") > 0)).select(key, "_t.token")


def candidate_pairs(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs worth scoring: (company, norm, sig) x (cand_norm, cand_sig) with their overlap.

    Complete for every pair with ``MIN_JACCARD`` overlap, which accepted ones have, and holds no other.
    """
    frequency = candidates.select(F.explode("sig").alias("token")).groupBy("token").agg(
        F.count("*").alias("df")
    )
    salt = F.pmod(F.xxhash64("company"), F.lit(TOKEN_SALTS)).cast("int")
    left = _by_rarity(companies, "company", frequency).withColumn("salt", salt)
    right = _by_rarity(candidates, "norm", frequency).select(
        "token", F.col("norm").alias("cand_norm"), F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALTS - 1))).alias("salt")
    )
    keys = left.join(right, ["token", "salt"]).select("company", "cand_norm").distinct()
    return (
        keys.join(companies.select("company", "norm", "sig"), "company")
        .join(
            candidates.select(
                F.col("norm").alias("cand_norm"), F.col("sig").alias("cand_sig"), "group_key"
            ),
            "cand_norm",
        )
        .withColumn("shared", names.shared_count(F.col("sig"), F.col("cand_sig")))
        .withColumn("jaccard", names.jaccard(F.col("sig"), F.col("cand_sig")))
        .where(F.col("jaccard") >= MIN_JACCARD)
    )


def _verdict() -> Column:
    """Method of a company whose best candidate is known."""
    fuzzy = _accepted(F.col("best.score"), F.col("best.shared"), F.col("best.jaccard"))
    return (
        F.when(F.col("norm").isin("") | F.col("norm").isNull(), "no_candidate")
        .when(F.col("best").isNull(), "no_match")
        .when(_same_tokens(F.col("sig"), F.col("best.cand_sig")), "token_set_identical")
        .when(fuzzy, "fuzzy_auto")
        .when((F.col("best.score") >= AUTO_ACCEPT) & (F.col("best.shared") > 0), "rejected_weak_token_overlap")
        .when(F.col("best.score") >= AUTO_ACCEPT, "rejected_no_shared_token")
        .otherwise("below_threshold")
    )


def _accepted(score: Column, shared: Column, jaccard: Column) -> Column:
    return (score >= AUTO_ACCEPT) & (shared >= MIN_SHARED) & (jaccard >= MIN_JACCARD)


def _same_tokens(sig: Column, cand_sig: Column) -> Column:
    return (F.size(sig) >= MIN_SHARED) & (sig == cand_sig)


ACCEPTED = ["manual_override", "exact_normalised", "token_set_identical", "fuzzy_auto"]


def _decided(companies: DataFrame, institutions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Companies with the outcome of the declared, curated and exact rules."""
    override = looked_up(F.upper("company"), OVERRIDES)
    exact = candidates.select("norm", F.col("group_key").alias("_exact_group"))
    return (
        companies.withColumn("norm", names.match_name(F.col("company")))
        .withColumn("sig", names.significant_tokens(F.col("norm")))
        .withColumn("_declared", declared_class(F.col("company"), F.col("norm")))
        .withColumn("_target", override)
        .join(_override_groups(institutions), "_target", "left")
        .join(exact, "norm", "left")
        .withColumn(
            "method",
            F.when(F.col("_declared").isNotNull(), F.col("_declared.method"))
            .when(F.col("_override_group").isNotNull(), "manual_override")
            .when(F.col("_exact_group").isNotNull(), "exact_normalised"),
        )
        .select(
            "company",
            "n_complaints",
            "norm",
            "sig",
            "method",
            F.when(F.col("method") == "manual_override", F.col("_override_group"))
            .when(F.col("method") == "exact_normalised", F.col("_exact_group"))
            .alias("group_key"),
            F.when(F.col("method") == "manual_override", F.concat(F.lit("curated: "), "_target"))
            .when(F.col("method") == "exact_normalised", F.concat(F.lit("same name: "), "norm"))
            .otherwise(F.col("_declared.note"))
            .alias("note"),
            F.when(F.col("method").isin(ACCEPTED), F.lit(100.0)).alias("score"),
        )
    )


def near_pairs(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """All pairs whose character score reaches the review floor: (company, candidate, shared, jaccard, score), rounded.

    Of names without a common rare word the overlap is that of their classes, so it is weighed and rounded once for all of them.
    """
    left, right = name_join.coded(*(name_join.named(df.select(F.col("norm").alias("name"))) for df in (companies, candidates)))
    classes = [_class_tokens(name_join.classes_of(names_of), side) for names_of, side in ((left, "l"), (right, "r"))]
    pairs = name_join.near_class_pairs(*classes, REVIEW_FLOOR)
    shared, jaccard = (overlap(F.col("left_sig"), F.col("right_sig")) for overlap in (names.shared_count, names.jaccard))
    pairs = pairs.withColumns({"shared": shared.cast("bigint"), "jaccard": rounded(jaccard, 6)})
    labelled = left.join(companies.select(F.col("norm").alias("name"), F.col("company").alias("label")), "name")
    near = name_join.similar_members(pairs, labelled, right, REVIEW_FLOOR, ["shared", "jaccard"], lambda score: rounded(score, 1))
    rare = name_join.rare_pairs(left, right).withColumnsRenamed({"left_name": "norm", "right_name": "cand_norm"})
    rare = _with_overlap(rare, companies, candidates).withColumn("score", pair_score("norm", "cand_norm")).where(F.col("score") >= REVIEW_FLOOR)
    return near.withColumnsRenamed({"label": "company", "right_name": "candidate"}).union(
        rare.select("company", F.col("cand_norm"), F.col("shared").cast("bigint"), rounded(F.col("jaccard"), 6), rounded(F.col("score"), 1))
    )


def _with_overlap(pairs: DataFrame, companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (norm, cand_norm) with the columns of both sides and the overlap of their tokens."""
    return (
        pairs.join(companies.select("company", "norm", "sig"), "norm")
        .join(candidates.select(F.col("norm").alias("cand_norm"), F.col("sig").alias("cand_sig"), "group_key"), "cand_norm")
        .withColumn("shared", names.shared_count(F.col("sig"), F.col("cand_sig")))
        .withColumn("jaccard", names.jaccard(F.col("sig"), F.col("cand_sig")))
    )


def _class_tokens(classes: DataFrame, side: str) -> DataFrame:
    """Classes with significant tokens: the common ones, and one for each of the others that no other class has."""
    others = F.filter("shapes", lambda w: (F.length(w) >= names.MIN_TOKEN_LENGTH) & ~w.isin(names.GENERIC_TOKENS))
    stands = F.transform(others, lambda w, i: F.concat(F.lit(f" {side} "), i.cast("string")))
    common = names.significant_tokens(F.array_join("common", " "))
    return classes.withColumn("sig", F.concat(common, stands))


def _class_pairs(left: DataFrame, right: DataFrame, near_misses: bool) -> DataFrame:
    """Pairs of classes (see ``operators.name_join``) among whose names the best candidate of a company may be.

    Of names without a common rare word the overlap follows from the classes, and so does a lower
    and an upper bound of the score. A pair of classes stays if no other one of the company's class is surely
    better: by overlap first, then by score.
    """
    left, right = _class_tokens(left, "l"), _class_tokens(right, "r")
    found = candidate_pairs(
        left.select(F.col("klass").alias("company"), F.col("klass").alias("norm"), "sig"),
        right.select(F.col("klass").alias("norm"), "sig", F.lit(None).cast("string").alias("group_key")),
    ).select(F.col("company").alias("left_class"), F.col("cand_norm").alias("right_class"))
    if near_misses:
        found = found.union(name_join.near_classes(left, right, REVIEW_FLOOR))
    same = _same_tokens(F.col("left_sig"), F.col("right_sig"))
    pairs = name_join.weighed(found, left, right).withColumn("jaccard", names.jaccard(F.col("left_sig"), F.col("right_sig")))
    reaches = same | (F.col("most") >= REVIEW_FLOOR - 1e-9)
    pairs = pairs.where(reaches)
    if not near_misses:
        pairs = pairs.where(F.col("jaccard") >= MIN_JACCARD)
    pairs = name_join.tightened(pairs).where(reaches)
    sure = F.when(same | (F.col("covered") >= REVIEW_FLOOR + 1e-9), F.struct("jaccard", F.col("covered").alias("score")))
    surest = F.max(sure).over(Window.partitionBy("left_class"))
    within = F.struct("jaccard", F.col("most").alias("score"))
    kept = pairs.withColumn("within", within).withColumn("_surest", surest).where(F.col("_surest").isNull() | (F.col("within") >= F.col("_surest")))
    shared = names.shared_count(F.col("left_sig"), F.col("right_sig"))
    acceptable = same | _accepted(F.col("most") + 1e-9, shared, F.col("jaccard"))
    kept = kept.select(
        "left_class", "right_class", "right_first", "within", (F.col("edited") < F.col("covered")).alias("by_words"), acceptable.alias("acceptable")
    )
    return settle(kept, "class-pairs")


def _judged_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with their score that count: the floor reached or the same tokens."""
    scored = pairs.withColumn("score", pair_score(F.col("norm"), F.col("cand_norm")))
    return scored.where((F.col("score") >= REVIEW_FLOOR) | _same_tokens(F.col("sig"), F.col("cand_sig")))


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("company").agg(
        F.min_by(
            F.struct("cand_norm", "cand_sig", "group_key", "shared", "jaccard", "score"),
            F.struct(-F.col("jaccard"), -F.col("score"), F.col("cand_norm")),
        ).alias("best")
    )


def _best_candidates(undecided: DataFrame, candidates: DataFrame, near_misses: bool) -> DataFrame:
    """The best candidate of each company that has one: by overlap, score and name.

    First of those with a common rare word, then of the class that may hold the best one, then of those others
    that may still hold a better one. Where the words in common give the score of a whole class, its first name
    stands for all: one with a common rare word as well is better still, and is found as such.
    Without near misses, a company is left out of the classes if neither its candidate by rare words nor any class can be accepted.
    """
    left, right = name_join.coded(*(name_join.named(df.select(F.col("norm").alias("name"))) for df in (undecided, candidates)))
    classes = _class_pairs(name_join.classes_of(left), name_join.classes_of(right), near_misses)

    def judged(pairs: DataFrame) -> DataFrame:
        renamed = pairs.withColumnsRenamed({"left_name": "norm", "right_name": "cand_norm"})
        found = _with_overlap(renamed, undecided, candidates)
        return _best(_judged_pairs(found if near_misses else found.where(F.col("jaccard") >= MIN_JACCARD)))

    def reached(best: DataFrame) -> DataFrame:
        taken = _same_tokens(F.col("sig"), F.col("best.cand_sig")) | _accepted(F.col("best.score"), F.col("best.shared"), F.col("best.jaccard"))
        return best.join(undecided.select("company", "norm", "sig"), "company").groupBy(F.col("norm").alias("left_name")).agg(
            F.max(F.struct("best.jaccard", "best.score")).alias("reached"), F.bool_or(taken).alias("taken")
        )

    def still_open(classes: DataFrame, best: DataFrame) -> DataFrame:
        better = F.col("reached").isNull() | (F.col("within") >= F.col("reached"))
        return classes.join(reached(best), "left_name", "left").where(better).drop("reached")

    def best_of(classes: DataFrame) -> DataFrame:
        leading = classes.where("by_words").select("left_name", F.col("right_first").alias("right_name"))
        expanded = name_join.members(classes.where("NOT by_words").select("left_name", "rare", "right_class"), right)
        # The overlap is the same in all of a class, so its best name is that of the highest score.
        order = F.struct(-pair_score("left_name", "right_name"), F.col("right_name"))
        expanded = expanded.groupBy("left_name", "right_class").agg(F.min_by("right_name", order).alias("right_name"))
        return judged(leading.union(expanded.select(leading.columns)))

    first = settle(judged(name_join.rare_pairs(left, right)), "best-by-rare-words")
    classes = left.select(F.col("name").alias("left_name"), F.col("klass").alias("left_class"), "rare").join(classes, "left_class")
    open_classes, own = still_open(classes.drop("left_class"), first), Window.partitionBy("left_name")
    if not near_misses:
        hopeful = F.coalesce("taken", F.lit(False)) | F.bool_or("acceptable").over(own)
        open_classes = open_classes.withColumn("_hopeful", hopeful).where("_hopeful").drop("_hopeful")
    place = F.row_number().over(own.orderBy(F.desc("within"), "right_class"))
    open_classes = settle(open_classes.withColumn("place", place).drop("taken", "acceptable"), "open-classes")
    found = settle(_best(first.union(best_of(open_classes.where("place = 1"))).select("company", "best.*")), "best-of-first-class")
    others = best_of(still_open(open_classes.where("place > 1"), found))
    return _best(found.union(others).select("company", "best.*"))


def _best_fuzzy(undecided: DataFrame, candidates: DataFrame, near_misses: bool) -> DataFrame:
    """Verdict for companies no exact rule decided.

    No pair below the overlap of an accepted one is accepted, so without
    near misses, which leaves those out, the same companies are matched.
    """
    best = _best_candidates(undecided, candidates, near_misses)
    judged = (
        undecided.select("company", "n_complaints", "norm", "sig")
        .join(best, "company", "left")
        .withColumn("method", _verdict())
    )
    accepted = F.col("method").isin(ACCEPTED)
    return judged.select(
        "company",
        "n_complaints",
        "method",
        F.when(accepted, F.col("best.group_key")).alias("group_key"),
        F.when(F.col("best").isNotNull(), F.concat(F.lit("best candidate: "), "best.cand_norm")).alias("note"),
        rounded(F.col("best.score"), 1).alias("score"),
    )


def resolve(
    companies: DataFrame,
    institutions: DataFrame,
    groups: DataFrame | None = None,
    fuzzy: bool = True,
    near_misses: bool = True,
) -> DataFrame:
    """Match table: every company once, matched or not, with method, score and note.

    ``companies`` has unique ``company`` and ``n_complaints``. With
    ``fuzzy=False`` only the declared, curated and exact rules run. Without ``near_misses`` the
    matches are the same, and rejected candidates are mostly ``no_match``; for reports
    that do not show why a company has no match.
    """
    groups = holding_groups(institutions) if groups is None else groups
    candidates = match_candidates(institutions, groups)
    if fuzzy:
        candidates = settle(
            candidates.withColumn("sig", names.significant_tokens(F.col("norm")))
        )
        decided = settle(_decided(companies, institutions, candidates))
        columns = ["company", "n_complaints", "method", "group_key", "note", "score"]
        matches = (
            decided.where("method IS NOT NULL")
            .select(columns)
            .unionByName(_best_fuzzy(decided.where("method IS NULL"), candidates, near_misses))
        )
    else:
        matches = _decided(companies, institutions, candidates).withColumn(
            "method", F.coalesce("method", F.lit("no_match"))
        )
    facts = groups.select("group_key", F.col("group_name").alias("fdic_name"), "total_assets_b", "n_charters")
    return matches.join(facts, "group_key", "left").select(
        "company",
        "n_complaints",
        F.col("method").isin(ACCEPTED).alias("matched"),
        "group_key",
        "fdic_name",
        "total_assets_b",
        "n_charters",
        F.col("score").alias("match_score"),
        F.col("method").alias("match_method"),
        F.coalesce("note", F.lit("")).alias("match_note"),
    )


def near_misses(companies: DataFrame, institutions: DataFrame) -> DataFrame:
    """The review list: every candidate that reaches the review floor, for companies no exact rule decides."""
    candidates = match_candidates(institutions, holding_groups(institutions))
    candidates = settle(candidates.withColumn("sig", names.significant_tokens(F.col("norm"))))
    undecided = settle(_decided(companies, institutions, candidates).where("method IS NULL"))
    return near_pairs(undecided, candidates)


def match_breakdown(matches: DataFrame) -> DataFrame:
    """Companies and complaints per method with the share of all complaints."""
    by_method = matches.groupBy("match_method").agg(
        F.count("*").alias("companies"), F.sum("n_complaints").alias("complaints")
    )
    everything = matches.agg(F.sum("n_complaints").alias("n")).scalar()
    return by_method.withColumn("pct_of_volume", percent_of(F.col("complaints"), everything))


def match_rate(matches: DataFrame) -> DataFrame:
    """One row: match rate by company and by complaint volume."""
    hit = F.col("matched")
    totals = matches.agg(
        F.count("*").alias("companies"),
        F.count_if(hit).alias("matched_companies"),
        F.sum("n_complaints").alias("complaints"),
        F.coalesce(F.sum(F.when(hit, F.col("n_complaints"))), F.lit(0)).alias("matched_complaints"),
    )
    return totals.withColumns(
        {
            "pct_companies": percent_of(F.col("matched_companies"), F.col("companies"), 1),
            "pct_volume": percent_of(F.col("matched_complaints"), F.col("complaints"), 1),
        }
    )


def unmatched_by_volume(matches: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Unmatched companies, largest first; ``methods`` narrows to a review band."""
    rows = matches.where(~F.col("matched"))
    if methods:
        rows = rows.where(F.col("match_method").isin(methods))
    return rows.orderBy(F.desc("n_complaints"), "company").select(
        "company", "n_complaints", "match_method", "match_score", "match_note"
    )


def implausible(enriched: DataFrame, limit: float = IMPLAUSIBLE_PER_BILLION) -> DataFrame:
    """Matched companies whose rate no real depository could have; reported, not changed."""
    return enriched.where(F.col("matched") & (F.col("complaints_per_1b_assets") > limit)).select(
        "company", "fdic_name", "total_complaints", "total_assets_b", "complaints_per_1b_assets"
    )
